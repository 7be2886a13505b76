"""Line-first quality rules, in DataFrame functions only.

Each line is judged by itself (punctuation, navigation, boilerplate); lines that fail are taken out, and a document
that loses too much of its text that way is rejected as a whole. Counts of the base rules are made inside each row
with array functions, so no text is exploded into several rows and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import WORD, let

#: Notices rather than prose, in the languages of the corpus; matched in a lower-cased line where no letter a-z stands before them.
BOILERPLATE = (
    "all rights reserved",
    "accept cookies",
    "cookie policy",
    "enable javascript",
    "licensed under",
    "lorem ipsum",
    "privacy policy",
    "released under the",
    "terms of service",
    "terms of use",
    "this work is licensed",
    "alle rechte vorbehalten",
    "datenschutzerklärung",
    "nutzungsbedingungen",
    "mentions légales",
    "politique de confidentialité",
    "tous droits réservés",
    "política de privacidad",
    "todos los derechos reservados",
    "términos de uso",
)
#: Characters that stand between the links of a menu or a trail of crumbs.
SEPARATORS = "|›»·•"
NOTICE = "(?:^|[^a-z])(?:" + "|".join(BOILERPLATE) + ")"
#: Characters that end or divide sentences.
SENTENCE_MARKS = r"[.!?\x{2026}\x{3002}\x{061F}]"
SYMBOLS = "#*$%&|<>"


def word_array(text: Column, word: str = WORD) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({word})"), F.lit(1))


def line_fails(line: Column) -> Column:
    """Whether a line with a word breaks a rule; lines without a word always stay.

    navigation: three or more separators, or one for each three of its words.
    boilerplate: holds one of the notices.
    punctuation: no mark of a sentence's end anywhere in the line, or over a tenth of its characters are symbols.
    """
    between, symbols = (F.length(line) - F.length(F.regexp_replace(line, f"[{x}]+", "")) for x in (SEPARATORS, SYMBOLS))
    # Few lines hold a separator or a symbol at all; only in these are they counted.
    navigation = line.rlike(f"[{SEPARATORS}]") & ((between >= 3) | (3 * between >= F.size(word_array(line))))
    boilerplate = F.lower(line).rlike(NOTICE)
    punctuation = ~line.rlike(SENTENCE_MARKS) | (line.rlike(f"[{SYMBOLS}]") & (10 * symbols > F.length(line)))
    return line.rlike(WORD) & (navigation | punctuation | boilerplate)


def clean_text(text: Column) -> Column:
    """The text without the lines that fail."""
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda line: ~line_fails(line)), "\n")


def repeated_words(words: Column, size: int = 3, least_bits: int = 0, few: int = 64) -> Column:
    """How many words stand in a window of ``size`` words that the array holds twice or more.

    Windows are hashed; most texts have no hash twice and are done. Otherwise the places of windows whose hash is there
    twice are taken (all places, if over ``few`` hashes are, as each place is looked up among them). Each becomes one
    long: a hash above, its place below. Sorted, equal windows are near each other; windows of one hash count only if
    words are equal, first those of the neighbours, then those of all windows of that hash. The places are then swept
    once for the words covered. Places get as many bits as they need, ``least_bits`` at least.
    """

    def counted(w: Column) -> Column:
        every = F.sequence(F.lit(1), F.size(w) - (size - 1))
        hashes = F.transform(every, lambda at: F.xxhash64(*[F.element_at(w, at + k) for k in range(size)]))

        def doubles(h: Column) -> Column:
            return let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, k: (k > 0) & (x == F.element_at(s, F.greatest(k, F.lit(1)))))))

        def places(h: Column) -> Column:
            return let(doubles(h), lambda d: F.when(F.size(d) <= few, F.filter(every, lambda at: F.array_contains(d, F.element_at(h, at)))).otherwise(every))

        zero = F.lit(0).cast("long")
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), zero).otherwise(_swept(w, places(h), size, least_bits)))

    return let(words, lambda w: F.when(F.size(w) <= size, F.lit(0).cast("long")).otherwise(counted(w)))


def _swept(words: Column, places: Column, size: int, least_bits: int) -> Column:
    #: bits that the places need; the hash takes the others
    bits = F.greatest(F.ceil(F.log2(F.size(words).cast("double") + 1)).cast("int"), F.lit(least_bits))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1

    def packed(place: Column) -> Column:
        window = F.xxhash64(*[F.element_at(words, place + k) for k in range(size)])
        return F.call_function("shiftleft", window, bits).bitwiseOR(place.cast("long"))

    def place_of(code: Column) -> Column:
        return code.bitwiseAND(mask).cast("int")

    def close(a: Column, b: Column) -> Column:
        return F.call_function("shiftright", a, bits) == F.call_function("shiftright", b, bits)

    def equal(a: Column, b: Column) -> Column:
        out = F.lit(True)
        for k in range(size):
            out = out & (F.element_at(words, place_of(a) + k) == F.element_at(words, place_of(b) + k))
        return out

    return let(F.sort_array(F.transform(places, packed)), lambda c: _covered(c, close, equal, place_of, size))


def _covered(codes: Column, close, equal, place_of, size: int) -> Column:
    last = F.size(codes)

    def twice(code: Column, k: Column) -> Column:
        before, after = F.element_at(codes, F.greatest(k, F.lit(1))), F.element_at(codes, F.least(k + 2, last))
        near = ((k > 0) & close(code, before)) | ((k + 1 < last) & close(code, after))
        neighbour = ((k > 0) & equal(code, before)) | ((k + 1 < last) & equal(code, after))
        # Only where other words have the same hash.
        elsewhere = F.exists(codes, lambda c: (c != code) & close(c, code) & equal(c, code))
        return near & (neighbour | elsewhere)

    starts = F.sort_array(F.transform(F.filter(codes, twice), place_of))
    zero = F.struct(F.lit(0).cast("long").alias("covered"), F.lit(-size).alias("at"))
    step = lambda a, s: F.struct((a["covered"] + F.least(F.lit(size), s - a["at"])).alias("covered"), s.alias("at"))
    return F.aggregate(starts, zero, step, lambda a: a["covered"])


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost")


def _facts(docs: DataFrame, text_col: str, least_words: int, most_repeated: int, most_lost: int) -> DataFrame:
    """(row, f): docs' rows as structs, and a struct of COUNTS, base_failed, kept and the clean text.

    The struct is handed on through an explode of one element, so that each expression is evaluated once a row,
    wherever filters and projections on it would be moved otherwise.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    in_words = let(word_array(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), repeated_words(w).alias("repeated")))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    dups = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")
    symbols = (F.length(text) - F.length(F.regexp_replace(text, f"[{SYMBOLS}]+", ""))).cast("long")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = lambda **fields: F.explode(F.array(F.struct(*[v.alias(k) for k, v in fields.items()])))
    first = docs.select(row.alias("row"), one(w=in_words, n_dup_lines=dups, n_symbols=symbols, clean=clean_text(text)).alias("f"))
    w = F.col("f.w")
    lost = w["chars"] - F.length(F.regexp_replace(F.col("f.clean"), r"[\x20\x09-\x0D]+", "")).cast("long")
    failed = (w["n"] < least_words) | (100 * w["repeated"] > most_repeated * w["n"])
    second = first.select("row", "f", one(n_lost=lost, failed=failed).alias("g"))
    kept = ~F.col("g.failed") & (100 * F.col("g.n_lost") <= most_lost * w["chars"])
    found = F.struct(w["n"].alias("n_words"), w["chars"].alias("word_chars"), F.col("f.n_symbols"), F.col("f.n_dup_lines"), w["repeated"].alias("n_repeat_words"), F.col("g.n_lost"), F.col("g.failed").alias("base_failed"), kept.alias("kept"), F.col("f.clean"))
    return second.select("row", found.alias("f"))


def judged(docs: DataFrame, least_words: int = 50, most_repeated: int = 50, most_lost: int = 50, text_col: str = "text") -> DataFrame:
    """docs with the columns of the verdict added; a column of docs with one of their names is replaced.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), n_lost (code points of words in lines that
    fail), base_failed, kept. A document is kept if its base rules hold and at most ``most_lost`` per cent of its word
    characters stand in lines that fail. A null text has no words: all counts are 0, base_failed is true. Ties at a
    limit pass. Rows are judged one by one, so repeated rows, null ids and extra columns go through unchanged.
    """
    names = [*COUNTS, "base_failed", "kept"]
    out = _facts(docs, text_col, least_words, most_repeated, most_lost)
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in names], *[F.col("f").getField(c).alias(c) for c in names])


def cleaned(docs: DataFrame, least_words: int = 50, most_repeated: int = 50, most_lost: int = 50) -> DataFrame:
    """Documents that the rules keep, without the lines that fail; n_chars follows the text, other columns stay."""
    out = _facts(docs, "text", least_words, most_repeated, most_lost).where("f.kept")
    new = {"text": F.col("f.clean"), "n_chars": F.length("f.clean").cast("long")}
    return out.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
