"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

A window is a run of consecutive item words. Every window's word shingles are ordered by rarity, counted over the
whole corpus; for a containment of 1 the prefix is one shingle, so each window is found by its rarest shingle alone.
Documents are joined by those prefix shingles; the shingle's place in the window gives the one place where the window
can start (positional bound), the document's length must leave room for it (length bound), and the words there are
compared one by one (exact check). Shingles meet as 64-bit hashes; a collision only costs one more comparison.

Texts are read once: places whose shingle is in some window are written out with the words around them, and rarity,
candidates and the exact check are taken from that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import ascii_lower, discard, small_enough, stored

#: Java class of word characters: all but ASCII controls, blanks, punctuation and (as texts are lower-cased) capitals.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Distinct shingles of the windows up to which they are broadcast, as 64-bit hashes (at most some 30 MB in a hash table).
BROADCAST_WINDOWS = 1 << 20


def item_words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))


def shingle_hashes(words: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words; element i belongs to the run that starts at word i + 1."""
    def one(at):
        return F.xxhash64(F.lit(size), *[F.element_at(words, at + k) for k in range(size)])

    last = F.size(words) - (size - 1)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), one)).otherwise(F.array().cast("array<bigint>"))


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """(item string, window array<string>, wid): every item's windows; an item of fewer words is one window. wid names the window."""
    words = items.select(F.col("item_id").cast("string").alias("item"), item_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
    windows = words.select("item", F.explode(F.transform(starts, lambda at: F.slice("w", at, size))).alias("window"))
    return windows.withColumn("wid", F.md5(F.array_join("window", " ").cast("binary"))).dropDuplicates(["item", "wid"])


def _places(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """Every word of rows (i, t, w) with its place pos, counted from 0, and the hash g{n} of the n words from there; a text without words has one row without pos.

    Hashes are made after the words are exploded, in generated code; as array lambdas they would be interpreted.
    """
    out = rows.select("i", "t", "w", F.size("w").alias("n_words"), F.posexplode_outer("w").alias("pos", "word"))
    for n in sizes:
        rest = [F.get("w", F.col("pos") + k) for k in range(1, n)]
        out = out.withColumn(f"g{n}", F.when(F.col("pos") + n <= F.col("n_words"), F.xxhash64(F.lit(n), "word", *rest)))
    return out


def window_hits(rows: DataFrame, items: DataFrame, size: int = 13, shingle: int = 5) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """(base, hits, owners): base has (i, t, n_words) for each row; hits (i, t, start, length, wid) every place where a window occurs, or is None; owners (wid, item).

    rows has i, t (a hash of the text) and w, the words. Beyond BROADCAST_WINDOWS shingles of windows all shingles are
    shuffled, and words are fetched again for candidates only.
    """
    owners, _ = stored(item_windows(items, size), "windows")
    windows = owners.groupBy("wid").agg(F.first("window").alias("window"))
    windows = windows.withColumn("length", F.size("window")).withColumn("of", F.least(F.lit(shingle), "length"))
    sizes = [r["of"] for r in windows.select("of").distinct().orderBy("of").collect()]
    if not sizes:
        return rows.select("i", "t", F.size("w").alias("n_words")), None, owners
    grams = None
    for n in sizes:
        own = windows.where(F.col("of") == n).select("wid", "of", "length", F.posexplode(shingle_hashes(F.col("window"), n)).alias("place", "h"))
        grams = own if grams is None else grams.union(own)
    grams, _ = stored(grams, "shingles")
    tokens = {n: grams.where(F.col("of") == n).select("h").distinct() for n in sizes}
    places = _places(rows, sizes)
    small = small_enough(grams.select("of", "h").distinct(), BROADCAST_WINDOWS)
    if small:
        met = F.lit(False)
        for n in sizes:
            places = places.join(F.broadcast(tokens[n].select(F.col("h").alias(f"g{n}"), F.lit(True).alias(f"m{n}"))), f"g{n}", "left")
            met = met | F.coalesce(f"m{n}", F.lit(False))
        low = F.greatest(F.col("pos") + 2 - size, F.lit(1))
        kept = places.where(F.col("pos").isNull() | (F.col("pos") == 0) | met)
        kept = kept.select("i", "t", "n_words", "pos", *[F.when(F.col(f"m{n}"), F.col(f"g{n}")).alias(f"h{n}") for n in sizes], low.alias("low"), F.when(met, F.slice("w", low, 2 * size)).alias("around"))
        thin, _ = stored(kept, "places")
        base = thin.where("pos is null or pos = 0").select("i", "t", F.greatest("n_words", F.lit(0)).alias("n_words"))
        found = [thin.where(F.col(f"h{n}").isNotNull()).select("i", "t", "n_words", "pos", F.lit(n).alias("of"), F.col(f"h{n}").alias("h"), "low", "around") for n in sizes]
    else:
        base = rows.select("i", "t", F.size("w").alias("n_words"))
        found = [places.select("i", "t", "n_words", "pos", F.lit(n).alias("of"), F.col(f"g{n}").alias("h")).join(tokens[n], "h", "left_semi") for n in sizes]
    hits = found[0]
    for one in found[1:]:
        hits = hits.unionByName(one)
    if not small:
        hits, _ = stored(hits, "places")
    counts = hits.groupBy("of", "h").agg(F.count("*").alias("count"))
    rarest = F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "h", "place"))
    prefix = grams.join(counts, ["of", "h"], "left").groupBy("wid", "of", "length").agg(rarest.alias("r")).where("r.count > 0")
    prefix = prefix.select("wid", "of", "length", "r.h", "r.place").join(windows.select("wid", "window"), "wid")
    start, last = F.col("pos") - F.col("place") + 1, F.col("pos") - F.col("place") + F.col("length")
    near = hits.join(prefix, ["of", "h"]).where((start >= 1) & (last <= F.col("n_words")))
    if small:
        near = near.where(F.slice("around", start - F.col("low") + 1, F.col("length")) == F.col("window"))
    else:
        texts = rows.select(F.col("i").alias("j"), F.col("t").alias("u"), "w").dropDuplicates(["j", "u"])
        near = near.join(texts, F.col("i").eqNullSafe(F.col("j")) & (F.col("t") == F.col("u"))).where(F.slice("w", start, F.col("length")) == F.col("window"))
    return base, near.select("i", "t", start.alias("start"), "length", "wid"), owners


def contamination(docs: DataFrame, items: DataFrame, size: int = 13, shingle: int = 5, per_cent: int = 5) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one row for each row of docs.

    A document word inside any occurrence of a window is hit, once however many windows cover it. A document is
    contaminated if some word is hit and the hit words are at least ``per_cent`` of all. Null and wordless texts have
    no words and are clean. Items without words have no windows; without any window no document is hit. Rows that
    repeat a doc_id are judged by their own text. Item ids that repeat count once. Extra columns are not read.
    """
    rows = docs.select(F.col("doc_id").alias("i"), F.xxhash64("text").alias("t"), item_words(F.col("text")).alias("w"))
    found, hits, owners = window_hits(rows, items.select("item_id", "text"), size, shingle)
    found = found.withColumn("n_words", F.col("n_words").cast("long"))
    if hits is None:
        found = found.withColumn("n_hit", F.lit(0).cast("long")).withColumn("items", F.array().cast("array<string>"))
    else:
        hits, hits_path = stored(hits, "hits")
        end = (F.col("start") + F.col("length") - 1).alias("end")
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("reach"))
        step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"] - 1, a["reach"]))).alias("n"), F.greatest(a["reach"], s["end"]).alias("reach"))
        spans = hits.groupBy("i", "t").agg(F.collect_set(F.struct("start", end)).alias("spans"))
        spans = spans.select("i", "t", F.aggregate(F.array_sort("spans"), zero, step, lambda a: a["n"]).alias("n_hit"))
        named = hits.select("i", "t", "wid").distinct().join(owners.where("item is not null").select("wid", "item"), "wid").groupBy("i", "t").agg(F.collect_set("item").alias("items"))
        both = spans.join(named.select(F.col("i").alias("j"), F.col("t").alias("u"), "items"), F.col("i").eqNullSafe(F.col("j")) & (F.col("t") == F.col("u")), "left")
        # Written out, so that rows that repeat a text can be split over the tasks of the join.
        by_doc, _ = stored(both.select(F.col("i").alias("j"), F.col("t").alias("u"), "n_hit", "items"), "by-document")
        discard(docs.sparkSession, hits_path)
        found = found.join(by_doc, F.col("i").eqNullSafe(F.col("j")) & (F.col("t") == F.col("u")), "left")
        found = found.withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long"))).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return found.select(
        F.col("i").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (100 * F.col("n_hit") >= per_cent * F.col("n_words"))).alias("contaminated"),
        F.col("t").alias("text_hash"),
    )


def decontaminated(docs: DataFrame, items: DataFrame, size: int = 13, shingle: int = 5, per_cent: int = 5, broadcast_rows: int = 200_000) -> DataFrame:
    """Rows of docs that aren't contaminated. Columns of docs may have any names; ids and hashes of up to ``broadcast_rows`` others are broadcast."""
    bad = contamination(docs, items, size, shingle, per_cent).where("contaminated").select(F.col("doc_id").alias("j"), F.col("text_hash").alias("u")).distinct()
    bad, _ = stored(bad, "contaminated")
    side = F.broadcast(bad) if small_enough(bad, broadcast_rows) else bad
    held = docs.select(F.col("doc_id").alias("i"), F.xxhash64("text").alias("t"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return held.join(side, F.col("i").eqNullSafe(F.col("j")) & (F.col("t") == F.col("u")), "left_anti").select("row.*")
