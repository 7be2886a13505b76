"""Articles to sections, canonical text and sentences with offsets; and texts cut at the ends of overlapping ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import short_id

#: Headings of structured abstracts.
SECTION_LABELS = (
    "abstract",
    "aim",
    "aims",
    "background",
    "case",
    "case presentation",
    "case report",
    "conclusion",
    "conclusions",
    "conclusions and relevance",
    "context",
    "data extraction",
    "data sources",
    "data synthesis",
    "design",
    "design and setting",
    "discussion",
    "eligibility criteria",
    "importance",
    "intervention",
    "interventions",
    "main outcome",
    "main outcomes",
    "main outcome measure",
    "main outcome measures",
    "main outcomes and measures",
    "materials",
    "materials and methods",
    "measurements",
    "measures",
    "methodology",
    "methods",
    "objective",
    "objectives",
    "outcome",
    "outcomes",
    "participants",
    "patients",
    "results",
    "review methods",
    "selection criteria",
    "setting",
    "settings",
    "subjects",
    "trial registration",
)
_LABELS = "|".join(sorted(SECTION_LABELS, key=len, reverse=True))
#: Private-use characters that mark headings while a text is split. Where a text has them itself they are spelled out meanwhile.
OPEN, CLOSE, ESCAPE = "\ue000", "\ue001", "\ue002"
_SPELLED = ((ESCAPE, ESCAPE + "e"), (OPEN, ESCAPE + "o"), (CLOSE, ESCAPE + "c"))
SPLITTER = r"(?s).+?(?:[.!?](?=\s|$)|$)"
BLANKS = r"(?U)^\s+|\s+$"


def sections(abstract: Column) -> Column:
    """array<struct<section, text>>: a text with two headings or more is cut at them, another is one section."""
    plain = abstract
    for mark, spelled in _SPELLED:
        plain = F.replace(plain, F.lit(mark), F.lit(spelled))
    marked = F.regexp_replace(plain, rf"(?i)(?:^|(?<=\s))({_LABELS})\s*:\s*", f"{OPEN}$1{CLOSE}")
    pieces = F.split(marked, OPEN, -1)

    def cut(piece: Column, k: Column) -> Column:
        name = F.regexp_replace(F.lower(F.substring_index(piece, CLOSE, 1)), r"\s+", "_")
        body = F.when(k == 0, piece).otherwise(F.substring_index(piece, CLOSE, -1))
        return F.struct(F.when(k == 0, F.lit("abstract")).otherwise(name).alias("section"), F.regexp_replace(restored(body), BLANKS, "").alias("text"))

    def restored(text: Column) -> Column:
        for mark, spelled in reversed(_SPELLED):
            text = F.replace(text, F.lit(spelled), F.lit(mark))
        return text

    found = F.filter(F.transform(pieces, cut), lambda s: s["text"] != "")
    whole = F.array(F.struct(F.lit("abstract").alias("section"), F.regexp_replace(abstract, BLANKS, "").alias("text")))
    return F.when((F.size(pieces) > 2) & (F.size(found) > 0), found).otherwise(F.filter(whole, lambda s: s["text"] != ""))


def segments(rows: DataFrame, key: str, title: str = "title", abstract: str = "abstract") -> DataFrame:
    """(key, section_index, sentence_type, section, text, document_start): parts of the canonical text, which joins them by two line feeds."""
    head = F.when(F.coalesce(F.length(title), F.lit(0)) > 0, F.array(F.struct(F.lit("title").alias("sentence_type"), F.lit("title").alias("section"), F.col(title).alias("text")))).otherwise(F.array())
    body = F.transform(sections(F.coalesce(F.col(abstract), F.lit(""))), lambda s: F.struct(F.lit("abstract").alias("sentence_type"), s["section"].alias("section"), s["text"].alias("text")))
    parts = rows.select(key, F.posexplode(F.concat(head, body)).alias("section_index", "p")).select(key, "section_index", "p.*")
    before = Window.partitionBy(key).orderBy("section_index").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("document_start", F.coalesce(F.sum(F.length("text") + 2).over(before), F.lit(0)))


def sentence_spans(text: Column) -> Column:
    """array<struct<start, end, text>> of a text's sentences, blanks at their ends left out; end is exclusive."""
    pieces = F.regexp_extract_all(text, F.lit(f"({SPLITTER})"), F.lit(1))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("out"))

    def step(state: Column, piece: Column) -> Column:
        bare = F.regexp_replace(piece, r"(?U)^\s+", "")
        core = F.regexp_replace(bare, r"(?U)\s+$", "")
        start = state["at"] + F.length(piece) - F.length(bare)
        one = F.array(F.struct(start.alias("start"), (start + F.length(core)).alias("end"), core.alias("text")))
        return F.struct((state["at"] + F.length(piece)).alias("at"), F.when(core == "", state["out"]).otherwise(F.concat(state["out"], one)).alias("out"))

    return F.aggregate(pieces, zero, step, lambda s: s["out"])


def sentences(parts: DataFrame, key: str) -> DataFrame:
    """One row a sentence of the segments, with its place and its offsets in section and document (code points, from 0)."""
    rows = parts.select("*", F.posexplode(sentence_spans(F.col("text"))).alias("sentence_index_within_section", "s")).drop("text")
    order = Window.partitionBy(key).orderBy("section_index", "sentence_index_within_section")
    start, end = F.col("document_start") + F.col("s.start"), F.col("document_start") + F.col("s.end")
    return rows.select(
        key,
        (F.row_number().over(order) - 1).alias("sentence_index"),
        "sentence_index_within_section",
        "sentence_type",
        "section",
        "section_index",
        F.col("s.text").alias("sentence_text"),
        start.alias("character_start"),
        end.alias("character_end"),
        F.col("s.start").alias("section_character_start"),
        F.col("s.end").alias("section_character_end"),
        short_id("", F.col(key).cast("string"), start.cast("string"), end.cast("string"), F.col("s.text")).alias("sentence_id"),
    )


def sentence_violations(rows: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """(check, violations): indices 0..n-1, offsets that rise, and text that stands where the offsets say. texts: (key, source_text)."""
    from lodestrata.operators.corpus import violations

    per = rows.groupBy(key).agg(F.count("*").alias("n"), F.min("sentence_index").alias("lo"), F.max("sentence_index").alias("hi"), F.countDistinct("sentence_index").alias("u"))
    previous = F.lag("character_end").over(Window.partitionBy(key).orderBy("sentence_index"))
    placed = rows.join(texts, key)
    there = F.substring(F.col("source_text"), F.col("character_start") + 1, F.col("character_end") - F.col("character_start"))
    return violations({"contiguous": per.where("lo <> 0 or hi <> n - 1 or u <> n"), "offsets_rise": rows.withColumn("p", previous).where("p > character_start"), "text_in_place": placed.where(there != F.col("sentence_text"))})


def range_segments(rows: DataFrame, key: str, length: str, ranges: str) -> DataFrame:
    """(key, start, end, ids): the text cut where a range starts or ends, each piece with the ranges over it; like neighbours are one piece.

    ranges: array<struct<id, start, end>>; ends beyond the text are drawn in, empty ranges left out.
    """
    n = F.col(length)
    clamped = F.filter(F.transform(F.col(ranges), lambda r: F.struct(r["id"].alias("id"), F.greatest(F.lit(0), F.least(n, r["start"])).alias("s"), F.least(n, r["end"]).alias("e"))), lambda r: r["s"] < r["e"])
    with_ranges = rows.select(key, n.alias("n"), clamped.alias("r"))
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0), F.col("n")), F.transform("r", lambda r: r["s"]), F.transform("r", lambda r: r["e"]))))
    with_cuts = with_ranges.select(key, "r", cuts.alias("c"))
    pairs = F.filter(F.arrays_zip(F.slice("c", 1, F.greatest(F.size("c") - 1, F.lit(0))).alias("start"), F.slice("c", 2, F.size("c")).alias("end")), lambda p: p["start"] < p["end"])
    pieces = with_cuts.select(key, "r", F.posexplode(pairs).alias("k", "p"))
    ids = F.transform(F.filter("r", lambda r: (r["s"] <= F.col("p.start")) & (r["e"] >= F.col("p.end"))), lambda r: r["id"])
    pieces = pieces.select(key, "k", F.col("p.start").alias("start"), F.col("p.end").alias("end"), ids.alias("ids"))
    order = Window.partitionBy(key).orderBy("k")
    new = (~F.col("ids").eqNullSafe(F.lag("ids").over(order))).cast("int")
    grouped = pieces.withColumn("new", new).withColumn("g", F.sum("new").over(order))
    return grouped.groupBy(key, "g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("ids").alias("ids")).drop("g")
