"""Corpus building: text variants to articles, claims, judgments with conflicts, and the checks on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import squeezed, text_hash
from lodestrata.storage import stored


def variants(rows: DataFrame, key: str = "article_id", text: str = "text") -> DataFrame:
    """(key, text_hash, text, occurrence_count): distinct texts of each article."""
    plain = rows.select(key, squeezed(F.col(text)).alias("text"), text_hash(F.col(text)).alias("text_hash"))
    return plain.groupBy(key, "text_hash").agg(F.max("text").alias("text"), F.count("*").alias("occurrence_count"))


def _ranked(found: DataFrame, key: str) -> DataFrame:
    whole = Window.partitionBy(key)
    order = whole.orderBy(F.desc("occurrence_count"), F.desc(F.length("text")), F.asc("text_hash"))
    return found.withColumns({"total": F.sum("occurrence_count").over(whole), "text_variant_count": F.count("*").over(whole), "place": F.row_number().over(order)})


def articles(rows: DataFrame, key: str = "article_id") -> DataFrame:
    """One row an article: its most frequent text (then the longest, then the least hash) and its counts."""
    chosen = _ranked(variants(rows, key), key).where("place = 1")
    return chosen.select(key, "text", "text_hash", F.col("total").alias("occurrence_count"), F.col("occurrence_count").alias("selected_variant_occurrence_count"), "text_variant_count")


def conflicts(rows: DataFrame, key: str = "article_id") -> DataFrame:
    """The variants of articles with more than one text; place 1 is the one chosen."""
    ranked = _ranked(variants(rows, key), key).where("text_variant_count > 1")
    return ranked.select(key, "text_hash", "occurrence_count", (F.col("place") == 1).alias("selected"), "place")


def dense_index(rows: DataFrame, key: str, name: str = "doc_idx") -> DataFrame:
    """rows with 0..n-1 in order of key, without a global window: ranges are sorted apart and offset by their counts.

    The ranges are written once, so that counts and rows are of the same ones. Columns of rows may have any names.
    """
    held = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col(f"`{key}`").alias("k"))
    spread, _ = stored(held.repartitionByRange("k").withColumn("p", F.spark_partition_id()), "ranges")
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spread.groupBy("p").agg(F.count("*").alias("n")).select("p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("o"))  # a row a range
    place = F.row_number().over(Window.partitionBy("p").orderBy("k")) - 1
    return spread.withColumn("r", place).join(F.broadcast(offsets), "p").select("row.*", (F.col("o") + F.col("r")).alias(name))


def consolidated(judgments: DataFrame) -> DataFrame:
    """One row a pair; a pair judged in more than one way has no label and is not eligible."""
    out = judgments.groupBy("claim_id", "article_id").agg(
        F.min("stance").alias("min_label"),
        F.max("stance").alias("max_label"),
        F.max("grade").alias("grade"),
        F.count("*").alias("raw_row_count"),
        F.bool_or("is_origin").alias("is_origin_source"),
        F.countDistinct("split").alias("split_count"),
    )
    agreed = F.col("min_label") == F.col("max_label")
    return out.select("claim_id", "article_id", F.when(agreed, F.col("min_label")).alias("stance_label"), F.when(agreed, F.col("grade")).alias("relevance_grade"), "is_origin_source", "raw_row_count", (~agreed).alias("label_conflict"), "min_label", "max_label", agreed.alias("eligible_for_qrels"), "split_count")


def violations(checks: dict[str, DataFrame]) -> DataFrame:
    """(check, violations): how many rows each constraint query finds; all zero for a sound corpus."""
    out = None
    for name, rows in checks.items():
        one = rows.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")
        out = one if out is None else out.union(one)
    return out
