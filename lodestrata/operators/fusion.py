"""Rank fusion with provenance, reranking, and what changed between two runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fused(runs: dict[str, DataFrame], query_key: str, doc_key: str, method: str = "rrf", k: int = 60, weights: dict[str, float] | None = None, by_rank_sum: bool = True) -> DataFrame:
    """Runs (query, document, rank, score), by alias, joined into one ranking.

    rrf: sum of weight / (k + rank) over the sources. union: no score but one less for each place; order by best rank,
    then by more sources, then by the sum of ranks. Columns {alias}_rank and {alias}_score keep where a row came from;
    source_mask has a bit for each source in the order given. Sums run in that order too, so ties are exact. Without
    ``by_rank_sum`` the sum of ranks doesn't count in the order, as for sentences.
    """
    weights = weights or {}
    tagged = None
    for bit, (alias, run) in enumerate(runs.items()):
        one = run.select(query_key, doc_key, F.col("rank").cast("int").alias("rank"), F.col("score").cast("double").alias("score"), F.lit(alias).alias("__alias"), F.lit(1 << bit).cast("long").alias("__bit"))
        tagged = one if tagged is None else tagged.unionByName(one)
    per_source = [F.max(F.when(F.col("__alias") == a, F.col(c))).alias(f"{a}_{c}") for a in runs for c in ("rank", "score")]
    merged = tagged.groupBy(query_key, doc_key).agg(
        F.bit_or("__bit").alias("source_mask"), F.count("*").cast("int").alias("source_count"), F.min("rank").alias("best_rank"), F.sum("rank").alias("rank_sum"), *per_source
    )
    parts = [F.coalesce(F.lit(float(weights.get(a, 1.0))) / (k + F.col(f"{a}_rank")), F.lit(0.0)) for a in runs]
    score = parts[0]
    for part in parts[1:]:
        score = score + part
    whole = Window.partitionBy(query_key)
    if method == "rrf":
        order = whole.orderBy(F.desc("fusion_score"), F.desc("source_count"), "best_rank", *(["rank_sum"] if by_rank_sum else []), doc_key)
        return merged.withColumn("fusion_score", score).withColumn("fusion_rank", F.row_number().over(order))
    if method != "union":
        raise ValueError(f"no such method: {method}")
    order = whole.orderBy("best_rank", F.desc("source_count"), "rank_sum", doc_key)
    ranked = merged.withColumn("fusion_rank", F.row_number().over(order))
    return ranked.withColumn("fusion_score", (F.count("*").over(whole) - F.col("fusion_rank") + 1).cast("double"))


def reranked(candidates: DataFrame, scores: DataFrame, query_key: str, doc_key: str, depth: int) -> DataFrame:
    """candidates (fusion_rank, fusion_score) with rerank_rank: the first ``depth`` by their new score, the rest after them as they were."""
    chosen = F.col("fusion_rank") <= depth
    joined = candidates.join(scores.select(query_key, doc_key, F.col("score").alias("ce_score")), [query_key, doc_key], "left").withColumn("ce_score", F.when(chosen, F.col("ce_score")))
    order = Window.partitionBy(query_key).orderBy(F.desc(chosen), F.desc_nulls_last("ce_score"), "fusion_rank", F.desc("fusion_score"), doc_key)
    return joined.withColumn("selected", chosen).withColumn("rerank_rank", F.row_number().over(order))


def set_difference(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """One row: pairs in both runs, lost, and added."""
    a = before.select(*keys).distinct().withColumn("__a", F.lit(True))
    b = after.select(*keys).distinct().withColumn("__b", F.lit(True))
    both = a.join(b, keys, "full_outer")
    return both.agg(F.count_if(F.col("__a") & F.col("__b")).alias("common"), F.count_if(F.col("__b").isNull()).alias("missing"), F.count_if(F.col("__a").isNull()).alias("added"))


def direction_accuracy(scored: DataFrame, query_key: str = "query_id") -> DataFrame:
    """(pairs, correct, ties, accuracy) over pairs of a query's rows of which one has the higher grade.

    Pairs aren't made: rows are counted by grade and score, and for each such count the lower grades below and at its
    score are summed up in order, so the work grows with the rows.
    """
    cells = scored.groupBy(query_key, "grade", "score").agg(F.count("*").alias("n"))
    grades = [r[0] for r in cells.select("grade").distinct().orderBy("grade").collect()]  # a few grades
    upto = Window.partitionBy(query_key).orderBy("score").rangeBetween(Window.unboundedPreceding, 0)
    level = Window.partitionBy(query_key, "score")
    whole = Window.partitionBy(query_key)
    pairs, correct, ties = F.lit(0), F.lit(0), F.lit(0)
    for g in grades:
        lower = F.when(F.col("grade") < g, F.col("n")).otherwise(0)
        own = F.when(F.col("grade") == g, F.col("n")).otherwise(0)
        here, below, every = F.sum(lower).over(level), F.sum(lower).over(upto), F.sum(lower).over(whole)
        pairs, ties, correct = pairs + own * every, ties + own * here, correct + own * (below - here)
    out = cells.select(pairs.alias("p"), correct.alias("c"), ties.alias("t"))
    out = out.agg(*[F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(n) for x, n in (("p", "pairs"), ("c", "correct"), ("t", "ties"))])
    return out.withColumn("accuracy", F.try_divide(F.col("correct").cast("double"), F.col("pairs")))


def grade_moments(scored: DataFrame) -> DataFrame:
    """Moments of the score by grade, and whether the means rise with the grade."""
    out = scored.groupBy("grade").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.min("score").alias("low"), F.max("score").alias("high"))
    before = F.lag("mean").over(Window.orderBy("grade"))  # a row a grade
    return out.withColumn("rises", F.coalesce(F.col("mean") > before, F.lit(True)))
