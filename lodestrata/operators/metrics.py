"""Evaluation of rankings, sentence retrieval and classification."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _gain(grade: str, rank: str, k: int) -> Column:
    return F.sum(F.when(F.col(rank) <= k, (F.pow(F.lit(2.0), F.col(grade)) - 1) / F.log2(F.col(rank) + 1)).otherwise(0.0))


def judged_metrics(ranked: DataFrame, query_key: str = "claim_id") -> DataFrame:
    """Per query: MRR, nDCG at 3, 5 and 10, top-1 grade, recall of positives at 10 and 50. ranked: (query, grade, rank)."""
    ideal = Window.partitionBy(query_key).orderBy(F.desc("grade"), "rank")
    rows = ranked.withColumn("ideal", F.row_number().over(ideal))
    positive = F.col("grade") > 0
    out = rows.groupBy(query_key).agg(
        F.min(F.when(positive, F.col("rank"))).alias("first_positive"),
        *[_gain("grade", "rank", k).alias(f"dcg{k}") for k in (3, 5, 10)],
        *[_gain("grade", "ideal", k).alias(f"idcg{k}") for k in (3, 5, 10)],
        F.max(F.when(F.col("rank") == 1, F.col("grade"))).alias("top1_grade"),
        F.count_if(positive).alias("positives"),
        *[F.count_if(positive & (F.col("rank") <= k)).alias(f"hits{k}") for k in (10, 50)],
    )
    ndcg = [F.coalesce(F.try_divide(F.col(f"dcg{k}"), F.col(f"idcg{k}")), F.lit(0.0)).alias(f"ndcg_at_{k}") for k in (3, 5, 10)]
    recall = [F.try_divide(F.col(f"hits{k}").cast("double"), F.col("positives")).alias(f"recall_at_{k}") for k in (10, 50)]
    return out.select(query_key, F.coalesce(F.try_divide(F.lit(1.0), F.col("first_positive")), F.lit(0.0)).alias("mrr"), *ndcg, "top1_grade", *recall, "positives")


def pairwise_accuracy(ranked: DataFrame, query_key: str = "claim_id") -> DataFrame:
    """Per query: share of pairs of unlike grades that the scores order rightly; a tie counts half, no pair gives no row.

    Counted from rows by grade and score, in order, without making the pairs.
    """
    cells = ranked.groupBy(query_key, "grade", "score").agg(F.count("*").alias("n"))
    grades = [r[0] for r in cells.select("grade").distinct().orderBy("grade").collect()]  # a few grades
    upto = Window.partitionBy(query_key).orderBy("score").rangeBetween(Window.unboundedPreceding, 0)
    level, whole = Window.partitionBy(query_key, "score"), Window.partitionBy(query_key)
    pairs, credit = F.lit(0), F.lit(0.0)
    for g in grades:
        lower = F.when(F.col("grade") < g, F.col("n")).otherwise(0)
        own = F.when(F.col("grade") == g, F.col("n")).otherwise(0)
        here, below, every = F.sum(lower).over(level), F.sum(lower).over(upto), F.sum(lower).over(whole)
        pairs, credit = pairs + own * every, credit + own * (below - here + 0.5 * here)
    out = cells.select(query_key, pairs.alias("p"), credit.alias("c")).groupBy(query_key).agg(F.sum("c").alias("c"), F.sum("p").cast("long").alias("pairs")).where("pairs > 0")
    return out.select(query_key, (F.col("c") / F.col("pairs")).alias("pairwise_accuracy"), "pairs")


def open_metrics(positives: DataFrame, run: DataFrame, query_key: str, doc_key: str, depths: Iterable[int] = (10, 50, 100)) -> DataFrame:
    """Per query with a known positive: recall and hit at each depth, and the rank of the first positive found."""
    found = positives.select(query_key, doc_key).distinct().join(run.select(query_key, doc_key, "rank"), [query_key, doc_key], "left")
    depths = list(depths)
    out = found.groupBy(query_key).agg(F.count("*").alias("positives"), F.min("rank").alias("first_positive_rank"), *[F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in depths])
    columns = [(F.col(f"h{k}") / F.col("positives")).alias(f"recall_at_{k}") for k in depths] + [(F.col(f"h{k}") > 0).cast("int").alias(f"hit_at_{k}") for k in depths]
    return out.select(query_key, "positives", "first_positive_rank", *columns)


def macro(per_query: DataFrame, metrics: list[str], digits: int = 8) -> DataFrame:
    """One row: means over the queries that have the metric."""
    return per_query.agg(F.count("*").alias("queries"), *[F.round(F.avg(m), digits).alias(m) for m in metrics])


def rank_buckets(positives: DataFrame, run: DataFrame, query_key: str, doc_key: str) -> DataFrame:
    """(bucket, n): where known positives stand in a run."""
    found = positives.select(query_key, doc_key).distinct().join(run.select(query_key, doc_key, "rank"), [query_key, doc_key], "left")
    r = F.col("rank")
    bucket = F.when(r <= 10, "001-010").when(r <= 50, "011-050").when(r <= 100, "051-100").otherwise("missing")
    return found.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def recall_audit(positives: DataFrame, run: DataFrame, query_key: str, doc_key: str) -> DataFrame:
    """One row: recall at 10, 50 and 100 (means over queries), whether it stands still from 10 on, and whether all positives found are among the first ten."""
    per = open_metrics(positives, run, query_key, doc_key, (10, 50, 100))
    out = per.agg(*[F.round(F.avg(f"recall_at_{k}"), 8).alias(f"recall_at_{k}") for k in (10, 50, 100)])
    buckets = rank_buckets(positives, run, query_key, doc_key)
    late = buckets.agg(F.coalesce(F.sum(F.when(F.col("bucket").isin("011-050", "051-100"), F.col("n"))), F.lit(0)).alias("late"))
    plateau = (F.col("recall_at_10") == F.col("recall_at_50")) & (F.col("recall_at_50") == F.col("recall_at_100"))
    return out.join(F.broadcast(late)).select("recall_at_10", "recall_at_50", "recall_at_100", plateau.alias("recall_plateau"), (F.col("late") == 0).alias("all_found_in_top10"))


def recall_gaps(positives: DataFrame, run: DataFrame, reference: DataFrame, query_key: str, doc_key: str, share: float = 0.9) -> DataFrame:
    """One row: positives that only the reference run finds, where they stand there, and whether that looks like lists never probed (at least ``share`` of them at its top).

    Only queries that both runs have count.
    """
    shared = run.select(query_key).distinct().join(reference.select(query_key).distinct(), query_key)
    keys = [query_key, doc_key]
    gold = positives.select(*keys).distinct().join(shared, query_key)
    both = gold.join(run.select(*keys, F.col("rank").alias("own")), keys, "left").join(reference.select(*keys, F.col("rank").alias("other")), keys, "left")
    gained = F.col("own").isNull() & F.col("other").isNotNull()
    r = F.col("other")
    out = both.agg(F.countDistinct(query_key).alias("shared_queries"), F.count_if(gained).alias("gained"), F.count_if(gained & (r <= 10)).alias("gained_top10"), F.count_if(gained & (r > 10) & (r <= 50)).alias("gained_11_50"), F.count_if(gained & (r > 50)).alias("gained_later"))
    top = F.try_divide(F.col("gained_top10").cast("double"), F.col("gained"))
    return out.withColumns({"top10_share": F.round(top, 8), "looks_like_unprobed_lists": F.coalesce(top >= share, F.lit(False))})


def run_comparison(runs: dict[str, DataFrame], judged: DataFrame, positives: DataFrame, query_key: str, doc_key: str) -> DataFrame:
    """A row for each run: MRR, nDCG at 5 and top-1 rate over its judged documents, pairwise accuracy, recall of known positives.

    runs: (query, document, rank, score); judged: (query, document, grade); ranks among judged documents are made anew.
    """
    out = None
    for name, run in runs.items():
        place = Window.partitionBy(query_key).orderBy("rank")
        ranked = judged.join(run.select(query_key, doc_key, "rank", "score"), [query_key, doc_key]).withColumn("rank", F.row_number().over(place))
        per = judged_metrics(ranked, query_key).where("positives > 0")
        first = per.agg(F.round(F.avg("mrr"), 8).alias("mrr"), F.round(F.avg("ndcg_at_5"), 8).alias("ndcg_at_5"), F.round(F.avg((F.col("top1_grade") > 0).cast("double")), 8).alias("top1_positive_rate"))
        pairs = pairwise_accuracy(ranked, query_key).agg(F.round(F.avg("pairwise_accuracy"), 8).alias("pairwise_accuracy"))
        opened = open_metrics(positives, run, query_key, doc_key).agg(*[F.round(F.avg(m), 8).alias(m) for m in ("recall_at_10", "recall_at_50", "recall_at_100", "hit_at_100")])
        one = first.join(pairs).join(opened).select(F.lit(name).alias("run"), "*")
        out = one if out is None else out.union(one)
    return out


def aspect_metrics(links: DataFrame, run: DataFrame, query_key: str = "query_id", item_key: str = "idx", k: int = 5) -> DataFrame:
    """Per query: aspects covered by the first k, precision of the first k, reciprocal rank of the first useful item.

    links: (query, aspect, item); only aspects that some item covers count.
    """
    total = links.groupBy(query_key).agg(F.countDistinct("aspect").alias("aspects"))
    top = run.where(F.col("rank") <= k)
    covered = links.join(top, [query_key, item_key]).groupBy(query_key).agg(F.countDistinct("aspect").alias("covered"))
    useful = links.select(query_key, item_key).distinct().withColumn("useful", F.lit(1))
    marked = run.join(useful, [query_key, item_key], "left")
    per = marked.groupBy(query_key).agg(F.count_if((F.col("rank") <= k) & F.col("useful").isNotNull()).alias("good"), F.count_if(F.col("rank") <= k).alias("shown"), F.min(F.when(F.col("useful").isNotNull(), F.col("rank"))).alias("first"))
    out = total.join(covered, query_key, "left").join(per, query_key, "left")
    return out.select(
        query_key,
        (F.coalesce("covered", F.lit(0)) / F.col("aspects")).alias("aspect_recall"),
        F.coalesce(F.try_divide(F.col("good").cast("double"), F.col("shown")), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(F.lit(1.0), F.col("first")), F.lit(0.0)).alias("mrr"),
    )


def complementarity(left: DataFrame, right: DataFrame, query_key: str, item_key: str, depths: Iterable[int] = (5, 10, 20, 50)) -> DataFrame:
    """Per depth: mean overlap, union and Jaccard of two runs' first items; an empty union counts as 1."""
    keys = [query_key, item_key]
    both = left.select(*keys, F.col("rank").alias("l")).join(right.select(*keys, F.col("rank").alias("r")), keys, "full_outer")
    grid = both.withColumn("depth", F.explode(F.array(*map(F.lit, depths))))
    inl, inr = F.coalesce(F.col("l") <= F.col("depth"), F.lit(False)), F.coalesce(F.col("r") <= F.col("depth"), F.lit(False))
    per = grid.groupBy(query_key, "depth").agg(F.count_if(inl & inr).alias("o"), F.count_if(inl | inr).alias("u"))
    return per.groupBy("depth").agg(F.avg("o").alias("overlap"), F.avg("u").alias("union_size"), F.avg(F.coalesce(F.try_divide(F.col("o").cast("double"), F.col("u")), F.lit(1.0))).alias("jaccard"))


def paired(base: DataFrame, other: DataFrame, query_key: str, metric: str) -> DataFrame:
    """One row: wins, ties and losses of the second run, and the mean difference."""
    both = base.select(query_key, F.col(metric).alias("b")).join(other.select(query_key, F.col(metric).alias("o")), query_key)
    return both.agg(F.count("*").alias("queries"), F.count_if(F.expr("o > b")).alias("wins"), F.count_if(F.expr("o = b")).alias("ties"), F.count_if(F.expr("o < b")).alias("losses"), F.avg(F.expr("o - b")).alias("mean_delta"))


def bootstrap_interval(deltas: DataFrame, cluster_key: str, value: str, samples: int = 1000, seed: int = 42) -> DataFrame:
    """(low, mean, high, share_positive): 95 % interval of the mean by resampling clusters with replacement.

    Clusters are summed up first. Sample s draws cluster c as often as a Poisson(1) variate that a hash of (seed, s, c)
    decides, so no task needs all clusters and the draw is the same in every run and in SQL.
    """
    clusters = deltas.groupBy(cluster_key).agg(F.sum(value).alias("s"), F.count("*").alias("n"))
    drawn = clusters.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "sample", cluster_key)), 1, 8)
    u = F.conv(digits, 16, 10).cast("double") / F.lit(float(16**8))
    times, total, term = F.lit(0), 0.0, 0.36787944117144233
    for k in range(1, 9):  # Poisson(1): P(0) = P(1) = 1/e
        total += term
        times = times + (u >= total).cast("int")
        term /= k
    means = drawn.withColumn("t", times).groupBy("sample").agg(F.try_divide(F.sum(F.col("t") * F.col("s")), F.sum(F.col("t") * F.col("n"))).alias("m"))
    mean = deltas.agg(F.avg(value).alias("mean"))
    out = means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"), F.avg((F.col("m") > 0).cast("double")).alias("share_positive"))
    return out.join(F.broadcast(mean)).select("low", "mean", "high", "share_positive")


def confusion(rows: DataFrame, classes: list[str], gold: str = "gold", pred: str = "pred") -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1): 0 where nothing can be divided."""
    marks = [F.struct(F.lit(c).alias("label"), (F.col(gold) == c).alias("g"), (F.col(pred) == c).alias("p")) for c in classes]
    one = rows.select(F.explode(F.array(*marks)).alias("m")).select("m.*")
    out = one.groupBy("label").agg(F.count_if(F.expr("g and p")).alias("tp"), F.count_if(F.expr("p and not g")).alias("fp"), F.count_if(F.expr("g and not p")).alias("fn"))
    div = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    out = out.withColumns({"precision": div(F.col("tp"), F.expr("tp + fp")), "recall": div(F.col("tp"), F.expr("tp + fn"))})
    return out.withColumn("f1", div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def classification_summary(rows: DataFrame, classes: list[str], gold: str = "gold", pred: str = "pred") -> DataFrame:
    """One row: rows, accuracy, macro-F1 and balanced accuracy (the mean recall) over the classes, absent ones counting 0."""
    per = confusion(rows, classes, gold, pred).agg(F.avg("f1").alias("macro_f1"), F.avg("recall").alias("balanced_accuracy"))
    whole = rows.agg(F.count("*").alias("n"), F.avg((F.col(gold) == F.col(pred)).cast("double")).alias("accuracy"))
    return whole.join(F.broadcast(per)).select("n", "accuracy", "macro_f1", "balanced_accuracy")


def cover_size(sets: Iterable[Iterable]) -> int:
    """How few of the sets cover all their elements: branch and bound over bit masks, with dominated sets left out."""
    names: dict = {}
    masks = {sum(1 << names.setdefault(e, len(names)) for e in set(s)) for s in sets} - {0}
    masks = sorted((m for m in masks if not any(m != o and m & o == m for o in masks)), key=lambda m: -m.bit_count())
    full = (1 << len(names)) - 1
    best, left = 0, full
    while left:
        left &= ~max(masks, key=lambda m: (m & left).bit_count())
        best += 1
    stack = [(0, full)]
    seen: dict[int, int] = {}
    while stack:
        used, left = stack.pop()
        if not left:
            best = min(best, used)
            continue
        widest = max((m & left).bit_count() for m in masks)
        if used - (-left.bit_count() // widest) >= best or seen.get(left, best) <= used:
            continue
        seen[left] = used
        rarest = min((b for b in range(len(names)) if left >> b & 1), key=lambda b: sum(m >> b & 1 for m in masks))
        stack += [(used + 1, left & ~m) for m in masks if m >> rarest & 1]
    return best


def set_cover(links: DataFrame, query_key: str = "query_id", item_key: str = "idx") -> DataFrame:
    """(query, optimal_items): the fewest items that cover a query's aspects."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        size = cover_size(pdf.groupby(item_key)["aspect"].agg(set))
        return pd.DataFrame({query_key: [pdf[query_key].iloc[0]], "optimal_items": [size]})

    return links.select(query_key, item_key, "aspect").groupBy(query_key).applyInPandas(one, f"{query_key} long, optimal_items long")
