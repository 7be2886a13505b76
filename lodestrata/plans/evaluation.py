"""Queries over fusion, reranking and evaluation. Oracles share the runs as common table expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import fusion, metrics, sparse
from lodestrata.plans.retrieval import POOL, _pools
from lodestrata.plans.roles import BM25, JUDGMENTS, judgments, table

# Two runs, 50 deep: BM25, and judged documents by a number from their id; the latter stands for a retriever of which
# only the ranking matters here. fusion_of_three adds one more.


def _runs(spark, d):
    docs, queries = table(spark, d, "documents"), table(spark, d, "benchmark")
    bm25 = sparse.search(docs, queries, 50)
    judged = judgments(spark, d).select(F.col("claim_id").alias("item_id"), "doc_id", "grade")
    quality = sparse.top_k(judged.withColumn("score", (F.col("doc_id") * 7919 % 1000).cast("double")), "item_id", "doc_id", 50).drop("grade")
    return {"bm25": bm25, "judged": quality}


RUNS = f"""{BM25}, {JUDGMENTS},
run_a AS (SELECT * FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM bm25) WHERE rank <= 50),
run_b AS (SELECT * FROM (SELECT claim_id AS item_id, doc_id, CAST(doc_id * 7919 % 1000 AS DOUBLE) AS score,
          row_number() OVER (PARTITION BY claim_id ORDER BY doc_id * 7919 % 1000 DESC, doc_id) AS rank FROM judgments) WHERE rank <= 50),
m AS (SELECT item_id, doc_id, CAST((a.rank IS NOT NULL)::INT + 2 * (b.rank IS NOT NULL)::INT AS BIGINT) AS source_mask, (a.rank IS NOT NULL)::INT + (b.rank IS NOT NULL)::INT AS source_count,
      least(coalesce(a.rank, b.rank), coalesce(b.rank, a.rank)) AS best_rank, coalesce(a.rank, 0) + coalesce(b.rank, 0) AS rank_sum,
      a.rank AS bm25_rank, a.score AS bm25_score, b.rank AS judged_rank, b.score AS judged_score,
      coalesce(1.0::DOUBLE / (60 + a.rank), 0.0::DOUBLE) + coalesce(1.0::DOUBLE / (60 + b.rank), 0.0::DOUBLE) AS s
      FROM run_a a FULL OUTER JOIN run_b b USING (item_id, doc_id)),
rrf AS (SELECT *, s AS fusion_score, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, source_count DESC, best_rank, rank_sum, doc_id) AS fusion_rank FROM m)"""


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def rrf_fusion(spark, d):
    return _rounded(fusion.fused(_runs(spark, d), "item_id", "doc_id"), "fusion_score", "bm25_score")


def union_fusion(spark, d):
    out = fusion.fused(_runs(spark, d), "item_id", "doc_id", "union")
    return out.select("item_id", "doc_id", "source_mask", "best_rank", "fusion_rank", "fusion_score")


def union_sizes(spark, d):
    sizes = fusion.fused(_runs(spark, d), "item_id", "doc_id").groupBy("item_id").agg(F.count("*").alias("n"))
    return sizes.agg(F.min("n").alias("smallest"), F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("largest"))


def source_masks(spark, d):
    return fusion.fused(_runs(spark, d), "item_id", "doc_id").groupBy("source_mask").agg(F.count("*").alias("n"))


def union_ceiling(spark, d):
    found = fusion.fused(_runs(spark, d), "item_id", "doc_id").withColumn("rank", F.col("fusion_rank"))
    gold = judgments(spark, d).where("grade > 0").select(F.col("claim_id").alias("item_id"), "doc_id")
    per = metrics.open_metrics(gold, found, "item_id", "doc_id", [1000])
    return metrics.macro(per, ["recall_at_1000", "hit_at_1000"])


def _reranked(spark, d):
    first = fusion.fused(_runs(spark, d), "item_id", "doc_id")
    scores = judgments(spark, d).select(F.col("claim_id").alias("item_id"), "doc_id", (F.col("grade") + (F.col("doc_id") % 10) / 10).alias("score"))
    return fusion.reranked(first, scores, "item_id", "doc_id", 20)


CE = """rr AS (SELECT r.*, CASE WHEN fusion_rank <= 20 THEN j.grade + (r.doc_id % 10) / 10.0::DOUBLE END AS ce_score, fusion_rank <= 20 AS selected
        FROM rrf r LEFT JOIN judgments j ON j.claim_id = r.item_id AND j.doc_id = r.doc_id),
reranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY selected DESC, ce_score DESC NULLS LAST, fusion_rank, fusion_score DESC, doc_id) AS rerank_rank FROM rr)"""


def rerank_order(spark, d):
    return _rounded(_reranked(spark, d), "ce_score").select("item_id", "doc_id", "fusion_rank", "selected", "ce_score", "rerank_rank")


def rerank_set_difference(spark, d):
    out = _reranked(spark, d)
    return fusion.set_difference(out.where("fusion_rank <= 10"), out.where("rerank_rank <= 10"), ["item_id", "doc_id"])


def _graded(spark, d):
    """Judged documents of each claim, ranked by a score."""
    j = judgments(spark, d).withColumn("score", (F.col("doc_id") * 7919 % 13).cast("double"))
    return sparse.top_k(j, "claim_id", "doc_id", None)


GRADED = f"""{JUDGMENTS}, graded AS (SELECT *, CAST(doc_id * 7919 % 13 AS DOUBLE) AS score, row_number() OVER (PARTITION BY claim_id ORDER BY doc_id * 7919 % 13 DESC, doc_id) AS rank FROM judgments)"""


def score_direction(spark, d):
    return _rounded(fusion.direction_accuracy(_graded(spark, d), "claim_id"), "accuracy")


def score_moments(spark, d):
    return _rounded(fusion.grade_moments(_graded(spark, d)), "mean", "std")


JUDGED = ["mrr", "ndcg_at_3", "ndcg_at_5", "ndcg_at_10", "recall_at_10", "recall_at_50"]


def judged_metrics(spark, d):
    return _rounded(metrics.judged_metrics(_graded(spark, d)), *JUDGED)


def judged_metrics_by_track(spark, d):
    """Means by track; a track's documents are ranked among themselves, and claims without a positive don't count."""
    j = judgments(spark, d).withColumn("score", (F.col("doc_id") * 7919 % 13).cast("double"))
    tracks = F.when(F.col("is_origin"), F.array(F.lit("origin"), F.lit("overall"))).otherwise(F.array(F.lit("independent"), F.lit("overall")))
    rows = j.withColumn("track", F.explode(tracks)).withColumn("key", F.concat_ws("/", "track", F.col("claim_id").cast("string")))
    per = metrics.judged_metrics(sparse.top_k(rows, "key", "doc_id", None), "key").where("positives > 0")
    out = per.withColumn("track", F.substring_index("key", "/", 1)).groupBy("track")
    return out.agg(F.count("*").alias("queries"), *[F.round(F.avg(m), 6).alias(m) for m in ("mrr", "ndcg_at_5")])


def pairwise_accuracy(spark, d):
    return _rounded(metrics.pairwise_accuracy(_graded(spark, d)), "pairwise_accuracy")


def open_metrics(spark, d):
    gold = judgments(spark, d).where("grade > 0 and not is_origin").select(F.col("claim_id").alias("item_id"), "doc_id")
    out = metrics.open_metrics(gold, _runs(spark, d)["judged"], "item_id", "doc_id")
    return _rounded(out, "recall_at_10", "recall_at_50", "recall_at_100")


def rank_buckets(spark, d):
    gold = judgments(spark, d).where("grade > 0").select(F.col("claim_id").alias("item_id"), "doc_id")
    return metrics.rank_buckets(gold, _runs(spark, d)["judged"], "item_id", "doc_id")


def query_eligibility(spark, d):
    j = judgments(spark, d).groupBy("claim_id").agg(F.count_if(F.col("grade") > 0).alias("p"), F.countDistinct("grade").alias("g"))
    claims = table(spark, d, "benchmark").select(F.col("item_id").alias("claim_id"))
    j = claims.join(j, "claim_id", "left")
    return j.agg(F.count_if(F.expr("p is null")).alias("no_candidates"), F.count_if(F.expr("p = 0")).alias("no_positives"), F.count_if(F.expr("p > 0")).alias("eligible"), F.count_if(F.expr("g > 1")).alias("pairwise_evaluable"))


def failure_cases(spark, d):
    rows = _graded(spark, d)
    per = rows.groupBy("claim_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("grade"))).alias("top"),
        F.min(F.when(F.col("grade") > 0, F.col("rank"))).alias("first"),
        F.sort_array(F.collect_list(F.when(F.col("rank") <= 5, F.struct("rank", "doc_id", "grade")))).alias("top5"),
    )
    kinds = F.filter(F.array(F.when(F.col("top") == 0, "top1_not_relevant"), F.when(F.col("first") > 3, "late_first_positive"), F.when(F.col("first").isNull(), "no_positive")), lambda x: x.isNotNull())
    out = per.withColumn("failures", F.array_join(kinds, ",")).where("failures <> ''")
    return out.select("claim_id", "failures", F.array_join(F.transform("top5", lambda s: F.concat_ws(":", s["doc_id"].cast("string"), s["grade"].cast("string"))), " ").alias("top5"))


def _length_run(spark, d):
    """A third run: judged documents by their length."""
    rows = judgments(spark, d).join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return sparse.top_k(rows.select(F.col("claim_id").alias("item_id"), "doc_id", F.col("n_chars").cast("double").alias("score")), "item_id", "doc_id", 50)


def fusion_of_three(spark, d):
    runs = _runs(spark, d) | {"length": _length_run(spark, d)}
    out = fusion.fused(runs, "item_id", "doc_id")
    return _rounded(out, "fusion_score").select("item_id", "doc_id", "source_mask", "source_count", "fusion_score", "fusion_rank")


def sentence_fusion(spark, d):
    """Turns of a conversation by two runs; of equals the first in the text stands ahead."""
    runs = {"bm25": _pool_run(spark, d), "length": _turn_run(spark, d)}
    out = fusion.fused(runs, "query_id", "idx", k=10, by_rank_sum=False)
    return _rounded(out, "fusion_score").select("query_id", "idx", "source_mask", "fusion_score", "fusion_rank")


def cut_tracks(spark, d):
    """The fused order as a judged run, kept whole, and as an open one, cut at ten."""
    from lodestrata.operators import selection

    out = fusion.fused(_runs(spark, d), "item_id", "doc_id").select("item_id", "doc_id", "fusion_rank")
    rows = out.withColumn("track", F.explode(F.array(F.lit("judged"), F.lit("open"))))
    return selection.cut(rows, "track", "fusion_rank", 10).groupBy("track").agg(F.count("*").alias("n"), F.max("fusion_rank").alias("deepest"))


def run_comparison(spark, d):
    runs = {"judged": _runs(spark, d)["judged"], "length": _length_run(spark, d)}
    judged = judgments(spark, d).select(F.col("claim_id").alias("item_id"), "doc_id", "grade")
    positives = judgments(spark, d).where("grade > 0 and not is_origin").select(F.col("claim_id").alias("item_id"), "doc_id")
    return metrics.run_comparison(runs, judged, positives, "item_id", "doc_id")


def recall_audit(spark, d):
    gold = judgments(spark, d).where("grade > 0").select(F.col("claim_id").alias("item_id"), "doc_id")
    return metrics.recall_audit(gold, _runs(spark, d)["judged"], "item_id", "doc_id")


def recall_gaps(spark, d):
    """Positives that a run lacks, as two in five documents were never searched."""
    gold = judgments(spark, d).where("grade > 0").select(F.col("claim_id").alias("item_id"), "doc_id")
    reference = _runs(spark, d)["judged"]
    return metrics.recall_gaps(gold, reference.where("doc_id % 5 < 3"), reference, "item_id", "doc_id")


def stance_classification(spark, d):
    """Predicted stances against those of the judgments, in three classes."""
    from lodestrata.plans.graphs import _predictions

    gold = judgments(spark, d).select(F.col("doc_id").alias("input_id"), F.when(F.col("stance") > 0, "support").when(F.col("stance") < 0, "refute").otherwise("insufficient").alias("gold"))
    rows = _predictions(spark, d).select("input_id", F.col("label").alias("pred")).join(gold, "input_id")
    return _rounded(metrics.classification_summary(rows, ["support", "refute", "insufficient"]), "accuracy", "macro_f1", "balanced_accuracy")


def confusion_matrix(spark, d):
    rows = table(spark, d, "labels").select(F.col("quality").cast("string").alias("gold"), (1 - F.col("toxic")).cast("string").alias("pred"))
    return _rounded(metrics.confusion(rows, ["0", "1"]), "precision", "recall", "f1")


def _aspects(spark, d):
    """Aspects of a conversation: the first letters of all words of its turns; a turn covers the letters of its words."""
    turns = table(spark, d, "conversations").where("turn > 0")
    letters = F.explode(F.array_distinct(F.transform(F.split("text", " "), lambda w: F.lower(F.substring(w, 1, 1)))))
    return turns.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("idx"), letters.alias("aspect")).where("aspect rlike '^[a-z]$'")


def _pool_run(spark, d):
    items, queries = _pools(spark, d)
    run = sparse.top_k(sparse.pool_scores(items, queries, "conv_id", "turn"), "conv_id", "turn", None)
    return run.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("idx"), "rank", "score")


def _turn_run(spark, d):
    run = table(spark, d, "conversations").where("turn > 0").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("idx"), F.length("text").cast("double").alias("score"))
    return sparse.top_k(run, "query_id", "idx", None)


ASPECTS = f"""{POOL}, lk AS (SELECT DISTINCT conv_id AS query_id, turn AS idx, lower(substr(w, 1, 1)) AS aspect FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w FROM conversations WHERE turn > 0)),
links AS (SELECT * FROM lk WHERE regexp_matches(aspect, '^[a-z]$')),
run_a AS (SELECT conv_id AS query_id, turn AS idx, rank FROM pool),
run_b AS (SELECT conv_id AS query_id, turn AS idx, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS rank FROM conversations WHERE turn > 0)"""


def aspect_metrics(spark, d):
    return _rounded(metrics.aspect_metrics(_aspects(spark, d), _pool_run(spark, d), k=2), "aspect_recall", "precision", "mrr")


def run_complementarity(spark, d):
    return _rounded(metrics.complementarity(_pool_run(spark, d), _turn_run(spark, d), "query_id", "idx", (1, 2, 5)), "overlap", "union_size", "jaccard")


def paired_runs(spark, d):
    links = _aspects(spark, d)
    a, b = (metrics.aspect_metrics(links, run(spark, d), k=2) for run in (_pool_run, _turn_run))
    return _rounded(metrics.paired(a, b, "query_id", "aspect_recall"), "mean_delta")


def bootstrap_interval(spark, d):
    rows = table(spark, d, "labels").select((F.col("doc_id") % 50).alias("cluster"), (F.col("quality") - F.col("toxic")).cast("double").alias("delta"))
    return _rounded(metrics.bootstrap_interval(rows, "cluster", "delta", 5000), "low", "mean", "high", "share_positive")


def optimal_set_cover(spark, d):
    return metrics.set_cover(_aspects(spark, d))


QUERIES = [fusion_of_three, sentence_fusion, cut_tracks, run_comparison, recall_audit, recall_gaps, stance_classification, rrf_fusion, union_fusion, union_sizes, source_masks, union_ceiling, rerank_order, rerank_set_difference, score_direction, score_moments, judged_metrics, judged_metrics_by_track, pairwise_accuracy, open_metrics, rank_buckets, query_eligibility, failure_cases, confusion_matrix, aspect_metrics, run_complementarity, paired_runs, bootstrap_interval, optimal_set_cover]

_JM = """i AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY grade DESC, rank) AS ideal FROM g),
a AS (SELECT {k}, min(CASE WHEN grade > 0 THEN rank END) AS first_positive,
  {sums}, max(CASE WHEN rank = 1 THEN grade END) AS top1_grade, count(*) FILTER (WHERE grade > 0) AS positives,
  count(*) FILTER (WHERE grade > 0 AND rank <= 10) AS h10, count(*) FILTER (WHERE grade > 0 AND rank <= 50) AS h50 FROM i GROUP BY {k}),
jm AS (SELECT {k}, coalesce(1.0 / first_positive, 0) AS mrr, coalesce(dcg3 / nullif(idcg3, 0), 0) AS ndcg_at_3, coalesce(dcg5 / nullif(idcg5, 0), 0) AS ndcg_at_5, coalesce(dcg10 / nullif(idcg10, 0), 0) AS ndcg_at_10,
  top1_grade, h10 / nullif(positives, 0) AS recall_at_10, h50 / nullif(positives, 0) AS recall_at_50, positives FROM a)"""
_SUMS = ", ".join(f"sum(CASE WHEN {r} <= {k} THEN (pow(2.0, grade) - 1) / log2({r} + 1) ELSE 0 END) AS {n}{k}" for r, n in (("rank", "dcg"), ("ideal", "idcg")) for k in (3, 5, 10))
_ASPECT = """tot AS (SELECT query_id, count(DISTINCT aspect) AS aspects FROM links GROUP BY 1),
am_{r} AS (SELECT t.query_id, coalesce(c.covered, 0) / t.aspects AS aspect_recall, coalesce(p.good / nullif(p.shown, 0), 0) AS "precision", coalesce(1.0 / p.first, 0) AS mrr FROM tot t
  LEFT JOIN (SELECT query_id, count(DISTINCT aspect) AS covered FROM links JOIN run_{r} USING (query_id, idx) WHERE rank <= 2 GROUP BY 1) c USING (query_id)
  LEFT JOIN (SELECT query_id, count(*) FILTER (WHERE rank <= 2 AND u) AS good, count(*) FILTER (WHERE rank <= 2) AS shown, min(CASE WHEN u THEN rank END) AS first
             FROM (SELECT query_id, rank, (query_id, idx) IN (SELECT (query_id, idx) FROM links) AS u FROM run_{r}) GROUP BY 1) p USING (query_id))"""
_GOLD = "gold AS (SELECT DISTINCT claim_id AS item_id, doc_id FROM judgments WHERE grade > 0{0}), f AS (SELECT g.*, r.rank FROM gold g LEFT JOIN {1} r USING (item_id, doc_id))"

_LENGTH = "run_c AS (SELECT * FROM (SELECT claim_id AS item_id, j.doc_id, CAST(n_chars AS DOUBLE) AS score, row_number() OVER (PARTITION BY claim_id ORDER BY n_chars DESC, j.doc_id) AS rank FROM judgments j JOIN documents USING (doc_id)) WHERE rank <= 50)"
_COMPARED = """SELECT '{n}' AS run, x.*, pw.*, o.* FROM
  (SELECT round(avg(mrr), 8) AS mrr, round(avg(ndcg_at_5), 8) AS ndcg_at_5, round(avg((top1_grade > 0)::INT), 8) AS top1_positive_rate FROM (WITH g AS (SELECT claim_id, grade, row_number() OVER (PARTITION BY claim_id ORDER BY r.rank) AS rank FROM judgments j JOIN {r} r ON r.item_id = claim_id AND r.doc_id = j.doc_id), {jm} SELECT * FROM jm) WHERE positives > 0) x,
  (SELECT round(avg(p), 8) AS pairwise_accuracy FROM (SELECT l.claim_id, avg(CASE WHEN l.score = h.score THEN 0.5 WHEN (l.score > h.score) = (l.grade > h.grade) THEN 1.0 ELSE 0.0 END) AS p FROM (SELECT claim_id, j.doc_id, grade, score FROM judgments j JOIN {r} r ON r.item_id = claim_id AND r.doc_id = j.doc_id) l
     JOIN (SELECT claim_id, j.doc_id, grade, score FROM judgments j JOIN {r} r ON r.item_id = claim_id AND r.doc_id = j.doc_id) h ON l.claim_id = h.claim_id AND l.grade > h.grade GROUP BY 1)) pw,
  (SELECT round(avg(a), 8) AS recall_at_10, round(avg(b), 8) AS recall_at_50, round(avg(c), 8) AS recall_at_100, round(avg(h), 8) AS hit_at_100 FROM (SELECT claim_id, count(*) FILTER (WHERE rank <= 10) / count(*) AS a, count(*) FILTER (WHERE rank <= 50) / count(*) AS b, count(*) FILTER (WHERE rank <= 100) / count(*) AS c, max((coalesce(rank, 1000) <= 100)::INT) AS h
     FROM judgments j LEFT JOIN {r} r ON r.item_id = claim_id AND r.doc_id = j.doc_id WHERE grade > 0 AND NOT is_origin GROUP BY 1)) o"""
_RECALL = "f AS (SELECT claim_id, j.doc_id, rank FROM judgments j LEFT JOIN run_b r ON r.item_id = claim_id AND r.doc_id = j.doc_id WHERE grade > 0)"

ORACLE = {
    "fusion_of_three": f"""WITH {RUNS}, {_LENGTH}, f AS (SELECT item_id, doc_id, a.rank AS a, b.rank AS b, c.rank AS c FROM run_a a FULL OUTER JOIN run_b b USING (item_id, doc_id) FULL OUTER JOIN run_c c USING (item_id, doc_id)),
        g AS (SELECT *, coalesce(1.0::DOUBLE / (60 + a), 0.0::DOUBLE) + coalesce(1.0::DOUBLE / (60 + b), 0.0::DOUBLE) + coalesce(1.0::DOUBLE / (60 + c), 0.0::DOUBLE) AS s, (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT AS source_count,
          CAST((a IS NOT NULL)::INT + 2 * (b IS NOT NULL)::INT + 4 * (c IS NOT NULL)::INT AS BIGINT) AS source_mask, least(coalesce(a, 1000), coalesce(b, 1000), coalesce(c, 1000)) AS best, coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) AS rs FROM f)
        SELECT item_id, doc_id, source_mask, source_count, round(s, 6) AS fusion_score, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, source_count DESC, best, rs, doc_id) AS fusion_rank FROM g""",
    "sentence_fusion": f"""WITH {ASPECTS}, f AS (SELECT query_id, idx, a.rank AS a, b.rank AS b FROM run_a a FULL OUTER JOIN run_b b USING (query_id, idx)),
        g AS (SELECT *, coalesce(1.0::DOUBLE / (10 + a), 0.0::DOUBLE) + coalesce(1.0::DOUBLE / (10 + b), 0.0::DOUBLE) AS s, (a IS NOT NULL)::INT + (b IS NOT NULL)::INT AS n, CAST((a IS NOT NULL)::INT + 2 * (b IS NOT NULL)::INT AS BIGINT) AS source_mask FROM f)
        SELECT query_id, idx, source_mask, round(s, 6) AS fusion_score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, n DESC, least(coalesce(a, 1000), coalesce(b, 1000)), idx) AS fusion_rank FROM g""",
    "cut_tracks": f"WITH {RUNS} SELECT 'judged' AS track, count(*) AS n, max(fusion_rank) AS deepest FROM rrf UNION ALL SELECT 'open', count(*), max(fusion_rank) FROM rrf WHERE fusion_rank <= 10",
    "run_comparison": f"WITH {RUNS}, {_LENGTH} {_COMPARED.format(n='judged', r='run_b', jm=_JM.format(k='claim_id', sums=_SUMS))} UNION ALL {_COMPARED.format(n='length', r='run_c', jm=_JM.format(k='claim_id', sums=_SUMS))}",
    "recall_audit": f"""WITH {RUNS}, {_RECALL}, q AS (SELECT claim_id, count(*) FILTER (WHERE rank <= 10) / count(*) AS a, count(*) FILTER (WHERE rank <= 50) / count(*) AS b, count(*) FILTER (WHERE rank <= 100) / count(*) AS c FROM f GROUP BY 1),
        mm AS (SELECT round(avg(a), 8) AS recall_at_10, round(avg(b), 8) AS recall_at_50, round(avg(c), 8) AS recall_at_100 FROM q)
        SELECT *, recall_at_10 = recall_at_50 AND recall_at_50 = recall_at_100 AS recall_plateau, (SELECT count(*) FROM f WHERE rank > 10 AND rank <= 100) = 0 AS all_found_in_top10 FROM mm""",
    "recall_gaps": f"""WITH {RUNS}, s AS (SELECT DISTINCT item_id FROM run_b WHERE doc_id % 5 < 3), {_RECALL}, g AS (SELECT f.* FROM f WHERE claim_id IN (SELECT item_id FROM s)),
        n AS (SELECT count(DISTINCT claim_id) AS shared_queries, count(*) FILTER (WHERE rank IS NOT NULL AND doc_id % 5 >= 3) AS gained, count(*) FILTER (WHERE rank <= 10 AND doc_id % 5 >= 3) AS gained_top10, count(*) FILTER (WHERE rank > 10 AND rank <= 50 AND doc_id % 5 >= 3) AS gained_11_50, count(*) FILTER (WHERE rank > 50 AND doc_id % 5 >= 3) AS gained_later FROM g)
        SELECT *, round(gained_top10 / nullif(gained, 0), 8) AS top10_share, coalesce(gained_top10 / nullif(gained, 0) >= 0.9, false) AS looks_like_unprobed_lists FROM n""",
    "optimal_set_cover": f"""WITH {ASPECTS}, names AS (SELECT query_id, idx, row_number() OVER (PARTITION BY query_id ORDER BY idx) - 1 AS b FROM (SELECT DISTINCT query_id, idx FROM links)), m AS (SELECT query_id, aspect, bit_or((1::BIGINT << b)::BIGINT) AS mask FROM links JOIN names USING (query_id, idx) GROUP BY ALL),
        n AS (SELECT query_id, max(b) + 1 AS k FROM names GROUP BY 1), c AS (SELECT query_id, unnest(range(1, (1::BIGINT << k)::BIGINT)) AS chosen FROM n),
        g AS (SELECT query_id, chosen FROM c JOIN m USING (query_id) GROUP BY ALL HAVING bool_and(chosen & mask <> 0)) SELECT query_id, min(bit_count(chosen))::BIGINT AS optimal_items FROM g GROUP BY 1""",
    "rrf_fusion": f"WITH {RUNS} SELECT item_id, doc_id, source_mask, source_count, best_rank, rank_sum, bm25_rank, round(bm25_score, 6) AS bm25_score, judged_rank, judged_score, round(fusion_score, 6) AS fusion_score, fusion_rank FROM rrf",
    "union_fusion": f"""WITH {RUNS}, u AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY best_rank, source_count DESC, rank_sum, doc_id) AS r FROM m)
        SELECT item_id, doc_id, source_mask, best_rank, r AS fusion_rank, CAST(count(*) OVER (PARTITION BY item_id) - r + 1 AS DOUBLE) AS fusion_score FROM u""",
    "union_sizes": f"WITH {RUNS}, s AS (SELECT item_id, count(*) AS n FROM m GROUP BY 1) SELECT min(n) AS smallest, round(avg(n), 6) AS mean, max(n) AS largest FROM s",
    "source_masks": f"WITH {RUNS} SELECT source_mask, count(*) AS n FROM m GROUP BY 1",
    "union_ceiling": f"WITH {RUNS}, {_GOLD.format('', '(SELECT item_id, doc_id, fusion_rank AS rank FROM rrf)')}, q AS (SELECT item_id, count(*) FILTER (WHERE rank <= 1000) / count(*) AS r, max(CASE WHEN rank <= 1000 THEN 1 ELSE 0 END) AS h FROM f GROUP BY 1) SELECT count(*) AS queries, round(avg(r), 8) AS recall_at_1000, round(avg(h), 8) AS hit_at_1000 FROM q",
    "rerank_order": f"WITH {RUNS}, {CE} SELECT item_id, doc_id, fusion_rank, selected, round(ce_score, 6) AS ce_score, rerank_rank FROM reranked",
    "rerank_set_difference": f"WITH {RUNS}, {CE} SELECT count(*) FILTER (WHERE fusion_rank <= 10 AND rerank_rank <= 10) AS common, count(*) FILTER (WHERE fusion_rank <= 10 AND rerank_rank > 10) AS missing, count(*) FILTER (WHERE fusion_rank > 10 AND rerank_rank <= 10) AS added FROM reranked",
    "score_direction": f"""WITH {GRADED}, p AS (SELECT h.score AS hs, l.score AS ls FROM graded h JOIN graded l USING (claim_id) WHERE h.grade > l.grade)
        SELECT count(*) AS pairs, count(*) FILTER (WHERE hs > ls) AS correct, count(*) FILTER (WHERE hs = ls) AS ties, round(count(*) FILTER (WHERE hs > ls) / count(*), 6) AS accuracy FROM p""",
    "score_moments": f"""WITH {GRADED}, s AS (SELECT grade, count(*) AS n, avg(score) AS mean, stddev_pop(score) AS std, min(score) AS low, max(score) AS high FROM graded GROUP BY 1)
        SELECT grade, n, round(mean, 6) AS mean, round(std, 6) AS std, low, high, coalesce(mean > lag(mean) OVER (ORDER BY grade), true) AS rises FROM s""",
    "judged_metrics": f"WITH {GRADED}, g AS (SELECT * FROM graded), {_JM.format(k='claim_id', sums=_SUMS)} SELECT claim_id, top1_grade, positives, {', '.join(f'round({m}, 6) AS {m}' for m in JUDGED)} FROM jm",
    "judged_metrics_by_track": f"""WITH {JUDGMENTS}, t AS (SELECT 'overall' AS track, * FROM judgments UNION ALL SELECT CASE WHEN is_origin THEN 'origin' ELSE 'independent' END, * FROM judgments),
        g AS (SELECT *, row_number() OVER (PARTITION BY track, claim_id ORDER BY doc_id * 7919 % 13 DESC, doc_id) AS rank FROM t), {_JM.format(k='track, claim_id', sums=_SUMS)}
        SELECT track, count(*) AS queries, round(avg(mrr), 6) AS mrr, round(avg(ndcg_at_5), 6) AS ndcg_at_5 FROM jm WHERE positives > 0 GROUP BY 1""",
    "pairwise_accuracy": f"""WITH {GRADED} SELECT claim_id, round(avg(CASE WHEN l.score = r.score THEN 0.5 WHEN (l.score > r.score) = (l.grade > r.grade) THEN 1.0 ELSE 0.0 END), 6) AS pairwise_accuracy, count(*) AS pairs
        FROM graded l JOIN graded r USING (claim_id) WHERE l.rank < r.rank AND l.grade <> r.grade GROUP BY 1""",
    "open_metrics": f"""WITH {RUNS}, {_GOLD.format(' AND NOT is_origin', 'run_b')} SELECT item_id, count(*) AS positives, min(rank) AS first_positive_rank,
        {', '.join(f'round(count(*) FILTER (WHERE rank <= {k}) / count(*), 6) AS recall_at_{k}, max(CASE WHEN rank <= {k} THEN 1 ELSE 0 END) AS hit_at_{k}' for k in (10, 50, 100))} FROM f GROUP BY 1""",
    "rank_buckets": f"WITH {RUNS}, {_GOLD.format('', 'run_b')} SELECT CASE WHEN rank <= 10 THEN '001-010' WHEN rank <= 50 THEN '011-050' WHEN rank <= 100 THEN '051-100' ELSE 'missing' END AS bucket, count(*) AS n FROM f GROUP BY 1",
    "query_eligibility": f"""WITH {JUDGMENTS}, j AS (SELECT claim_id, count(*) FILTER (WHERE grade > 0) AS p, count(DISTINCT grade) AS g FROM judgments GROUP BY 1)
        SELECT count(*) FILTER (WHERE p IS NULL) AS no_candidates, count(*) FILTER (WHERE p = 0) AS no_positives, count(*) FILTER (WHERE p > 0) AS eligible, count(*) FILTER (WHERE g > 1) AS pairwise_evaluable
        FROM benchmark LEFT JOIN j ON claim_id = item_id""",
    "failure_cases": f"""WITH {GRADED}, p AS (SELECT claim_id, max(CASE WHEN rank = 1 THEN grade END) AS top, min(CASE WHEN grade > 0 THEN rank END) AS first,
        string_agg(doc_id || ':' || grade, ' ' ORDER BY rank) FILTER (WHERE rank <= 5) AS top5 FROM graded GROUP BY 1)
        SELECT claim_id, concat_ws(',', CASE WHEN top = 0 THEN 'top1_not_relevant' END, CASE WHEN first > 3 THEN 'late_first_positive' END, CASE WHEN first IS NULL THEN 'no_positive' END) AS failures, top5
        FROM p WHERE top = 0 OR first > 3 OR first IS NULL""",
    "confusion_matrix": """WITH c AS (SELECT unnest(['0', '1']) AS label), x AS (SELECT label, count(*) FILTER (WHERE CAST(quality AS VARCHAR) = label AND CAST(1 - toxic AS VARCHAR) = label) AS tp,
        count(*) FILTER (WHERE CAST(quality AS VARCHAR) <> label AND CAST(1 - toxic AS VARCHAR) = label) AS fp, count(*) FILTER (WHERE CAST(quality AS VARCHAR) = label AND CAST(1 - toxic AS VARCHAR) <> label) AS fn FROM c, labels GROUP BY 1),
        y AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM x)
        SELECT label, tp, fp, fn, round(p, 6) AS "precision", round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM y""",
    "aspect_metrics": f"""WITH {ASPECTS}, {_ASPECT.format(r='a')} SELECT query_id, round(aspect_recall, 6) AS aspect_recall, round("precision", 6) AS "precision", round(mrr, 6) AS mrr FROM am_a""",
    "run_complementarity": f"""WITH {ASPECTS}, b AS (SELECT query_id, idx, a.rank AS l, b.rank AS r FROM run_a a FULL OUTER JOIN run_b b USING (query_id, idx)), d AS (SELECT unnest([1, 2, 5]) AS depth),
        p AS (SELECT query_id, depth, count(*) FILTER (WHERE l <= depth AND r <= depth) AS o, count(*) FILTER (WHERE l <= depth OR r <= depth) AS u FROM b, d GROUP BY ALL)
        SELECT depth, round(avg(o), 6) AS overlap, round(avg(u), 6) AS union_size, round(avg(coalesce(o / nullif(u, 0), 1)), 6) AS jaccard FROM p GROUP BY 1""",
    "paired_runs": f"""WITH {ASPECTS}, {_ASPECT.format(r='a')}, {_ASPECT.format(r='b').split(chr(10), 1)[1]}
        SELECT count(*) AS queries, count(*) FILTER (WHERE b.aspect_recall > a.aspect_recall) AS wins, count(*) FILTER (WHERE b.aspect_recall = a.aspect_recall) AS ties, count(*) FILTER (WHERE b.aspect_recall < a.aspect_recall) AS losses,
        round(avg(b.aspect_recall - a.aspect_recall), 6) AS mean_delta FROM am_a a JOIN am_b b USING (query_id)""",
    "bootstrap_interval": """WITH c AS (SELECT doc_id % 50 AS cluster, sum(quality - toxic) AS s, count(*) AS n FROM labels GROUP BY 1), k AS (SELECT unnest(range(0, 5000)) AS sample),
        u AS (SELECT sample, s, n, CAST(('0x' || substr(md5('42:' || sample || ':' || cluster), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM c, k),
        t AS (SELECT sample, s, n, (u >= 0.36787944117144233::DOUBLE)::INT + (u >= 0.7357588823428847::DOUBLE)::INT + (u >= 0.9196986029286058::DOUBLE)::INT + (u >= 0.9810118431238462::DOUBLE)::INT
              + (u >= 0.9963401531726563::DOUBLE)::INT + (u >= 0.9994058151824183::DOUBLE)::INT + (u >= 0.9999167588507119::DOUBLE)::INT + (u >= 0.9999897508033253::DOUBLE)::INT AS t FROM u),
        m AS (SELECT sample, sum(t * s) / sum(t * n) AS m FROM t GROUP BY 1)
        SELECT round(quantile_cont(m, 0.025), 6) AS low, (SELECT round(avg(quality - toxic), 6) FROM labels) AS mean, round(quantile_cont(m, 0.975), 6) AS high, round(avg((m > 0)::INT), 6) AS share_positive FROM m""",
}
