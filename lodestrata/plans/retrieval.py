"""Queries over sparse and dense retrieval."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.operators import dense, sparse
from lodestrata.plans.roles import BM25, DENSE, JUDGMENTS, TOKEN_SQL, dense_queries, judgments, table


def flagship_bm25_top10(spark, d):
    hits = sparse.search(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return hits.select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def postings_summary(spark, d):
    terms = sparse.postings(table(spark, d, "documents"), "doc_id").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    return terms.select("term", "df", "cf")


def bm25_without_origins(spark, d):
    origins = judgments(spark, d).where("is_origin").select(F.col("claim_id").alias("item_id"), "doc_id")
    hits = sparse.search(table(spark, d, "documents"), table(spark, d, "benchmark"), 20, origins)
    return hits.select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def bm25_candidates(spark, d):
    pairs = judgments(spark, d).select(F.col("claim_id").alias("item_id"), "doc_id")
    out = sparse.score_candidates(table(spark, d, "documents"), table(spark, d, "benchmark"), pairs)
    return sparse.top_k(out, "item_id", "doc_id", None).select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def _pools(spark, d):
    turns = table(spark, d, "conversations")
    return turns.where("turn > 0").select("conv_id", "turn", "text"), turns.where("turn = 0").select("conv_id", "text")


def pool_bm25(spark, d):
    items, queries = _pools(spark, d)
    ranked = sparse.top_k(sparse.pool_scores(items, queries, "conv_id", "turn"), "conv_id", "turn", None)
    sizes = Window.partitionBy("conv_id")
    ranked = ranked.withColumn("depth", F.least(F.count("*").over(sizes), F.greatest(F.lit(5), F.lit(3))))
    return ranked.where("rank <= depth").select("conv_id", "turn", F.round("score", 6).alias("score"), "rank")


POOL = f"""items AS (SELECT conv_id, turn, {TOKEN_SQL} AS terms FROM conversations WHERE turn > 0),
pt AS (SELECT conv_id, count(*) AS n, avg(len(terms)) AS avgdl FROM items GROUP BY 1),
ptf AS (SELECT conv_id, turn, len(terms) AS dl, term, count(*) AS tf FROM items, unnest(terms) AS u(term) GROUP BY ALL),
pdf AS (SELECT conv_id, term, count(*) AS df FROM ptf GROUP BY ALL),
pq AS (SELECT conv_id, term, count(*) AS qtf FROM (SELECT conv_id, unnest({TOKEN_SQL}) AS term FROM conversations WHERE turn = 0) GROUP BY ALL),
ps AS (SELECT conv_id, turn, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.5 * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 9) AS score
       FROM ptf JOIN pq USING (conv_id, term) JOIN pdf USING (conv_id, term) JOIN pt USING (conv_id) GROUP BY ALL),
pool AS (SELECT conv_id, turn, coalesce(score, 0.0) AS score, row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(score, 0.0) DESC, turn) AS rank,
         count(*) OVER (PARTITION BY conv_id) AS size FROM items LEFT JOIN ps USING (conv_id, turn))"""


def dense_exact_top10(spark, d):
    hits = dense.exact_search(table(spark, d, "embeddings"), dense_queries(spark, d))
    return hits.select("query_id", "vec_id", F.round("score", 5).alias("score"), "rank")


def dense_candidates(spark, d):
    """Each query's vectors of its own label, all of them ranked."""
    out = dense.ranked_within(dense_queries(spark, d), table(spark, d, "embeddings"), "label")
    return out.select("query_id", "vec_id", F.round("score", 5).alias("score"), "rank")


def dense_without_origins(spark, d):
    """Exact search without the vectors of the query's own label and number parity: over-fetched, then filtered."""
    vectors, queries = table(spark, d, "embeddings"), dense_queries(spark, d)
    origins = queries.join(vectors.select("vec_id", "label"), F.col("label") == F.col("query_label")).where("vec_id % 2 = query_id % 2").select("query_id", "vec_id")
    hits = dense.exact_search(vectors, queries, 10, exclude=origins)
    return hits.select("query_id", "vec_id", F.round("score", 5).alias("score"), "rank")


def single_query_search(spark, d):
    """One query's vector against inverted lists, all of them probed, with the hits' own ids."""
    vectors = table(spark, d, "embeddings")
    one = vectors.where("vec_id = 7").select(F.lit(0).cast("long").alias("query_id"), "embedding")
    hits = dense.list_search(vectors, one, 15, lists=4, probes=4)
    named = hits.join(vectors.select("vec_id", "label"), "vec_id")
    return named.select("rank", F.concat(F.lit("article:"), "vec_id").alias("article_id"), "label", F.round("score", 5).alias("score"))


def dense_lists_recall(spark, d, half=False):
    """Recall at 10 of inverted-list search against exact search, by query."""
    vectors, queries = table(spark, d, "embeddings"), dense_queries(spark, d)
    exact = dense.exact_search(vectors, queries).select("query_id", "vec_id")
    near = dense.list_search(vectors, queries, half=half).select("query_id", "vec_id", F.lit(1).alias("hit"))
    return exact.join(near, ["query_id", "vec_id"], "left").groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall_at_10"))


def dense_half_lists_recall(spark, d):
    """The same with vectors in half precision."""
    return dense_lists_recall(spark, d, True)


QUERIES = [flagship_bm25_top10, postings_summary, bm25_without_origins, bm25_candidates, pool_bm25, dense_exact_top10, dense_candidates, dense_without_origins, single_query_search, dense_lists_recall, dense_half_lists_recall]

ORACLE = {
    "flagship_bm25_top10": f"""WITH {BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM bm25)
        SELECT item_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10""",
    "postings_summary": f"""WITH tok AS (SELECT doc_id, unnest({TOKEN_SQL}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL)
        SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY term""",
    "bm25_without_origins": f"""WITH {BM25}, {JUDGMENTS}, r AS (
        SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM bm25 b
        WHERE NOT EXISTS (SELECT 1 FROM judgments j WHERE j.is_origin AND j.claim_id = b.item_id AND j.doc_id = b.doc_id))
        SELECT item_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 20""",
    "bm25_candidates": f"""WITH {BM25}, {JUDGMENTS}, c AS (
        SELECT claim_id AS item_id, j.doc_id, coalesce(score, 0.0) AS score FROM judgments j LEFT JOIN bm25 b ON b.item_id = j.claim_id AND b.doc_id = j.doc_id)
        SELECT item_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM c""",
    "pool_bm25": f"""WITH {POOL} SELECT conv_id, turn, round(score, 6) AS score, rank FROM pool WHERE rank <= least(size, 5)""",
    "dense_exact_top10": f"""WITH {DENSE}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM dense)
        SELECT query_id, vec_id, round(score, 5) AS score, rank FROM r WHERE rank <= 10""",
    "single_query_search": """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 7), s AS (SELECT vec_id, label, round(list_sum(list_transform(list_zip(e, embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 9) AS score FROM embeddings, q),
        r AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM s) SELECT rank, 'article:' || vec_id AS article_id, label, round(score, 5) AS score FROM r WHERE rank <= 15""",
    "dense_without_origins": f"""WITH {DENSE}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM dense WHERE NOT (label = query_label AND vec_id % 2 = query_id % 2))
        SELECT query_id, vec_id, round(score, 5) AS score, rank FROM r WHERE rank <= 10""",
    "dense_candidates": f"""WITH {DENSE} SELECT query_id, vec_id, round(score, 5) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
        FROM dense WHERE label = query_label AND vec_id <> query_id""",
}
