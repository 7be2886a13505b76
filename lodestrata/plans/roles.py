"""The roles that the test tables play: claims, judgments, corpora, runs. As DataFrames, and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(claim_id, doc_id, grade, stance, is_origin) from the labels."""
    claims = table(spark, sf_dir, "benchmark").count()
    grade = F.col("quality") + (1 - F.col("toxic")) * F.col("quality")
    return table(spark, sf_dir, "labels").select(
        (F.col("doc_id") % claims).alias("claim_id"),
        "doc_id",
        grade.cast("int").alias("grade"),
        F.when(F.col("toxic") == 1, -grade).otherwise(grade).cast("int").alias("stance"),
        (F.col("doc_id") % 7 == 0).alias("is_origin"),
    )


JUDGMENTS = """judgments AS (
  SELECT doc_id % (SELECT count(*) FROM benchmark) AS claim_id, doc_id,
         CAST(quality + (1 - toxic) * quality AS INTEGER) AS grade,
         CAST(CASE WHEN toxic = 1 THEN -(quality + (1 - toxic) * quality) ELSE quality + (1 - toxic) * quality END AS INTEGER) AS stance,
         doc_id % 7 = 0 AS is_origin
  FROM labels)"""

TOKEN_SQL = r"regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+(?:[-/][\p{L}\p{M}\p{N}_]+)*')"

BM25 = f"""tok AS (SELECT doc_id, unnest({TOKEN_SQL}) AS term FROM documents),
dl AS (SELECT doc_id, len({TOKEN_SQL}) AS dl FROM documents),
tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
qt AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({TOKEN_SQL}) AS term FROM benchmark) GROUP BY ALL),
bm25 AS (SELECT item_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 9) AS score
         FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id), tot GROUP BY ALL)"""


def dense_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("query_label"))


DENSE = """dense AS (
  SELECT q.vec_id AS query_id, v.vec_id, round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 9) AS score,
         q.label AS query_label, v.label
  FROM embeddings q JOIN embeddings v ON q.vec_id % 25 = 0)"""
