"""Connected components of a link table by alternating large-star and small-star steps, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import discard, stored


def connected_components(links: DataFrame) -> DataFrame:
    """(a, b) links between comparable node ids -> (node, component), component being the smallest node reached.

    Nodes without a link are absent. Every round is written to the shared folder, so a lost executor costs one
    round at most. Neighbour minima are pre-aggregated; nothing is collected except two numbers a round. A star's
    centre may be a hot key; the minima are written too, so that both sides of their join are plain shuffles, which
    adaptive execution splits. Rounds go on until nothing changes, which takes some logarithm of the nodes.
    """
    spark = links.sparkSession
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    edges, path = stored(edges, "links")
    before = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, least_path = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large, large_path = stored(both.where("v > u").join(least, "u").select("v", F.col("m").alias("u")).where("u <> v").distinct(), "large")
        low, low_path = stored(large.groupBy("v").agg(F.min("u").alias("m")), "low")
        small = (
            large.join(low, "v")
            .select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct("v", F.col("m").alias("u")))).alias("e"))
            .select("e.v", "e.u")
            .where("u <> v")
            .distinct()
        )
        new, new_path = stored(small, "links")
        after = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        discard(spark, path, least_path, large_path, low_path)
        edges, path = new, new_path
        if tuple(after) == before:
            break
        before = tuple(after)
    roots = edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).union(roots)


def one_of_each(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows of docs with one document left of each class: the one of the smallest doc_id.

    classes: (doc_id, t, component_id), a row for each row of docs, t being xxhash64 of the text. Of rows that repeat a
    doc_id one is kept, that of the least text. Of a class in which no row has a doc_id, one row is kept. Columns of
    docs may have any names.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    held = docs.select(F.col("doc_id").alias("i"), F.xxhash64("text").alias("t"), F.col("text").alias("x"), row.alias("row"))
    first = classes.where("doc_id = component_id").select(F.col("doc_id").alias("i")).distinct()
    named = held.where("i is not null").join(first, "i", "left_semi")
    named = named.withColumn("k", F.row_number().over(Window.partitionBy("i").orderBy("x"))).where("k = 1").select("row.*")
    lone = classes.where("component_id is null").groupBy("class").agg(F.min("t").alias("t")).select("t")
    if not lone.head(1):
        return named
    kept = held.where("i is null").join(lone, "t", "left_semi")
    kept = kept.withColumn("k", F.row_number().over(Window.partitionBy("t").orderBy("x"))).where("k = 1").select("row.*")
    return named.union(kept)
