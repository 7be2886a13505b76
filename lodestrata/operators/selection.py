"""Choosing rows: pages, ranges, samples of whole groups, batches; and profiles of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def page(rows: DataFrame, time: str, key: str, limit: int, cursor: tuple | None = None) -> DataFrame:
    """Newest first: ``limit`` rows before the cursor (time, key), by keyset, so deep pages cost no more than the first."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be from 1 to 100")
    if cursor is not None:
        rows = rows.where((F.col(time) < F.lit(cursor[0])) | ((F.col(time) == F.lit(cursor[0])) & (F.col(key) < F.lit(cursor[1]))))
    return rows.orderBy(F.desc(time), F.desc(key)).limit(limit)


def first_groups(rows: DataFrame, group: str, n: int) -> DataFrame:
    """Rows of the first n groups in order of their id."""
    return rows.join(F.broadcast(rows.select(group).distinct().orderBy(group).limit(n)), group, "left_semi")


def sampled_groups(rows: DataFrame, group: str, n: int, seed: int) -> DataFrame:
    """Rows of n whole groups, in order of SHA-256(seed:group)."""
    chosen = rows.select(group).distinct().orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(group).cast("string")), 256), group).limit(n)
    return rows.join(F.broadcast(chosen), group, "left_semi")


def batched(rows: DataFrame, partition: str, order: str, size: int) -> DataFrame:
    """rows with batch: runs of ``size`` rows in order within a partition."""
    place = F.row_number().over(Window.partitionBy(partition).orderBy(order)) - 1
    return rows.withColumn("batch", F.floor(place / size))


def chosen_rows(rows: DataFrame, order: str, group: str, offset: int = 0, limit: int | None = None, group_offset: int = 0, group_limit: int | None = None) -> DataFrame:
    """Rows by their place in order, or the rows of groups by the place of their first row; both at once is an error."""
    if min(offset, group_offset) < 0 or any(x is not None and x <= 0 for x in (limit, group_limit)):
        raise ValueError("offsets can't be negative, limits must be positive")
    by_row, by_group = offset or limit is not None, group_offset or group_limit is not None
    if by_row and by_group:
        raise ValueError("choose rows or groups, not both")
    if by_row:
        out = rows.orderBy(order).offset(offset)
        return out if limit is None else out.limit(limit)
    if not by_group:
        return rows
    firsts = rows.groupBy(group).agg(F.min(order).alias("first_place")).orderBy("first_place").offset(group_offset)
    firsts = firsts if group_limit is None else firsts.limit(group_limit)
    return rows.join(firsts.select(group), group, "left_semi")


def cut(ranked: DataFrame, track: str, rank: str, k: int) -> DataFrame:
    """Rows of a judged track whole, of an open one the first k ranks only."""
    return ranked.where((F.col(track) == "judged") | (F.col(rank) <= k))


def profile(df: DataFrame) -> DataFrame:
    """(column, nulls, distinct) of every column. Each column's values are made distinct before they are shuffled, column by column, so a row isn't multiplied."""
    out = None
    for c in df.columns:
        values = df.groupBy(F.col(f"`{c}`").alias("v")).agg(F.count("*").alias("n"))
        one = values.agg(F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("nulls"), F.count("v").alias("distinct")).select(F.lit(c).alias("column"), "nulls", "distinct")
        out = one if out is None else out.union(one)
    return out


def json_keys(df: DataFrame, column: str) -> DataFrame:
    """(key, n): how often each top-level key occurs in a column of JSON objects."""
    return df.select(F.explode(F.json_object_keys(column)).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def cache_state(rows: DataFrame, group: str, cached: DataFrame, key: str) -> DataFrame:
    """(group, total, cached, state): complete, incomplete or uncached by how many of its rows have a cached answer."""
    marked = rows.select(group, key).join(cached.select(key).distinct().withColumn("c", F.lit(1)), key, "left")
    out = marked.groupBy(group).agg(F.count("*").alias("total"), F.count("c").alias("cached"))
    return out.withColumn("state", F.when(F.col("cached") == F.col("total"), "complete").when(F.col("cached") > 0, "incomplete").otherwise("uncached"))


def overlaps(df: DataFrame, value: str, split: str) -> DataFrame:
    """(value, splits): values that stand in more than one split."""
    return df.groupBy(value).agg(F.sort_array(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)
