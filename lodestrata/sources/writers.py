"""Sinks: sorted Parquet, TREC runs, JSON lines, and a manifest of what was written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, sort: list[str] | None = None, partition: list[str] | None = None, force: bool = False) -> None:
    """Parquet with zstd, rows sorted within files; an existing folder is an error unless forced."""
    out = df.sortWithinPartitions(*sort) if sort else df
    writer = out.write.option("compression", "zstd").mode("overwrite" if force else "errorifexists")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def conformed(df: DataFrame, schema: str) -> DataFrame:
    """df in the columns, order and types of a schema; a missing or stray column is an error now, a value that doesn't fit when it is read."""
    from pyspark.sql.types import StructType

    wanted = StructType.fromDDL(schema)
    if set(wanted.names) != set(df.columns):
        raise ValueError(f"columns {sorted(df.columns)} instead of {sorted(wanted.names)}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted])


def write_sharded(df: DataFrame, path: str, key: str, shards: int) -> None:
    """Parquet in hash shards that keep a key's rows together."""
    df.repartition(shards, key).sortWithinPartitions(key).write.option("compression", "zstd").parquet(path)


def trec_line(query: Column, document: Column, rank: Column, score: Column, run: str, digits: int = 10) -> Column:
    return F.format_string(f"%s Q0 %s %d %.{digits}f %s", query.cast("string"), document.cast("string"), rank.cast("int"), score.cast("double"), F.lit(run))


def write_trec(run: DataFrame, path: str, name: str, query: str = "query", document: str = "document", digits: int = 10) -> None:
    """A TREC run, queries in order, each query's ranks in order."""
    spread = run.repartitionByRange(query).sortWithinPartitions(query, "rank")
    spread.select(trec_line(F.col(query), F.col(document), F.col("rank"), F.col("score"), name, digits)).write.text(path)


def json_line(df: DataFrame) -> Column:
    """A row as JSON with its keys in order; nulls are written."""
    return F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})


def write_json_lines(df: DataFrame, path: str) -> None:
    df.select(json_line(df)).write.text(path)


def manifest(df: DataFrame) -> DataFrame:
    """One row: how many rows, and a hash of the content that doesn't depend on their order."""
    columns = sorted(df.columns)
    return df.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("string").alias("content_hash"))
