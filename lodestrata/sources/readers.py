"""Scans: Parquet and JSON by name, CSV of unknown dialect, TREC runs, and articles in any of these."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TREC = r"^(\S+)\s+(\S+)\s+(\S+)\s+(\d+)\s+(\S+)\s+(\S+)$"


def parquet_by_name(spark: SparkSession, *paths: str) -> DataFrame:
    """Several Parquet tables as one; a column that some lack is null there."""
    return spark.read.option("mergeSchema", True).parquet(*paths)


def json_by_name(spark: SparkSession, paths: list[str], schema: str | None = None, limit: int | None = None) -> DataFrame:
    """Line-delimited JSON, gzip too; give the schema to spare a pass over the data."""
    reader = spark.read.schema(schema) if schema else spark.read
    out = reader.json(paths)
    return out if limit is None else out.limit(limit)


def sniff_csv(spark: SparkSession, path: str, delimiters: str = ",;\t", head: int = 500) -> tuple[str, str, bool]:
    """(encoding, delimiter, whether quoted fields hold line ends) of a CSV file.

    The encoding is UTF-8 if every line of the file is valid in it, else ISO-8859-1, in which every byte is a character;
    a job reads all lines for that, as bytes. The delimiter is guessed from the first ``head`` lines.
    """
    lines = spark.read.text(path)
    facts = lines.agg(F.bool_and(F.is_valid_utf8("value")).alias("valid"), F.bool_or(F.expr("(octet_length(value) - octet_length(replace(value, '\"', ''))) % 2 = 1")).alias("torn")).first()
    encoding = "UTF-8" if facts["valid"] is not False else "ISO-8859-1"
    text = "\n".join(bytes(r[0]).decode(encoding.lower(), "replace") for r in lines.select(F.col("value").cast("binary")).limit(head).collect())
    try:
        delimiter = csv.Sniffer().sniff(text, delimiters).delimiter
    except csv.Error:
        delimiter = ","
    return encoding, delimiter, bool(facts["torn"])


def csv_any(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file of unknown encoding and delimiter. Only a file with line ends in quoted fields is read whole by one task."""
    encoding, delimiter, torn = sniff_csv(spark, path)
    out = spark.read.csv(path, header=True, sep=delimiter, encoding=encoding, multiLine=torn, escape='"')
    return out.withColumnsRenamed({c: c.removeprefix("\ufeff") for c in out.columns if c.startswith("\ufeff")})


def union_csv(spark: SparkSession, paths: list[str], required: list[str], label: str, domain: list[str]) -> DataFrame:
    """CSV files as one; a missing column is an error now, a label outside its domain an error when the row is read."""
    out = None
    for path in paths:
        one = csv_any(spark, path)
        if missing := sorted(set(required) - set(one.columns)):
            raise ValueError(f"{path} lacks {missing}")
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    checked = F.when(F.col(label).isin(domain), F.col(label)).otherwise(F.raise_error(F.concat(F.lit("label outside its domain: "), F.coalesce(F.col(label), F.lit("null")))).cast("string"))
    return out.withColumn(label, checked)


def trec_run(spark: SparkSession, path: str) -> DataFrame:
    """(query, document, rank, score, run) of a TREC run file; a line of another form is an error."""
    part = lambda k: F.regexp_extract("value", TREC, k)
    lines = spark.read.text(path).where("trim(value) <> ''")
    good = F.when(F.col("value").rlike(TREC), part(1)).otherwise(F.raise_error(F.concat(F.lit("not a TREC line: "), F.col("value"))).cast("string"))
    return lines.select(good.alias("query"), part(3).alias("document"), part(4).cast("int").alias("rank"), part(5).cast("double").alias("score"), part(6).alias("run"))


def run_violations(run: DataFrame) -> DataFrame:
    """(query, problem): queries whose ranks aren't 1..n or that name a document twice."""
    per = run.groupBy("query").agg(F.count("*").alias("n"), F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.countDistinct("rank").alias("u"), F.countDistinct("document").alias("d"))
    problem = F.when((F.col("lo") != 1) | (F.col("hi") != F.col("n")) | (F.col("u") != F.col("n")), "ranks").when(F.col("d") != F.col("n"), "documents")
    return per.select("query", problem.alias("problem")).where("problem is not null")


def load_articles(spark: SparkSession, path: str) -> DataFrame:
    """Articles from .parquet, .jsonl or .json with their ids settled: article_id, else paper_id, else pmid; an id that occurs twice is an error."""
    rows = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.option("multiLine", path.endswith(".json")).json(path)
    have = [c for c in ("article_id", "paper_id", "pmid") if c in rows.columns]
    text = [c for c in ("abstract", "text") if c in rows.columns]
    out = rows.select(F.coalesce(*[F.col(c).cast("string") for c in have]).alias("article_id"), F.col("title") if "title" in rows.columns else F.lit(None).cast("string").alias("title"), F.coalesce(*text).alias("abstract"))
    twice = F.count("*").over(Window.partitionBy("article_id")) > 1
    return out.withColumn("article_id", F.when(twice, F.raise_error(F.concat(F.lit("id occurs twice: "), "article_id")).cast("string")).otherwise(F.col("article_id")))


def split_rows(df: DataFrame, split: str, order: str, *columns: str, split_col: str = "split") -> DataFrame:
    """One split's rows in order of a key; the split and the columns reach the Parquet scan."""
    return df.where(F.col(split_col) == split).select(*(columns or df.columns)).orderBy(order)


def with_locators(df: DataFrame) -> DataFrame:
    """df, as read from files, with path and row_in_file: where each row physically stands."""
    return df.select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row_in_file"))


def with_places(df: DataFrame) -> DataFrame:
    """df, as read from files, with path, row_in_file and row_in_table: files in order of their paths, rows as they stand in them.

    Rows are counted by file; only these counts, a row for each file, are put in order in one place.
    """
    found = with_locators(df)
    path = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))
    before = F.coalesce(F.sum("n").over(Window.orderBy(path).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = found.groupBy("path").agg((F.max("row_in_file") + 1).alias("n")).select("path", before.alias("before"))
    return found.join(F.broadcast(files), "path").withColumn("row_in_table", F.col("before") + F.col("row_in_file")).drop("before")


def combined_shards(spark: SparkSession, paths: list[str], key: str, expected: DataFrame | None = None) -> DataFrame:
    """Shards of one table put together; a key in several shards is an error, as is one that isn't expected or is missing, when rows are read."""
    out = None
    for k, path in enumerate(paths):
        one = spark.read.parquet(path).withColumn("shard_no", F.lit(k))
        out = one if out is None else out.unionByName(one)
    twice = F.min("shard_no").over(Window.partitionBy(key)) < F.max("shard_no").over(Window.partitionBy(key))
    out = out.withColumn("in_several", twice)
    fail = lambda when, what, otherwise: F.when(when, F.raise_error(F.concat(F.lit(f"{what}: "), F.col(key).cast("string"))).cast("boolean")).otherwise(otherwise)
    good = fail(F.col("in_several"), "in several shards", F.lit(True))
    if expected is not None:
        out = out.join(expected.select(key).distinct().withColumn("wanted", F.lit(True)), key, "full_outer")
        good = fail(F.col("wanted").isNull(), "not expected", fail(F.col("shard_no").isNull(), "missing", good))
    return out.where(good).drop("shard_no", "in_several", "wanted")


def key_range(df: DataFrame, key: str, low: int, high: int, *columns: str) -> DataFrame:
    """Rows with low <= key < high; both bounds and the columns reach the Parquet scan."""
    return df.where((F.col(key) >= low) & (F.col(key) < high)).select(*(columns or df.columns))
