"""Raw records brought into shape, prompt inputs, and checks of structured answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def json_object_entries(spark: SparkSession, path: str, keys: list[str] | None = None) -> DataFrame:
    """(key, value): entries of files that hold one JSON object each; values that aren't text stay JSON.

    With keys the reader's parser walks the file and builds these entries alone, skipping the others as it meets them;
    entries that are null are left out. Without keys a file is read as one text.
    """
    if keys is None:
        return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))
    wanted = StructType([StructField(k, StringType()) for k in keys])
    rows = spark.read.schema(wanted).option("multiLine", True).json(path)
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"`{k}`").alias("value")) for k in keys])
    return rows.select(F.inline(pairs)).where("value is not null")


def json_array_records(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    """Records of files that hold one JSON array of objects each, a row a record, with the schema's fields alone."""
    out = spark.read.schema(schema).option("multiLine", True).json(path)
    return out if limit is None else out.limit(limit)


def nested_passages(records: DataFrame, passages: str, key: str) -> DataFrame:
    """Passages nested in records, one row each, a passage found in several records once."""
    return records.select(F.explode(passages).alias("p")).select("p.*").dropDuplicates([key])


def integral_label(value: Column, low: int, high: int) -> Column:
    """A whole number in its domain, from text or number ('2', '2.0'); anything else is an error."""
    number = value.try_cast("double")
    good = number.isNotNull() & (number == F.floor(number)) & number.between(low, high)
    return F.when(good, number.cast("int")).otherwise(F.raise_error(F.concat(F.lit("not a label: "), F.coalesce(value.cast("string"), F.lit("null")))).cast("int"))


def aspect_map(value: Column) -> Column:
    """map<string, array<string>> to map<string, array<int>>: numbers parsed, repeats dropped, the first place kept."""
    return F.transform_values(value, lambda _, v: F.array_distinct(F.transform(v, lambda x: x.cast("int"))))


def asymmetric_links(forward: DataFrame, reverse: DataFrame) -> DataFrame:
    """(query, aspect, item, missing_in) of links that one of two mappings lacks."""
    keys = ["query", "aspect", "item"]
    a, b = forward.select(*keys).distinct().withColumn("a", F.lit(1)), reverse.select(*keys).distinct().withColumn("b", F.lit(1))
    both = a.join(b, keys, "full_outer").where("a is null or b is null")
    return both.select(*keys, F.when(F.col("a").isNull(), "forward").otherwise("reverse").alias("missing_in"))


def prompt_inputs(sentences: DataFrame, group: str, order: str) -> DataFrame:
    """Sentences with the aliases S01, S02, ... that a prompt names them by."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return sentences.withColumn("alias", F.format_string("S%02d", place))


def resolved_citations(answers: DataFrame, inputs: DataFrame, group: str) -> DataFrame:
    """(group, position, alias, known, ...): an answer's aliases with the sentences they name; known is false for one that names none."""
    cited = answers.select(group, F.posexplode("citations").alias("position", "alias"))
    return cited.join(inputs.withColumn("known", F.lit(True)), [group, "alias"], "left").withColumn("known", F.coalesce("known", F.lit(False)))


def citation_problem(label: Column, citations: Column, most: int = 5) -> Column:
    """What is wrong with an answer's citations, or null: too many, repeated, or some exactly where none should be."""
    n = F.size(citations)
    return F.when(n > most, "too many").when(F.size(F.array_distinct(citations)) < n, "repeated").when((label == "insufficient") != (n == 0), "presence")


def applicability_problem(statuses: Column, issues: Column, dimensions: list[str], domain: list[str]) -> Column:
    """What is wrong with an applicability record, or null: dimensions, statuses, or issues that aren't just the mismatches."""
    wanted = F.array(*map(F.lit, dimensions))
    keys = F.map_keys(statuses)
    mismatched = F.map_keys(F.map_filter(statuses, lambda _, v: v == "MISMATCH"))
    return (
        F.when((F.size(F.array_except(wanted, keys)) > 0) | (F.size(F.array_except(keys, wanted)) > 0), "dimensions")
        .when(F.exists(F.map_values(statuses), lambda v: ~v.isin(domain)), "statuses")
        .when((F.size(F.array_except(issues, mismatched)) > 0) | (F.size(F.array_except(mismatched, issues)) > 0), "issues")
    )


def gap_problem(detected: Column, fields: list[Column]) -> Column:
    """All of a gap's fields are set if it was detected, none if not; else a word for what is wrong."""
    set_ = F.lit(0)
    for f in fields:
        set_ = set_ + f.isNotNull().cast("int")
    return F.when(detected & (set_ < len(fields)), "missing fields").when(~detected & (set_ > 0), "stray fields")


def translation_units(parts: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """(text_id, text) of all texts to translate; parts: name -> (rows, key, text). Null texts have no unit."""
    out = None
    for name, (rows, key, text) in parts.items():
        one = rows.select(F.concat(F.lit(f"{name}:"), F.col(key).cast("string")).alias("text_id"), F.col(text).alias("text")).where("text is not null")
        out = one if out is None else out.union(one)
    return out


def translated(rows: DataFrame, name: str, key: str, text: str, translations: DataFrame) -> DataFrame:
    """rows with their texts replaced by translations (text_id, text); a unit without one is an error."""
    ids = rows.withColumn("text_id", F.concat(F.lit(f"{name}:"), F.col(key).cast("string")))
    out = ids.join(translations.select("text_id", F.col("text").alias("__new")), "text_id", "left")
    new = F.when(F.col(text).isNull(), F.lit(None).cast("string")).when(F.col("__new").isNull(), F.raise_error(F.concat(F.lit("not translated: "), F.col("text_id"))).cast("string")).otherwise(F.col("__new"))
    return out.withColumn(text, new).drop("text_id", "__new")


def first_mismatch(run: DataFrame, again: DataFrame, query_key: str, doc_key: str) -> DataFrame:
    """(query, first_mismatch_rank): the first rank at which two runs name different documents, null if they agree."""
    a, b = run.select(query_key, "rank", F.col(doc_key).alias("a")), again.select(query_key, "rank", F.col(doc_key).alias("b"))
    both = a.join(b, [query_key, "rank"], "full_outer")
    return both.groupBy(query_key).agg(F.min(F.when(~F.col("a").eqNullSafe(F.col("b")), F.col("rank"))).alias("first_mismatch_rank"))


def capped_direction(scored: DataFrame, query_key: str, item_key: str, most: int = 5000) -> DataFrame:
    """Per query: share of its first ``most`` pairs of a gold and another item, gold by gold, in which the gold scores strictly more.

    The cap is the measure's own definition. Others are counted as far as a query's pairs can reach, so no more rows are made.
    """
    place = Window.partitionBy(query_key, "gold").orderBy(item_key)
    rows = scored.withColumn("k", F.row_number().over(place) - 1)
    others = rows.where("not gold")
    sizes = others.groupBy(query_key).agg(F.count("*").alias("m"))
    gold = rows.where("gold").join(sizes, query_key).where(F.col("k") * F.col("m") < most)
    pairs = gold.select(query_key, "m", F.col("k").alias("g"), F.col("score").alias("s")).join(others.select(query_key, F.col("k").alias("o"), F.col("score").alias("t")).where(F.col("o") < most), query_key)
    pairs = pairs.where(F.col("g") * F.col("m") + F.col("o") < most)
    return pairs.groupBy(query_key).agg(F.count("*").alias("pairs"), F.avg((F.col("s") > F.col("t")).cast("double")).alias("accuracy"))


def cached_usage(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """One row: requests answered from the cache by their hash, those missing, and the tokens the answers took."""
    out = requests.select("request_hash").join(cache.select("request_hash", "input_tokens", "output_tokens"), "request_hash", "left")
    return out.agg(F.count("input_tokens").alias("completed"), F.count_if(F.col("input_tokens").isNull()).alias("missing"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"))


def presentation_claims(claims: DataFrame, roles: DataFrame, audits: DataFrame, steps: DataFrame) -> DataFrame:
    """Claims with role and integrity, and the steps into and out of them as arrays of ids."""
    into = steps.groupBy(F.col("conclusion").alias("claim_id")).agg(F.sort_array(F.collect_list("step_id")).alias("incoming_step_ids"))
    out_of = steps.select("step_id", F.explode(F.array_distinct("premises")).alias("claim_id")).groupBy("claim_id").agg(F.sort_array(F.collect_list("step_id")).alias("outgoing_step_ids"))
    none = F.array().cast("array<bigint>")
    out = claims.join(roles, "claim_id").join(audits, "claim_id").join(into, "claim_id", "left").join(out_of, "claim_id", "left")
    return out.withColumns({c: F.coalesce(c, none) for c in ("incoming_step_ids", "outgoing_step_ids")})
