"""Raw records held against manifests: exact joins, coverage, variants, canonical queries, and checks of raw tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import squeezed, text_hash
from lodestrata.operators.corpus import violations


def _fail(when: Column, what: str, key: Column, otherwise: Column) -> Column:
    message = F.concat(F.lit(f"{what}: "), F.coalesce(key.cast("string"), F.lit("null")))
    return F.when(when, F.raise_error(message).cast("string")).otherwise(otherwise.cast("string"))


def one_to_one(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """left joined with right on their keys as strings; a key without partner or with several is an error when rows are read.

    Columns of the right side that the left one has too are left out.
    """
    key = F.col("join_key")
    a = left.withColumn("join_key", F.col(left_key).cast("string")).withColumn("in_left", F.lit(True))
    b = right.select(F.col(right_key).cast("string").alias("join_key"), F.lit(True).alias("in_right"), *[c for c in right.columns if c not in left.columns])
    both = a.join(b, "join_key", "full_outer").withColumn("times", F.count("*").over(Window.partitionBy("join_key")))
    checked = _fail(F.col("in_left").isNull(), "not in the left table", key, _fail(F.col("in_right").isNull(), "not in the right table", key, _fail(F.col("times") > 1, "not one to one", key, key)))
    return both.withColumn("join_key", checked).where("join_key is not null").drop("join_key", "in_left", "in_right", "times")


def covered(rows: DataFrame, sides: list[tuple[DataFrame, str]]) -> DataFrame:
    """rows joined with each side on its key; a row that a side lacks is an error when it is read, so none is lost silently."""
    out = rows
    for side, key in sides:
        marked = side.dropDuplicates([key]).withColumn("in_side", F.lit(True))
        kind = rows.schema[key].dataType
        out = out.join(marked, key, "left").withColumn(key, _fail(F.col("in_side").isNull(), f"no row for {key}", F.col(key), F.col(key)).cast(kind)).drop("in_side")
    return out


def with_fallback(candidates: DataFrame, inputs: DataFrame, corpus: DataFrame, key: str, column: str) -> DataFrame:
    """candidates with the column as their inputs give it, or else the corpus; candidates that neither knows are left out."""
    own = inputs.select(key, F.col(column).alias("own"))
    other = corpus.select(key, F.col(column).alias("other"))
    out = candidates.join(own, key, "left").join(other, key, "left").where("own is not null or other is not null")
    return out.withColumn(column, F.coalesce("own", "other")).drop("own", "other")


def claim_variants(rows: DataFrame, keys: tuple[str, ...] = ("claim_id", "split_group", "split"), text: str = "text") -> DataFrame:
    """Distinct texts of each claim within its keys: (keys, text, text_hash, occurrence_count, text_rank, text_variant_count).

    Rank is by how often a text occurs, then its length, then itself; claim_id is the first key.
    """
    plain = rows.select(*keys, squeezed(F.col(text)).alias("text"), text_hash(F.col(text)).alias("text_hash"))
    found = plain.groupBy(*keys, "text_hash", "text").agg(F.count("*").alias("occurrence_count"))
    whole = Window.partitionBy(keys[0])
    order = whole.orderBy(F.desc("occurrence_count"), F.desc(F.length("text")), "text", *keys[1:])
    return found.withColumns({"text_rank": F.row_number().over(order), "text_variant_count": F.count("*").over(whole)})


def claims(rows: DataFrame, keys: tuple[str, ...] = ("claim_id", "split_group", "split"), text: str = "text") -> DataFrame:
    """One row a claim: the variant of rank 1."""
    return claim_variants(rows, keys, text).where("text_rank = 1").drop("text_rank")


def forbidden_columns(tables: dict[str, DataFrame], forbidden: set[str]) -> DataFrame:
    """(table, column): columns that a table should not hand on, as they would leak what is to be predicted. No data is read."""
    spark = next(iter(tables.values())).sparkSession
    found = [(name, column) for name, df in tables.items() for column in df.columns if column.lower() in forbidden]
    return spark.createDataFrame(found, "`table` string, `column` string")


def run_summary(result: Column) -> Column:
    """struct of what a list of runs shows of a result (JSON text): counts as numbers, missing ones 0, missing maps empty."""
    schema = "summary struct<total_claims:string, evidence_states:map<string,string>, gaps:map<string,string>, total_inference_steps:string, articles:string, evidence:string>"
    summary = F.from_json(result, schema)["summary"]
    number = lambda name: F.coalesce(summary[name].try_cast("double").cast("long"), F.lit(0).cast("long")).alias(name)
    none = F.create_map().cast("map<string,bigint>")
    counts = lambda name: F.coalesce(F.transform_values(summary[name], lambda _, v: v.try_cast("double").cast("long")), none).alias(name)
    return F.struct(number("total_claims"), counts("evidence_states"), counts("gaps"), number("total_inference_steps"), number("articles"), number("evidence"))


def parsed_sections(value: Column) -> Column:
    """array<struct<section, text>> from JSON text: an object of section to text, or a list of {section or name, text}; names in lower case, blank texts left out."""
    listed = F.transform(F.from_json(value, "array<struct<section:string,name:string,text:string>>"), lambda s: F.struct(F.lower(F.trim(F.coalesce(s["section"], s["name"], F.lit("")))).alias("section"), F.trim(F.coalesce(s["text"], F.lit(""))).alias("text")))
    mapped = F.transform(F.map_entries(F.from_json(value, "map<string,string>")), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("section"), F.trim(F.coalesce(e["value"], F.lit(""))).alias("text")))
    found = F.when(F.trim(value).startswith("["), listed).otherwise(mapped)
    return F.filter(F.coalesce(found, F.array().cast("array<struct<section:string,text:string>>")), lambda s: (s["section"] != "") & (s["text"] != ""))


#: Fields of an article that aren't metadata.
ARTICLE_FIELDS = ("article_id", "paper_id", "pmid", "title", "abstract", "text", "sections", "article_rank")


def coerced_articles(records: DataFrame, column: str = "record") -> DataFrame:
    """(article_id, title, abstract, sections, metadata, problem) of articles given as JSON text.

    The id is article_id, else paper_id, else pmid; the abstract is abstract, else text; what no field takes is metadata.
    """
    given = records.withColumn("m", F.from_json(column, "map<string,string>"))
    get = lambda name: F.try_element_at("m", F.lit(name))
    filled = lambda name: F.when(F.trim(get(name)) != "", F.trim(get(name)))
    known = F.array(*map(F.lit, ARTICLE_FIELDS))
    rows = given.select(
        *[c for c in records.columns if c != column],
        F.coalesce(*[filled(x) for x in ("article_id", "paper_id", "pmid")]).alias("article_id"),
        F.coalesce(F.trim(get("title")), F.lit("")).alias("title"),
        F.coalesce(filled("abstract"), filled("text")).alias("abstract"),
        parsed_sections(get("sections")).alias("sections"),
        F.map_filter("m", lambda k, _: ~F.array_contains(known, k)).alias("metadata"),
    )
    both = F.col("abstract").isNotNull() & (F.size("sections") > 0)
    problem = F.when(F.col("article_id").isNull(), "no id").when(both, "sections and abstract").when(F.col("abstract").isNull() & (F.size("sections") == 0) & (F.col("title") == ""), "no text")
    return rows.withColumn("problem", problem)


def key_types(df: DataFrame, column: str) -> DataFrame:
    """(key, type, n): the types that each top-level key of a column of JSON objects has."""
    parsed = df.select(F.parse_json(column).alias("v"))
    entries = parsed.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer()))
    return entries.groupBy("key", F.schema_of_variant("value").alias("type")).agg(F.count("*").alias("n"))


def key_signatures(df: DataFrame, column: str, most: int = 10) -> DataFrame:
    """(signature, n): the ``most`` most frequent sets of top-level keys of a column of JSON objects."""
    keys = F.array_join(F.array_sort(F.json_object_keys(column)), ",")
    return df.groupBy(keys.alias("signature")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "signature").limit(most)


def selected_manifest(manifest: DataFrame, split: str, limit: int | None = None) -> DataFrame:
    """The split's records of a manifest (position, query_id, dataset split columns, path, record_id), the first ``limit`` of them.

    A blank or repeated query_id, a record of another split, or one without a locator is an error when rows are read.
    """
    if split not in ("train", "dev", "test"):
        raise ValueError(f"no such split: {split}")
    if limit is not None and limit <= 0:
        raise ValueError("limit must be positive")
    q = F.col("query_id")
    again = F.count("*").over(Window.partitionBy("query_id")) > 1
    rows = manifest.withColumn("again", again)
    checked = _fail(F.coalesce(q, F.lit("")) == "", "no query_id", F.col("position"), _fail(F.col("again"), "query_id occurs twice", q, _fail(~F.col("split").eqNullSafe(F.lit(split)), "other split", q, _fail((F.coalesce("path", F.lit("")) == "") | F.col("record_id").isNull(), "no locator", q, q))))
    rows = rows.withColumn("query_id", checked).drop("again")
    return rows if limit is None else rows.orderBy("position").limit(limit)


def located(manifest: DataFrame, raw: DataFrame) -> DataFrame:
    """manifest with the raw records that its locators (path, record_id) name; one that names none is an error when it is read."""
    found = manifest.join(raw.withColumn("in_raw", F.lit(True)), ["path", "record_id"], "left")
    return found.withColumn("query_id", _fail(F.col("in_raw").isNull(), "no raw record", F.col("query_id"), F.col("query_id"))).drop("in_raw")


def provenance(selected: DataFrame) -> DataFrame:
    """(path, queries, fingerprint): of each raw file, how many queries were taken and a hash of their ids that doesn't depend on order."""
    return selected.groupBy("path").agg(F.count("*").alias("queries"), F.sum(F.conv(F.substring(F.sha2("query_id", 256), 1, 8), 16, 10).cast("long")).alias("fingerprint"))


def canonical_queries(records: DataFrame) -> DataFrame:
    """(query_id, candidates, coverable, unmapped, budget_source, problem) of raw queries.

    records: (query_id, candidates array<string>, types array<string>, aspects array<string>, forward map<string,
    array<int>> from aspect to sentences, reverse map<int, array<string>> from sentence to aspects, optimal int). An
    aspect that no sentence has stays visible as unmapped and doesn't count for metrics. The budget is the record's,
    or to be derived by exact set cover, or none if nothing can be covered.
    """
    n = F.size("candidates")
    pairs = lambda entries, one: F.array_sort(F.array_distinct(F.flatten(F.transform(entries, one))))
    there = pairs(F.map_entries("forward"), lambda e: F.transform(e["value"], lambda i: F.struct(i.alias("i"), e["key"].alias("a"))))
    back = pairs(F.map_entries("reverse"), lambda e: F.transform(e["value"], lambda a: F.struct(e["key"].alias("i"), a.alias("a"))))
    mapped = F.array_distinct(F.flatten(F.map_values("reverse")))
    outside = F.exists(F.flatten(F.map_values("forward")), lambda i: (i < 0) | (i >= n)) | F.exists(F.map_keys("reverse"), lambda i: (i < 0) | (i >= n))
    rows = records.withColumns({"there": there, "back": back, "mapped": mapped})
    problem = (
        F.when(n == 0, "no candidates")
        .when(n != F.size("types"), "types")
        .when(F.size(F.array_except("aspects", F.map_keys("forward"))) > 0, "aspect without mapping")
        .when(F.size(F.array_except(F.map_keys("forward"), "aspects")) > 0, "unknown aspect")
        .when(outside, "sentence outside the pool")
        .when(F.size(F.array_except("mapped", "aspects")) > 0, "unknown aspect of a sentence")
        .when(F.col("there") != F.col("back"), "mappings disagree")
        .when(F.col("optimal").isNotNull() & ((F.col("optimal") <= 0) | (F.col("optimal") > n)), "budget")
    )
    coverable = F.filter("aspects", lambda a: F.array_contains(F.col("mapped"), a))
    source = F.when(F.size(coverable) == 0, F.lit(None).cast("string")).when(F.col("optimal").isNull(), "derived").otherwise("given")
    out = rows.select("query_id", n.alias("n"), coverable.alias("coverable"), F.array_except("aspects", "mapped").alias("unmapped"), source.alias("budget_source"), problem.alias("problem"))
    return out.withColumnRenamed("n", "candidates")


def first_records(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(dataset, key, record): of each table its first row by its key, as JSON with keys in order: an example of its contract."""
    out = None
    for name, (df, key) in tables.items():
        one = df.orderBy(key).limit(1).select(F.lit(name).alias("dataset"), F.col(key).cast("string").alias("key"), F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("record"))
        out = one if out is None else out.union(one)
    return out


def raw_violations(name: str, df: DataFrame, required: list[str], label: str, domain: list[int], key: str) -> DataFrame:
    """(check, violations) of a raw table, read whole: required fields there and filled, labels whole numbers of the domain, keys unique."""
    missing = [c for c in required if c not in df.columns]
    checks = {f"{name}_missing_{c}": df.limit(1) for c in missing}
    number = F.col(label).try_cast("double")
    checks |= {f"{name}_null_{c}": df.where(F.col(c).isNull()) for c in required if c in df.columns}
    checks[f"{name}_label"] = df.where(number.isNull() | (number != F.floor(number)) | ~number.isin(*[float(x) for x in domain]))
    checks[f"{name}_key"] = df.groupBy(key).count().where("count > 1")
    return violations(checks)


def vector_violations(vectors: DataFrame, key: str, dim: int, rows: int | None = None) -> DataFrame:
    """(check, violations) of embeddings: their length, finite numbers, unique keys, none of length zero, and how many rows are missing or too many."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    found = {
        "length": vectors.where(F.col("embedding").isNull() | (F.size("embedding") != dim)),
        "finite": vectors.where(F.exists("embedding", bad)),
        "zero": vectors.where(F.forall("embedding", lambda x: x == 0)),
        "key": vectors.groupBy(key).count().where("count > 1 or " + key + " is null"),
    }
    out = violations(found)
    if rows is not None:
        out = out.union(vectors.agg(F.abs(F.count("*") - rows).alias("violations")).select(F.lit("rows").alias("check"), "violations"))
    return out


def stance_input_violations(inputs: DataFrame, tasks: list[str], kinds: list[str]) -> DataFrame:
    """(check, violations) of inputs to a stance model: (input_id, task, kind, claim, text, gold)."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return violations(
        {
            "input_id": inputs.groupBy("input_id").count().where("count > 1 or input_id is null"),
            "task": inputs.where(~F.coalesce(F.col("task").isin(*tasks), F.lit(False))),
            "kind": inputs.where(~F.coalesce(F.col("kind").isin(*kinds), F.lit(False))),
            "texts": inputs.where(blank("claim") | blank("text")),
            "gold": inputs.where("(kind = 'gold') <> (gold is not null)"),
        }
    )
