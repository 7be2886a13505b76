"""Queries over raw records, prompt inputs and checks of structured answers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.operators import argument, contracts
from lodestrata.plans.graphs import STEPS, _claims_steps
from lodestrata.plans.roles import table
from lodestrata.storage import new_path


def json_object_entries(spark, d):
    """The items as one JSON object by id, written, and seven of its entries read back."""
    path = new_path(spark, "object")
    items = table(spark, d, "benchmark").select(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("item_id").cast("string"), "text")))).alias("m"))
    items.select(F.to_json("m")).coalesce(1).write.text(path)
    return contracts.json_object_entries(spark, path, [str(k) for k in range(3, 10)])


def json_array_records(spark, d):
    """The items as one JSON array, written, and read back as records with one field of two."""
    path = new_path(spark, "array")
    items = table(spark, d, "benchmark").select(F.array_sort(F.collect_list(F.struct("item_id", "text"))).alias("a"))
    items.select(F.to_json("a")).coalesce(1).write.text(path)
    return contracts.json_array_records(spark, path, "text string").select(F.sha2("text", 256).alias("h"))


def nested_passages(spark, d):
    turns = table(spark, d, "conversations")
    records = turns.groupBy("conv_id").agg(F.collect_list(F.struct("role", F.length("text").alias("chars"))).alias("passages"))
    return contracts.nested_passages(records, "passages", "chars").select("chars")


def integral_labels(spark, d):
    value = F.concat(F.col("quality").cast("string"), F.when(F.col("doc_id") % 2 == 0, F.lit(".0")).otherwise(F.lit("")))
    return table(spark, d, "labels").groupBy(contracts.integral_label(value, -2, 2).alias("label")).agg(F.count("*").alias("n"))


def aspect_maps(spark, d):
    raw = F.create_map(F.lit("a"), F.transform(F.array("l_suppkey", "l_linenumber", "l_suppkey"), lambda x: x.cast("string")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(contracts.aspect_map(raw)["a"].cast("array<string>"), ",").alias("items"))


def asymmetric_links(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") % 5000).alias("query"), (F.col("l_suppkey") % 7).alias("aspect"), F.col("l_linenumber").alias("item"), "l_quantity")
    out = contracts.asymmetric_links(rows.where("l_quantity < 30"), rows.where("l_quantity >= 20"))
    return out.groupBy("missing_in").agg(F.count("*").alias("n"))


def prompt_citations(spark, d):
    """Turns by alias, and made-up answers that cite the second and the ninth."""
    inputs = contracts.prompt_inputs(table(spark, d, "conversations").select("conv_id", "turn"), "conv_id", "turn")
    answers = inputs.select("conv_id").distinct().withColumn("citations", F.array(F.lit("S02"), F.lit("S09")))
    return contracts.resolved_citations(answers, inputs, "conv_id")


def citation_checks(spark, d):
    label = F.when(F.col("conv_id") % 3 == 0, "insufficient").otherwise("support")
    answers = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list("role").alias("citations"))
    problem = contracts.citation_problem(label, F.when(F.col("conv_id") % 2 == 0, F.slice("citations", 1, 1)).otherwise(F.col("citations")))
    return answers.groupBy(F.coalesce(problem, F.lit("sound")).alias("problem")).agg(F.count("*").alias("n"))


def applicability_checks(spark, d):
    dims = ["population", "intervention"]
    status = lambda k: F.when(F.col("o_orderkey") % k == 0, "MISMATCH").when(F.col("o_orderkey") % 11 == 0, "MAYBE").otherwise("MATCH")
    statuses = F.create_map(F.lit(dims[0]), status(3), F.lit(dims[1]), status(5))
    issues = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit(dims[0]))).otherwise(F.array().cast("array<string>"))
    problem = contracts.applicability_problem(statuses, issues, dims, ["MATCH", "MISMATCH", "UNCLEAR", "NOT_REPORTED"])
    return table(spark, d, "orders").groupBy(F.coalesce(problem, F.lit("sound")).alias("problem")).agg(F.count("*").alias("n"))


def gap_checks(spark, d):
    one = lambda k: F.when(F.col("o_orderkey") % k == 0, F.lit("x"))
    problem = contracts.gap_problem(F.col("o_orderkey") % 2 == 0, [one(2), one(6)])
    return table(spark, d, "orders").groupBy(F.coalesce(problem, F.lit("sound")).alias("problem")).agg(F.count("*").alias("n"))


def translations(spark, d):
    """Names of nations and regions as units, turned round, and put back."""
    nations, regions = table(spark, d, "nation"), table(spark, d, "region")
    units = contracts.translation_units({"nation": (nations, "n_nationkey", "n_name"), "region": (regions, "r_regionkey", "r_name")})
    turned = units.select("text_id", F.reverse("text").alias("text"))
    return contracts.translated(nations, "nation", "n_nationkey", "n_name", turned).select("n_nationkey", "n_name")


def _two_runs(spark, d):
    rows = table(spark, d, "lineitem")
    rank = lambda c: F.row_number().over(Window.partitionBy("l_orderkey").orderBy(c, "l_linenumber"))
    return rows.withColumn("rank", rank("l_linenumber")), rows.withColumn("rank", rank(F.floor(F.col("l_quantity") / 25)))


def first_mismatches(spark, d):
    return contracts.first_mismatch(*_two_runs(spark, d), "l_orderkey", "l_linenumber")


def capped_direction(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_suppkey") % 20).alias("q"), (F.col("l_orderkey") * 10**8 + F.col("l_linenumber") * 10**7 + F.col("l_partkey")).alias("item"), (F.col("l_returnflag") == "R").alias("gold"), F.col("l_quantity").alias("score"))
    return contracts.capped_direction(rows, "q", "item").withColumn("accuracy", F.round("accuracy", 6))


def cached_usage(spark, d):
    requests = table(spark, d, "benchmark").select(F.sha2("text", 256).alias("request_hash"))
    cache = table(spark, d, "benchmark").where("item_id % 3 > 0").select(F.sha2("text", 256).alias("request_hash"), F.length("text").alias("input_tokens"), F.col("item_id").alias("output_tokens")).dropDuplicates(["request_hash"])
    return contracts.cached_usage(requests, cache)


def presentation_claims(spark, d):
    claims, steps = _claims_steps(spark, d)
    out = contracts.presentation_claims(claims.select("claim_id"), argument.roles(claims, steps), argument.audit(claims, steps), steps)
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return out.select("claim_id", "role", "integrity", join("affecting_step_ids"), join("incoming_step_ids"), join("outgoing_step_ids"))


QUERIES = [json_object_entries, json_array_records, nested_passages, integral_labels, aspect_maps, asymmetric_links, prompt_citations, citation_checks, applicability_checks, gap_checks, translations, first_mismatches, capped_direction, cached_usage, presentation_claims]

ORACLE = {
    "json_object_entries": "SELECT CAST(item_id AS VARCHAR) AS key, text AS value FROM benchmark WHERE item_id BETWEEN 3 AND 9",
    "json_array_records": "SELECT sha256(text) AS h FROM benchmark",
    "nested_passages": "SELECT DISTINCT CAST(length(text) AS INTEGER) AS chars FROM conversations",
    "integral_labels": "SELECT CAST(quality AS INTEGER) AS label, count(*) AS n FROM labels GROUP BY 1",
    "aspect_maps": "SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey = l_linenumber THEN CAST(l_suppkey AS VARCHAR) ELSE l_suppkey || ',' || l_linenumber END AS items FROM lineitem",
    "asymmetric_links": """WITH r AS (SELECT l_orderkey % 5000 AS q, l_suppkey % 7 AS a, l_linenumber AS i, l_quantity AS n FROM lineitem), f AS (SELECT DISTINCT q, a, i FROM r WHERE n < 30), b AS (SELECT DISTINCT q, a, i FROM r WHERE n >= 20)
        SELECT * FROM (SELECT 'forward' AS missing_in, count(*) AS n FROM (SELECT * FROM b EXCEPT SELECT * FROM f) UNION ALL SELECT 'reverse', count(*) FROM (SELECT * FROM f EXCEPT SELECT * FROM b)) WHERE n > 0""",
    "prompt_citations": """WITH i AS (SELECT conv_id, turn, printf('S%02d', row_number() OVER (PARTITION BY conv_id ORDER BY turn)) AS alias FROM conversations), c AS (SELECT DISTINCT conv_id, unnest([0, 1]) AS position FROM conversations)
        SELECT c.conv_id, c.position, CASE WHEN c.position = 0 THEN 'S02' ELSE 'S09' END AS alias, i.turn, i.turn IS NOT NULL AS known FROM c LEFT JOIN i ON i.conv_id = c.conv_id AND i.alias = CASE WHEN c.position = 0 THEN 'S02' ELSE 'S09' END""",
    "citation_checks": """WITH a AS (SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 1 ELSE count(*) END AS n, CASE WHEN conv_id % 2 = 0 THEN 1 ELSE count(DISTINCT role) END AS u FROM conversations GROUP BY 1)
        SELECT CASE WHEN n > 5 THEN 'too many' WHEN u < n THEN 'repeated' WHEN (conv_id % 3 = 0) <> (n = 0) THEN 'presence' ELSE 'sound' END AS problem, count(*) AS n FROM a GROUP BY 1""",
    "applicability_checks": """SELECT CASE WHEN o_orderkey % 11 = 0 AND (o_orderkey % 3 <> 0 OR o_orderkey % 5 <> 0) THEN 'statuses' WHEN o_orderkey % 5 = 0 THEN 'issues' ELSE 'sound' END AS problem, count(*) AS n FROM orders GROUP BY 1""",
    "gap_checks": "SELECT CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 6 <> 0 THEN 'missing fields' ELSE 'sound' END AS problem, count(*) AS n FROM orders GROUP BY 1",
    "translations": "SELECT n_nationkey, reverse(n_name) AS n_name FROM nation",
    "first_mismatches": """WITH a AS (SELECT l_orderkey, l_linenumber AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS rank FROM lineitem),
        b AS (SELECT l_orderkey, l_linenumber AS y, row_number() OVER (PARTITION BY l_orderkey ORDER BY floor(l_quantity / 25), l_linenumber) AS rank FROM lineitem)
        SELECT l_orderkey, min(CASE WHEN x <> y THEN rank END) AS first_mismatch_rank FROM a JOIN b USING (l_orderkey, rank) GROUP BY 1""",
    "capped_direction": """WITH r AS (SELECT l_suppkey % 20 AS q, l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey AS item, l_returnflag = 'R' AS gold, l_quantity AS score FROM lineitem),
        n AS (SELECT *, row_number() OVER (PARTITION BY q, gold ORDER BY item) - 1 AS k, count(*) FILTER (WHERE NOT gold) OVER (PARTITION BY q) AS m FROM r),
        p AS (SELECT g.q, g.score AS s, o.score AS t FROM n g JOIN n o ON g.q = o.q AND g.gold AND NOT o.gold AND g.k * g.m < 5000 AND o.k < 5000 AND g.k * g.m + o.k < 5000)
        SELECT q, count(*) AS pairs, round(avg((s > t)::INT), 6) AS accuracy FROM p GROUP BY 1""",
    "cached_usage": """SELECT count(*) FILTER (WHERE item_id % 3 > 0) AS completed, count(*) FILTER (WHERE item_id % 3 = 0) AS missing, CAST(sum(length(text)) FILTER (WHERE item_id % 3 > 0) AS BIGINT) AS input_tokens,
        CAST(sum(item_id) FILTER (WHERE item_id % 3 > 0) AS BIGINT) AS output_tokens FROM benchmark""",
    "presentation_claims": f"""WITH {STEPS}, u AS (SELECT claim_id, evidence_status, claim_id IN (SELECT premise FROM links) AS p, claim_id IN (SELECT next FROM links) AS c FROM claims),
        i AS (SELECT conclusion AS claim_id, string_agg(CAST(step_id AS VARCHAR), ',' ORDER BY step_id) AS ids, bool_or(gap) AS gapped, string_agg(CAST(step_id AS VARCHAR), ',' ORDER BY step_id) FILTER (WHERE gap) AS gaps FROM steps GROUP BY 1),
        o AS (SELECT claim_id, string_agg(CAST(step_id AS VARCHAR), ',' ORDER BY step_id) AS ids FROM (SELECT DISTINCT step_id, unnest(premises) AS claim_id FROM steps) GROUP BY 1)
        SELECT claim_id, CASE WHEN p AND c THEN 'INTERMEDIATE' WHEN p THEN 'PREMISE' WHEN c THEN 'CONCLUSION' ELSE 'STANDALONE' END AS role,
          CASE WHEN evidence_status = 'ERROR' THEN 'ERROR' WHEN i.ids IS NULL THEN 'NOT_APPLICABLE' WHEN gapped THEN 'GAPPED' ELSE 'INTACT' END AS integrity,
          coalesce(gaps, '') AS affecting_step_ids, coalesce(i.ids, '') AS incoming_step_ids, coalesce(o.ids, '') AS outgoing_step_ids FROM u LEFT JOIN i USING (claim_id) LEFT JOIN o USING (claim_id)""",
}
