"""Queries over stances, verdicts, evidence graphs and argument graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.operators import argument, stance
from lodestrata.operators.corpus import violations
from lodestrata.plans.roles import JUDGMENTS, judgments, table

STANCE_COLUMNS = [f"p_{s}" for s in stance.STANCES]


def _predictions(spark, d):
    """Judged documents as evidence: three weights from the id, scaled to probabilities; rank by id within a claim."""
    j = judgments(spark, d)
    weights = {"p_support": 37, "p_refute": 53, "p_insufficient": 71}
    rows = j.withColumns({n: (1 + F.col("doc_id") * k % 50).cast("double") for n, k in weights.items()})
    total = F.col("p_support") + F.col("p_refute") + F.col("p_insufficient")
    rows = rows.withColumns({n: F.col(n) / total for n in weights})
    rank = F.row_number().over(Window.partitionBy("claim_id").orderBy("doc_id"))
    return stance.predicted(rows.select("claim_id", F.col("doc_id").alias("input_id"), (F.col("doc_id") % 5).alias("article_id"), rank.alias("rank"), *weights))


PRED = f"""{JUDGMENTS}, w AS (SELECT claim_id, doc_id AS input_id, doc_id % 5 AS article_id, row_number() OVER (PARTITION BY claim_id ORDER BY doc_id) AS rank,
  CAST(1 + doc_id * 37 % 50 AS DOUBLE) AS a, CAST(1 + doc_id * 53 % 50 AS DOUBLE) AS b, CAST(1 + doc_id * 71 % 50 AS DOUBLE) AS c FROM judgments),
p AS (SELECT claim_id, input_id, article_id, rank, a / (a + b + c) AS p_support, b / (a + b + c) AS p_refute, c / (a + b + c) AS p_insufficient FROM w),
pred AS (SELECT *, CASE WHEN p_support >= p_refute AND p_support >= p_insufficient THEN 'support' WHEN p_refute >= p_insufficient THEN 'refute' ELSE 'insufficient' END AS label,
  greatest(p_support, p_refute, p_insufficient) AS confidence FROM p)"""


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def stance_predictions(spark, d):
    return _rounded(_predictions(spark, d), *STANCE_COLUMNS, "confidence", "margin")


def stance_checks(spark, d):
    return stance.invalid_predictions(_predictions(spark, d))


def stance_repair(spark, d):
    given = F.when(F.col("input_id") % 4 == 0, "").when(F.col("input_id") % 4 == 1, "refute").otherwise(F.col("label"))
    rows = _predictions(spark, d).withColumn("label", given).select("input_id", "label", *STANCE_COLUMNS)
    return _rounded(stance.repaired(rows), *STANCE_COLUMNS)


def prediction_summary(spark, d):
    rows = _predictions(spark, d)
    return _rounded(rows.groupBy("label").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"), F.avg("margin").alias("mean_margin")), "mean_confidence", "mean_margin")


MASS = ["support_mass", "refute_mass", "insufficient_mass", "directional_margin", "directional_share"]


def stance_masses(spark, d):
    return _rounded(stance.masses(_predictions(spark, d), ["claim_id"]), *MASS)


def stance_masses_by_article(spark, d):
    return _rounded(stance.masses(_predictions(spark, d), ["claim_id", "article_id"]), *MASS)


def claim_verdicts(spark, d):
    out = stance.verdicts(_predictions(spark, d))
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return out.select("claim_id", "verdict", *[join(f"{s}_ids") for s in stance.STANCES])


def evidence_nodes(spark, d):
    return stance.graph_nodes(_predictions(spark, d))


def evidence_edges(spark, d):
    return stance.graph_edges(_predictions(spark, d))


def evidence_graph_summary(spark, d):
    rows = _predictions(spark, d)
    nodes = stance.graph_nodes(rows).groupBy(F.col("node_type").alias("kind")).agg(F.count("*").alias("n"))
    return nodes.union(stance.graph_edges(rows).groupBy("relation").agg(F.count("*").alias("n")))


def evidence_graph_checks(spark, d):
    rows = _predictions(spark, d)
    return stance.graph_violations(stance.graph_nodes(rows), stance.graph_edges(rows))


def sentence_context(spark, d):
    return stance.sentence_context(table(spark, d, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn").drop("text")


def _claims_steps(spark, d):
    """Customers' nations as claims; a step leads from the nations of two suppliers to a nation further on, with cycles."""
    claims = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("claim_id"), F.when(F.col("n_nationkey") % 9 == 0, "ERROR").otherwise("SUPPORTED").alias("evidence_status"))
    s = table(spark, d, "supplier")
    steps = s.select(F.col("s_suppkey").alias("step_id"), F.array(F.col("s_nationkey").cast("long"), ((F.col("s_nationkey") + 3) % 25).cast("long")).alias("premises"), ((F.col("s_nationkey") * 2 + 1) % 23).cast("long").alias("conclusion"), (F.col("s_suppkey") % 4 == 0).alias("gap"))
    return claims, steps


STEPS = """steps AS (SELECT s_suppkey AS step_id, [CAST(s_nationkey AS BIGINT), CAST((s_nationkey + 3) % 25 AS BIGINT)] AS premises, CAST((s_nationkey * 2 + 1) % 23 AS BIGINT) AS conclusion, s_suppkey % 4 = 0 AS gap FROM supplier),
claims AS (SELECT CAST(n_nationkey AS BIGINT) AS claim_id, CASE WHEN n_nationkey % 9 = 0 THEN 'ERROR' ELSE 'SUPPORTED' END AS evidence_status FROM nation),
links AS (SELECT DISTINCT unnest(premises) AS premise, conclusion AS next FROM steps)"""


def argument_roles(spark, d):
    return argument.roles(*_claims_steps(spark, d))


def argument_audit(spark, d):
    claims, steps = _claims_steps(spark, d)
    return argument.audit(claims, steps).withColumn("affecting_step_ids", F.array_join(F.col("affecting_step_ids").cast("array<string>"), ","))


def argument_reachability(spark, d):
    return argument.reachable(_claims_steps(spark, d)[1]).select("step_id", "claim_id")


def argument_impacts(spark, d):
    out = argument.impacts(_claims_steps(spark, d)[1])
    return out.select("step_id", "affected_claims", F.array_join(F.col("terminal_claim_ids").cast("array<string>"), ",").alias("terminal_claim_ids"), "cycle_detected", "affects_terminal_conclusion")


def gap_inputs(spark, d):
    """Claims that a step uses or concludes, each with how many steps touch it."""
    _, steps = _claims_steps(spark, d)
    touched = steps.select("step_id", F.explode(F.concat("premises", F.array("conclusion"))).alias("claim_id")).distinct()
    return touched.groupBy("claim_id").agg(F.count("*").alias("steps"))


def graph_components(spark, d):
    """Components of orders and suppliers, linked by all order lines."""
    edges = table(spark, d, "lineitem").select((F.col("l_orderkey") * 2).alias("a"), (F.col("l_suppkey") * 2 + 1).alias("b"))
    out = argument.components(edges)
    return out.groupBy("component").agg(F.count("*").alias("size"))


def component_split(spark, d):
    """Sources in order of a hash, taken whole up to the number of documents nearest to a tenth of all."""
    sizes = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")).withColumn("h", F.sha2(F.concat(F.lit("42:"), "source"), 256))
    target = table(spark, d, "documents").count() // 10
    return argument.nearest_cutoff(sizes, ["h", "source"], "n", target).select("source", "n")


def statement_status(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", (F.col("o_orderstatus") == "F").alias("failed"))
    return argument.run_status(rows, "o_custkey")


def split_leakage(spark, d):
    """Texts that stand under more than one language or source."""
    docs = table(spark, d, "documents")
    both = docs.groupBy(F.sha2("text", 256).alias("h")).agg(F.countDistinct("lang").alias("langs"), F.countDistinct("source").alias("sources"))
    return both.agg(F.count_if(F.col("langs") > 1).alias("across_languages"), F.count_if(F.col("sources") > 1).alias("across_sources"))


def mapping_symmetry(spark, d):
    """Pairs that a forward mapping has and the reverse one lacks, and the other way round."""
    rows = table(spark, d, "lineitem")
    there = rows.select("l_orderkey", "l_suppkey").where("l_linenumber <= 3").distinct()
    back = rows.select("l_orderkey", "l_suppkey").where("l_linenumber <= 2").distinct()
    return violations({"forward_only": there.exceptAll(back), "reverse_only": back.exceptAll(there)})


QUERIES = [stance_predictions, stance_checks, stance_repair, prediction_summary, stance_masses, stance_masses_by_article, claim_verdicts, evidence_nodes, evidence_edges, evidence_graph_summary, evidence_graph_checks, sentence_context, argument_roles, argument_audit, argument_reachability, argument_impacts, gap_inputs, graph_components, component_split, statement_status, split_leakage, mapping_symmetry]

_NODES = """nodes AS (SELECT DISTINCT CAST(claim_id AS VARCHAR) AS graph_id, 'claim:' || claim_id AS node_id, 'claim' AS node_type FROM pred
  UNION ALL SELECT DISTINCT CAST(claim_id AS VARCHAR), 'article:' || article_id, 'article' FROM pred UNION ALL SELECT CAST(claim_id AS VARCHAR), 'evidence:' || input_id, 'evidence' FROM pred),
edges AS (SELECT DISTINCT CAST(claim_id AS VARCHAR) AS graph_id, 'claim:' || claim_id AS source, 'article:' || article_id AS target, 'retrieved_from' AS relation FROM pred
  UNION ALL SELECT CAST(claim_id AS VARCHAR), 'article:' || article_id, 'evidence:' || input_id, 'contains_evidence' FROM pred
  UNION ALL SELECT CAST(claim_id AS VARCHAR), 'evidence:' || input_id, 'claim:' || claim_id, CASE label WHEN 'support' THEN 'supports' WHEN 'refute' THEN 'refutes' ELSE 'insufficient_for' END FROM pred)"""
_MASS = """WITH {pred}, m AS (SELECT {k}, sum(p_support / rank) AS s, sum(p_refute / rank) AS r, sum(p_insufficient / rank) AS i,
  count(*) FILTER (WHERE label = 'support') AS support_count, count(*) FILTER (WHERE label = 'refute') AS refute_count, count(*) FILTER (WHERE label = 'insufficient') AS insufficient_count,
  arg_max(input_id, row(p_support / rank, -rank, -input_id)) FILTER (WHERE label = 'support') AS top_support, arg_max(input_id, row(p_refute / rank, -rank, -input_id)) FILTER (WHERE label = 'refute') AS top_refute,
  arg_max(input_id, row(p_insufficient / rank, -rank, -input_id)) FILTER (WHERE label = 'insufficient') AS top_insufficient FROM pred GROUP BY ALL)
SELECT {k}, round(s, 6) AS support_mass, round(r, 6) AS refute_mass, round(i, 6) AS insufficient_mass, support_count, refute_count, insufficient_count, top_support, top_refute, top_insufficient,
  round(s - r, 6) AS directional_margin, round((s + r) / (s + r + i), 6) AS directional_share,
  CASE WHEN support_count > 0 AND refute_count > 0 THEN 'mixed' WHEN support_count > 0 THEN 'support_only' WHEN refute_count > 0 THEN 'refute_only' ELSE 'none' END AS pattern,
  support_count > 0 AND refute_count > 0 AS conflict, CASE WHEN s >= r AND s >= i THEN 'support' WHEN r >= i THEN 'refute' ELSE 'insufficient' END AS leader FROM m"""
_IDS = ", ".join(f"coalesce(string_agg(CAST(input_id AS VARCHAR), ',' ORDER BY rank) FILTER (WHERE label = '{s}'), '') AS {s}_ids" for s in stance.STANCES)
_REACH = "reach AS (SELECT step_id, conclusion AS claim_id FROM steps UNION SELECT r.step_id, l.next FROM reach r JOIN links l ON l.premise = r.claim_id)"

ORACLE = {
    "stance_predictions": f"""WITH {PRED} SELECT claim_id, input_id, article_id, rank, round(p_support, 6) AS p_support, round(p_refute, 6) AS p_refute, round(p_insufficient, 6) AS p_insufficient, label,
        round(confidence, 6) AS confidence, round(confidence - list_sort([p_support, p_refute, p_insufficient])[2], 6) AS margin FROM pred""",
    "stance_checks": "SELECT unnest(['probability_domain', 'probability_sum', 'label_is_argmax', 'confidence', 'margin']) AS \"check\", 0::BIGINT AS violations",
    "stance_repair": f"""WITH {PRED}, g AS (SELECT *, CASE WHEN input_id % 4 = 1 THEN 'refute' ELSE label END AS final FROM pred),
        h AS (SELECT *, CASE final WHEN 'support' THEN p_support WHEN 'refute' THEN p_refute ELSE p_insufficient END AS own FROM g)
        SELECT input_id, final AS label, true AS valid, {', '.join(f"round(CASE WHEN final = '{s}' THEN confidence WHEN label = '{s}' THEN own ELSE p_{s} END, 6) AS p_{s}" for s in stance.STANCES)} FROM h""",
    "prediction_summary": f"WITH {PRED} SELECT label, count(*) AS n, round(avg(confidence), 6) AS mean_confidence, round(avg(confidence - list_sort([p_support, p_refute, p_insufficient])[2]), 6) AS mean_margin FROM pred GROUP BY 1",
    "stance_masses": _MASS.format(pred=PRED, k="claim_id"),
    "stance_masses_by_article": _MASS.format(pred=PRED, k="claim_id, article_id"),
    "claim_verdicts": f"""WITH {PRED} SELECT claim_id, CASE WHEN count(*) FILTER (WHERE label = 'support') > 0 AND count(*) FILTER (WHERE label = 'refute') > 0 THEN 'mixed'
        WHEN count(*) FILTER (WHERE label = 'support') > 0 THEN 'supported' WHEN count(*) FILTER (WHERE label = 'refute') > 0 THEN 'refuted' ELSE 'insufficient' END AS verdict, {_IDS} FROM pred GROUP BY 1""",
    "evidence_nodes": f"WITH {PRED}, {_NODES} SELECT * FROM nodes",
    "evidence_edges": f"WITH {PRED}, {_NODES} SELECT * FROM edges",
    "evidence_graph_summary": f"WITH {PRED}, {_NODES} SELECT node_type AS kind, count(*) AS n FROM nodes GROUP BY 1 UNION ALL SELECT relation, count(*) FROM edges GROUP BY 1",
    "evidence_graph_checks": "SELECT unnest(['one_claim', 'unique_nodes', 'dangling_edges', 'one_parent', 'one_stance']) AS \"check\", 0::BIGINT AS violations",
    "sentence_context": "SELECT conv_id, turn, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS context_before, coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS context_after FROM conversations",
    "argument_roles": f"""WITH {STEPS}, u AS (SELECT claim_id, claim_id IN (SELECT premise FROM links) AS p, claim_id IN (SELECT next FROM links) AS c FROM claims)
        SELECT claim_id, CASE WHEN p AND c THEN 'INTERMEDIATE' WHEN p THEN 'PREMISE' WHEN c THEN 'CONCLUSION' ELSE 'STANDALONE' END AS role FROM u""",
    "argument_audit": f"""WITH {STEPS}, i AS (SELECT conclusion AS claim_id, count(*) AS n, string_agg(CAST(step_id AS VARCHAR), ',' ORDER BY step_id) FILTER (WHERE gap) AS g FROM steps GROUP BY 1)
        SELECT claim_id, CASE WHEN evidence_status = 'ERROR' THEN 'ERROR' WHEN n IS NULL THEN 'NOT_APPLICABLE' WHEN g IS NOT NULL THEN 'GAPPED' ELSE 'INTACT' END AS integrity, coalesce(g, '') AS affecting_step_ids FROM claims LEFT JOIN i USING (claim_id)""",
    "argument_reachability": f"WITH RECURSIVE {STEPS}, {_REACH} SELECT step_id, claim_id FROM reach",
    "argument_impacts": f"""WITH RECURSIVE {STEPS}, {_REACH}, x AS (SELECT r.step_id, r.claim_id, r.claim_id NOT IN (SELECT premise FROM links) AS t, list_contains(s.premises, r.claim_id) AS own FROM reach r JOIN steps s USING (step_id))
        SELECT step_id, count(*) AS affected_claims, coalesce(string_agg(CAST(claim_id AS VARCHAR), ',' ORDER BY claim_id) FILTER (WHERE t), '') AS terminal_claim_ids, bool_or(own) AS cycle_detected, bool_or(t) AS affects_terminal_conclusion FROM x GROUP BY 1""",
    "gap_inputs": f"WITH {STEPS}, t AS (SELECT DISTINCT step_id, unnest(list_append(premises, conclusion)) AS claim_id FROM steps) SELECT claim_id, count(*) AS steps FROM t GROUP BY 1",
    "component_split": """WITH s AS (SELECT source, count(*) AS n, sha256('42:' || source) AS h FROM documents GROUP BY 1), c AS (SELECT *, sum(n) OVER (ORDER BY h, source) AS cum, row_number() OVER (ORDER BY h, source) AS k FROM s),
        t AS (SELECT count(*) // 10 AS t FROM documents), b AS (SELECT CASE WHEN min(abs(cum - t)) < any_value(t) THEN arg_min(k, row(abs(cum - t), k)) ELSE 0 END AS best FROM c, t) SELECT source, n FROM c, b WHERE k <= best""",
    "statement_status": """SELECT o_custkey, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS failed, CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'F') = 0 THEN 'completed'
        WHEN count(*) FILTER (WHERE o_orderstatus = 'F') < count(*) THEN 'partial_failure' ELSE 'failed' END AS status FROM orders GROUP BY 1""",
    "split_leakage": "WITH g AS (SELECT sha256(text) AS h, count(DISTINCT lang) AS l, count(DISTINCT source) AS s FROM documents GROUP BY 1) SELECT count(*) FILTER (WHERE l > 1) AS across_languages, count(*) FILTER (WHERE s > 1) AS across_sources FROM g",
    "mapping_symmetry": """WITH a AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_linenumber <= 3), b AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_linenumber <= 2)
        SELECT 'forward_only' AS "check", count(*) AS violations FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'reverse_only', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
}

_CLASSES = "unnest(['support', 'refute', 'insufficient'])"
STANCE_CLASSIFICATION = f"""WITH {PRED}, x AS (SELECT label AS pred, CASE WHEN stance > 0 THEN 'support' WHEN stance < 0 THEN 'refute' ELSE 'insufficient' END AS gold FROM pred JOIN judgments ON doc_id = input_id),
c AS (SELECT {_CLASSES} AS k), t AS (SELECT k, count(*) FILTER (WHERE pred = k AND gold = k) AS tp, count(*) FILTER (WHERE pred = k) AS p, count(*) FILTER (WHERE gold = k) AS g FROM c, x GROUP BY 1)
SELECT (SELECT count(*) FROM x) AS n, round((SELECT avg((pred = gold)::INT) FROM x), 6) AS accuracy, round(avg(coalesce(2 * tp / nullif(p + g, 0), 0)), 6) AS macro_f1, round(avg(coalesce(tp / nullif(g, 0), 0)), 6) AS balanced_accuracy FROM t"""
