"""Queries over final graphs, statement bundles, gap bundles and their validators. Planted defects follow from ids, so that SQL can count them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import argument, bundles, contracts, stance
from lodestrata.plans.graphs import _MASS, PRED, STEPS, _claims_steps, _predictions, _rounded
from lodestrata.plans.graphs import MASS as MASS_COLUMNS
from lodestrata.plans.roles import table
from lodestrata.storage import stored


def _joined(column):
    return F.array_join(F.col(column).cast("array<string>"), ",").alias(column)


def _articles_evidence(spark, d):
    rows = _predictions(spark, d)
    articles = rows.groupBy("claim_id", "article_id").agg(F.min("rank").alias("rank"), F.min_by("label", "rank").alias("stance"))
    return articles, rows.select("claim_id", "article_id", F.col("input_id").alias("evidence_id"), "rank")


def final_graph_nodes(spark, d):
    return bundles.final_nodes(*_articles_evidence(spark, d))


def final_graph_edges(spark, d):
    return bundles.final_edges(*_articles_evidence(spark, d))


def _merged(spark, d):
    parts = _articles_evidence(spark, d)
    nodes = bundles.final_nodes(*parts)
    return nodes, bundles.merged_evidence(nodes, bundles.final_edges(*parts))


def merged_graph_evidence(spark, d):
    return _merged(spark, d)[1]


def merged_graph_articles(spark, d):
    return bundles.merged_articles(*_merged(spark, d)).select("claim_id", "article_node_id", "rank", _joined("evidence_ids"))


def _bundle(spark, d):
    """A statement bundle with defects that follow from the ids."""
    rows = _predictions(spark, d).withColumn("node", F.concat(F.lit("a"), "claim_id", F.lit("-"), "article_id"))
    item = F.col("item_id")
    status = F.when(item % 5 == 0, "failed").when(item % 11 == 3, "odd").otherwise("completed")
    claims = table(spark, d, "benchmark").select((item % 4).alias("statement_id"), item.alias("claim_id"), status.alias("analysis_status"))
    verdict = F.when((F.col("analysis_status") == "completed") & (F.col("claim_id") % 7 != 1), "mixed")
    error = F.when((F.col("analysis_status") == "failed") & (F.col("claim_id") % 10 == 0), "x").when((F.col("analysis_status") == "completed") & (F.col("claim_id") % 13 == 2), "late")
    nodes = rows.groupBy("claim_id").agg(F.sort_array(F.collect_set("node")).alias("nodes"))
    given = F.when(F.col("claim_id") % 6 == 4, F.array().cast("array<string>")).otherwise(F.coalesce("nodes", F.array().cast("array<string>")))
    claims = claims.join(nodes, "claim_id", "left").select("statement_id", "claim_id", "analysis_status", verdict.alias("verdict"), error.alias("error"), given.alias("article_node_ids"))
    name = F.concat(F.lit("e"), "input_id")
    held = rows.groupBy("claim_id", "article_id", F.col("node").alias("article_node_id")).agg(F.min_by("label", "rank").alias("stance"), F.sort_array(F.collect_set(name)).alias("ids"))
    articles = held.select("article_node_id", "claim_id", F.when(F.col("article_id") == 3, "odd").otherwise(F.col("stance")).alias("stance"), F.when(F.col("article_id") == 2, F.array().cast("array<string>")).otherwise(F.col("ids")).alias("evidence_ids"))
    k = F.col("input_id")
    evidence = rows.select(F.when(k % 17 == 5, "e-dup").otherwise(name).alias("evidence_id"), F.when(k % 19 == 4, "nowhere").otherwise(F.col("node")).alias("article_node_id"), F.when(k % 23 == 7, F.col("claim_id") + 1).otherwise(F.col("claim_id")).alias("claim_id"))
    _, steps = _claims_steps(spark, d)
    derived = bundles.step_id(F.col("premises"), F.col("conclusion"))
    steps = steps.select((F.col("step_id") % 4).alias("statement_id"), F.when(F.col("step_id") % 9 == 0, "odd").otherwise(derived).alias("step_id"), "premises", "conclusion")
    totals = claims.groupBy("statement_id").agg(F.count("*").alias("total_claims"), F.count_if(F.col("analysis_status") == "failed").alias("failed_claims"))
    counted = articles.join(claims.select("claim_id", "statement_id"), "claim_id").groupBy("statement_id").agg(F.count("*").alias("articles"), F.sum(F.size("evidence_ids")).alias("evidence"))
    statements = totals.join(counted, "statement_id", "left").select(
        "statement_id", F.when(F.col("statement_id") == 2, " ").otherwise("text").alias("original_text"), F.lit("en").alias("source_language"), F.lit("completed").alias("analysis_status"), "total_claims",
        (F.col("total_claims") - F.col("failed_claims")).alias("completed_claims"), "failed_claims", F.coalesce("articles", F.lit(0)).alias("articles"), F.coalesce("evidence", F.lit(0)).alias("evidence"),
    )
    return statements, claims, steps, articles, evidence


def statement_bundle_checks(spark, d):
    return bundles.bundle_violations(*_bundle(spark, d))


def gap_bundles(spark, d):
    s = F.col("s_suppkey")
    steps = table(spark, d, "supplier").select((s % 3).alias("statement_id"), s.alias("position"), s.alias("step_id"))
    analyses = table(spark, d, "supplier").select(s.alias("step_id"), (s % 4 == 0).alias("scope_gap"), (s % 5 == 0).alias("causal_gap"))
    out = bundles.gap_bundle(steps, analyses)
    shown = F.array_join(F.transform("analyses", lambda a: F.concat_ws(":", a["step_id"].cast("string"), a["scope_gap"].cast("int").cast("string"), a["causal_gap"].cast("int").cast("string"))), ",")
    return out.select("statement_id", "steps", "scope_gaps", "causal_gaps", shown.alias("analyses"))


def runtime_evidence_checks(spark, d):
    """Turns as sentences of their conversation; the first five of each, but one turn in seven, are its evidence, with defects by id."""
    turns = table(spark, d, "conversations").select(F.concat("conv_id", F.lit("/"), "turn").alias("sentence_id"), F.col("conv_id").alias("article_id"), F.col("turn").alias("sentence_index"), F.col("text").alias("sentence_text"), (F.col("turn") > 0).alias("eligible"))
    k = F.col("article_id")
    chosen = turns.where((F.col("sentence_index") < 6) & ((k + F.col("sentence_index")) % 7 != 0)).select(
        F.when(k % 31 == 3, "e").otherwise(F.concat(F.lit("e"), "sentence_id")).alias("evidence_id"),
        F.when(k % 29 == 2, k + 1).otherwise(k).alias("article_id"),
        F.when(k % 37 == 4, F.concat("sentence_id", F.lit("?"))).otherwise(F.col("sentence_id")).alias("sentence_id"),
        F.when(k % 13 == 5, F.col("sentence_index") + 1).otherwise(F.col("sentence_index")).alias("sentence_index"),
        F.when(k % 17 == 6, F.upper("sentence_text")).otherwise(F.col("sentence_text")).alias("sentence_text"),
        F.col("sentence_index").alias("rank"),
        F.when(k % 19 == 7, F.lit(float("inf"))).otherwise(F.lit(1.0)).alias("score"),
        F.when(k % 23 != 8, 1).alias("source_rank"),
    )
    return bundles.evidence_violations(chosen, turns, turns.select("article_id").distinct())


def decomposition_checks(spark, d):
    """Conversations as statements of two claims, with defects by id, and a step from the first to the second."""
    first = table(spark, d, "conversations").where("turn = 0").select(F.col("conv_id").alias("statement_id"), F.col("text").alias("original_text"))
    s = F.col("statement_id")
    one = first.select("statement_id", F.lit(1).alias("position"), F.when(s % 11 == 1, "C2").otherwise("C1").alias("claim_ref"), F.when(s % 7 == 2, F.lit("not in the text #")).otherwise(F.substring("original_text", 1, 5)).alias("source_text"), F.when(s % 13 == 3, "123").otherwise("Water helps.").alias("canonical"))
    two = first.select("statement_id", F.lit(2), F.lit("C2"), F.substring("original_text", 1, 6), F.when(s % 5 == 4, "  water   HELPS?").when(s % 17 == 5, "Two\nlines").otherwise("Salt harms."))
    p = F.when(s % 9 == 1, F.array(F.lit("C1"), F.lit("C1"))).when(s % 19 == 2, F.array().cast("array<string>")).when(s % 23 == 3, F.array(F.lit("C7"))).otherwise(F.array(F.lit("C1")))
    steps = first.select("statement_id", F.explode(F.when(s % 6 == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("position"), p.alias("premise_refs"), F.lit("C2").alias("conclusion_ref"))
    return bundles.decomposition_problems(one.union(two), steps, first)


def article_contexts(spark, d):
    """Passages cut from documents by offsets, some shifted, some of another version of the text."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("article_id"), F.col("text").alias("source_text"))
    k, n = F.col("article_id"), F.length("source_text")
    start = F.when(k % 11 == 3, n).otherwise(k % 20).cast("int")
    evidence = docs.select("article_id", F.concat(F.lit("e"), "article_id").alias("evidence_id"), start.alias("character_start"), (start + 25).alias("character_end"), F.substring(F.col("source_text"), ((k % 20) + F.when(k % 7 == 1, 2).otherwise(1)).cast("int"), F.lit(25)).alias("text"), F.sha2(F.when(k % 5 == 2, F.concat("source_text", F.lit("."))).otherwise(F.col("source_text")), 256).alias("fingerprint"))
    return bundles.article_context(docs, evidence).select("article_id", "evidence_id", "fingerprint_verified", "in_range", "in_place")


def recomputed_masses(spark, d):
    """Claim aggregates as stored, some changed since, against the ones computed anew."""
    again = _rounded(stance.masses(_predictions(spark, d), ["claim_id"]), *MASS_COLUMNS)
    kept, _ = stored(again.where("claim_id % 9 <> 4").withColumn("support_count", F.when(F.col("claim_id") % 7 == 3, F.col("support_count") + 1).otherwise(F.col("support_count"))), "masses")
    return bundles.recomputed(kept, again)


def _analysis(spark, d):
    b = table(spark, d, "benchmark")
    k = F.col("item_id")
    decomposition = b.where("item_id % 13 <> 5").select((k % 6).alias("statement_id"), k.alias("claim_id"), F.sha2("text", 256).alias("canonical"))
    status = F.when(k % 4 == 1, "failed").otherwise("completed")
    results = b.where("item_id % 17 <> 2").select(
        (k % 6).alias("statement_id"), k.alias("claim_id"), F.sha2(F.when(k % 19 == 3, F.upper("text")).otherwise(F.col("text")), 256).alias("canonical"), status.alias("status"),
        F.when((status == "completed") | (k % 7 == 1), "mixed").alias("verdict"), F.when(status == "failed", "x").alias("error"), F.when(k % 6 == 0, "completed").when(k % 6 == 3, "failed").otherwise("partial_failure").alias("statement_status"),
    )
    return results, decomposition


def analysis_checks(spark, d):
    return bundles.analysis_violations(*_analysis(spark, d))


def presentation_checks(spark, d):
    claims, steps = _claims_steps(spark, d)
    shown = contracts.presentation_claims(claims.select("claim_id"), argument.roles(claims, steps), argument.audit(claims, steps), steps)
    k = F.col("claim_id")
    bent = shown.withColumns({"role": F.when(k % 8 == 1, "OTHER").otherwise(F.col("role")), "integrity": F.when(k % 12 == 2, "GAPPED").otherwise(F.col("integrity")), "outgoing_step_ids": F.when(k % 10 == 3, F.array().cast("array<bigint>")).otherwise(F.col("outgoing_step_ids"))})
    return bundles.presentation_violations(bent, steps)


QUERIES = [final_graph_nodes, final_graph_edges, merged_graph_evidence, merged_graph_articles, statement_bundle_checks, gap_bundles, runtime_evidence_checks, decomposition_checks, article_contexts, recomputed_masses, analysis_checks, presentation_checks]

_ID = "'{0}:' || substr(sha256({1}), 1, 16)"
_GRAPH, _CLAIM, _EVIDENCE = _ID.format("graph", "claim_id::VARCHAR"), _ID.format("claim", "claim_id::VARCHAR"), _ID.format("evidence", "evidence_id::VARCHAR")
_ARTICLE = _ID.format("article", "claim_id || chr(0) || article_id")
_PARTS = f"""{PRED}, art AS (SELECT claim_id, article_id, min(rank) AS rank, arg_min(label, rank) AS stance FROM pred GROUP BY ALL),
ev AS (SELECT claim_id, article_id, input_id AS evidence_id, rank FROM pred)"""
_MERGED = f"""{_PARTS}, me AS (SELECT claim_id, {_ARTICLE} AS article_node_id, claim_id || ':' || {_EVIDENCE} AS evidence_id, rank FROM ev)"""
_BUNDLE = f"""{PRED}, {STEPS}, r AS (SELECT *, 'a' || claim_id || '-' || article_id AS node FROM pred),
c0 AS (SELECT item_id % 4 AS statement_id, item_id AS claim_id, CASE WHEN item_id % 5 = 0 THEN 'failed' WHEN item_id % 11 = 3 THEN 'odd' ELSE 'completed' END AS st FROM benchmark),
nd AS (SELECT claim_id, list_sort(list(DISTINCT node)) AS nodes FROM r GROUP BY 1),
c AS (SELECT statement_id, c0.claim_id, st, CASE WHEN st = 'completed' AND c0.claim_id % 7 <> 1 THEN 'mixed' END AS verdict,
  CASE WHEN st = 'failed' AND c0.claim_id % 10 = 0 THEN 'x' WHEN st = 'completed' AND c0.claim_id % 13 = 2 THEN 'late' END AS error, coalesce(nodes, []) AS real, CASE WHEN c0.claim_id % 6 = 4 THEN [] ELSE coalesce(nodes, []) END AS given FROM c0 LEFT JOIN nd USING (claim_id)),
a AS (SELECT node, claim_id, article_id, CASE WHEN article_id = 3 THEN 'odd' ELSE arg_min(label, rank) END AS stance, CASE WHEN article_id = 2 THEN [] ELSE list_sort(list(DISTINCT 'e' || input_id)) END AS ids FROM r GROUP BY node, claim_id, article_id),
e AS (SELECT CASE WHEN input_id % 17 = 5 THEN 'e-dup' ELSE 'e' || input_id END AS evidence_id, CASE WHEN input_id % 19 = 4 THEN 'nowhere' ELSE node END AS node, CASE WHEN input_id % 23 = 7 THEN claim_id + 1 ELSE claim_id END AS claim_id FROM r),
ea AS (SELECT node, list_sort(list(DISTINCT evidence_id)) AS real FROM e GROUP BY 1),
s AS (SELECT step_id % 4 AS statement_id, step_id AS k, premises, conclusion FROM steps)"""
_CHECKS = {
    "statement_fields": "SELECT count(DISTINCT statement_id) FROM c WHERE statement_id = 2",
    "claim_identity": "SELECT 0",
    "claim_status": "SELECT count(*) FROM c WHERE st = 'odd'",
    "completed_claim": "SELECT count(*) FROM c WHERE st = 'completed' AND (verdict IS NULL OR error IS NOT NULL)",
    "failed_claim": "SELECT count(*) FROM c WHERE st = 'failed' AND (len(given) > 0 OR error IS NULL)",
    "step_premises": "SELECT count(*) FROM s WHERE len(list_distinct(premises)) < len(premises)",
    "step_references": "SELECT count(DISTINCT CASE WHEN k % 9 = 0 THEN 'odd' ELSE array_to_string(list_sort(premises), ',') || '>' || conclusion END) FROM (SELECT *, unnest(list_append(premises, conclusion)) AS u FROM s) WHERE u NOT IN (SELECT claim_id FROM c)",
    "step_circle": "SELECT count(*) FROM s WHERE list_contains(premises, conclusion)",
    "step_identity": "SELECT count(*) FROM s WHERE k % 9 = 0",
    "step_repeated": "SELECT count(*) FROM (SELECT 1 FROM s GROUP BY statement_id, list_sort(premises), conclusion HAVING count(*) > 1)",
    "article_identity": "SELECT 0",
    "article_claim": "SELECT count(*) FROM a WHERE claim_id NOT IN (SELECT claim_id FROM c WHERE st = 'completed')",
    "article_stance": "SELECT count(*) FROM a WHERE stance = 'odd'",
    "evidence_identity": "SELECT count(*) FROM (SELECT 1 FROM e GROUP BY evidence_id HAVING count(*) > 1)",
    "evidence_article": "SELECT count(*) FROM e WHERE node = 'nowhere'",
    "evidence_claim": "SELECT count(*) FROM e JOIN a USING (node) WHERE e.claim_id <> a.claim_id",
    "article_evidence_ids": "SELECT count(*) FROM a LEFT JOIN ea USING (node) WHERE ids <> coalesce(ea.real, [])",
    "claim_article_ids": "SELECT count(*) FROM c WHERE given <> real",
    "summary": "SELECT count(*) FROM (SELECT 1 FROM c GROUP BY statement_id HAVING count(*) FILTER (WHERE st <> 'failed') <> count(*) FILTER (WHERE st = 'completed'))",
}
_STEPS_OF = "i AS (SELECT conclusion AS claim_id, count(*) AS n, bool_or(gap) AS g FROM steps GROUP BY 1), o AS (SELECT premise AS claim_id, count(DISTINCT step_id) AS n FROM (SELECT step_id, unnest(premises) AS premise FROM steps) GROUP BY 1)"
_TURNS = "t AS (SELECT conv_id AS a, turn AS i, text FROM conversations), ch AS (SELECT *, CASE WHEN a % 29 = 2 THEN a + 1 ELSE a END AS b FROM t WHERE i < 6 AND (a + i) % 7 <> 0)"

ORACLE = {
    "final_graph_nodes": f"""WITH {_PARTS} SELECT DISTINCT {_GRAPH} AS graph_id, {_CLAIM} AS node_id, 'claim' AS node_type, claim_id, NULL::BIGINT AS article_id, NULL::BIGINT AS rank FROM art
        UNION ALL SELECT {_GRAPH}, {_ARTICLE}, 'article', claim_id, article_id, rank FROM art UNION ALL SELECT {_GRAPH}, {_EVIDENCE}, 'evidence', claim_id, article_id, rank FROM ev""",
    "final_graph_edges": f"""WITH {_PARTS}, e AS (SELECT {_GRAPH} AS graph_id, {_ARTICLE} AS source, {_CLAIM} AS target, CASE stance WHEN 'support' THEN 'article_supports' WHEN 'refute' THEN 'article_refutes' ELSE 'article_insufficient' END AS relation FROM art
        UNION ALL SELECT {_GRAPH}, {_ARTICLE}, {_EVIDENCE}, 'contains_evidence' FROM ev) SELECT graph_id, substr(sha256(relation || chr(0) || source || chr(0) || target), 1, 24) AS edge_id, source, target, relation FROM e""",
    "merged_graph_evidence": f"WITH {_MERGED} SELECT claim_id, article_node_id, evidence_id, rank FROM me",
    "merged_graph_articles": f"""WITH {_MERGED}, h AS (SELECT article_node_id, string_agg(evidence_id, ',' ORDER BY rank) AS evidence_ids FROM me GROUP BY 1)
        SELECT claim_id, article_node_id, rank, evidence_ids FROM (SELECT claim_id, {_ARTICLE} AS article_node_id, rank FROM art) LEFT JOIN h USING (article_node_id)""",
    "statement_bundle_checks": f"WITH {_BUNDLE} " + " UNION ALL ".join(f"SELECT '{n}' AS \"check\", ({q})::BIGINT AS violations" for n, q in _CHECKS.items()),
    "gap_bundles": """SELECT s_suppkey % 3 AS statement_id, count(*) AS steps, count(*) FILTER (WHERE s_suppkey % 4 = 0) AS scope_gaps, count(*) FILTER (WHERE s_suppkey % 5 = 0) AS causal_gaps,
        string_agg(s_suppkey || ':' || (s_suppkey % 4 = 0)::INT || ':' || (s_suppkey % 5 = 0)::INT, ',' ORDER BY s_suppkey) AS analyses FROM supplier GROUP BY 1""",
    "runtime_evidence_checks": f"""WITH {_TURNS}, per AS (SELECT b, count(*) AS n, min(i) AS lo, max(i) AS hi, count(DISTINCT i) AS u FROM ch GROUP BY 1), w AS (SELECT a, least(count(*) FILTER (WHERE i > 0), 5) AS wanted FROM t GROUP BY 1)
        SELECT 'evidence_identity' AS "check", (SELECT (count(*) > 1)::BIGINT FROM ch WHERE a % 31 = 3) AS violations UNION ALL SELECT 'sentence_chosen_twice', 0
        UNION ALL SELECT 'unknown_sentence', count(*) FROM ch WHERE a % 37 = 4 UNION ALL SELECT 'other_article', count(*) FROM ch WHERE a % 37 <> 4 AND a <> b
        UNION ALL SELECT 'other_index', count(*) FROM ch WHERE a % 37 <> 4 AND a % 13 = 5 UNION ALL SELECT 'other_text', count(*) FROM ch WHERE a % 37 <> 4 AND a % 17 = 6 AND upper(text) <> text
        UNION ALL SELECT 'ineligible', count(*) FROM ch WHERE a % 37 <> 4 AND i = 0 UNION ALL SELECT 'score', count(*) FROM ch WHERE a % 19 = 7 UNION ALL SELECT 'no_source', count(*) FROM ch WHERE a % 23 = 8
        UNION ALL SELECT 'unknown_article', count(DISTINCT b) FROM ch WHERE b NOT IN (SELECT a FROM t)
        UNION ALL SELECT 'depth', count(*) FROM w LEFT JOIN per ON per.b = w.a WHERE coalesce(n, 0) <> wanted OR (n > 0 AND (lo <> 1 OR hi <> n OR u <> n))""",
    "decomposition_checks": r"""WITH f AS (SELECT conv_id AS s, text FROM conversations WHERE turn = 0),
        a AS (SELECT s, 'claim' AS part, '1' AS ref, CASE WHEN s % 11 = 1 THEN 'claim_ref' WHEN s % 7 = 2 OR trim(substr(text, 1, 5)) = '' THEN 'not a quote' WHEN s % 13 = 3 THEN 'not English' END AS problem FROM f),
        b AS (SELECT s, 'claim', '2', CASE WHEN trim(substr(text, 1, 6)) = '' THEN 'not a quote' WHEN s % 5 = 4 AND s % 13 <> 3 THEN 'repeated claim' WHEN s % 5 <> 4 AND s % 17 = 5 THEN 'not one sentence' END FROM f),
        p AS (SELECT s, unnest(CASE WHEN s % 6 = 1 THEN [1, 2] ELSE [1] END) AS k FROM f),
        c AS (SELECT s, 'step', k::VARCHAR, CASE WHEN s % 9 <> 1 AND s % 19 = 2 THEN 'no premise' WHEN (s % 9 <> 1 AND s % 19 <> 2 AND s % 23 = 3) OR s % 11 = 1 THEN 'unknown claim' WHEN s % 9 = 1 THEN 'circular' WHEN k = 2 THEN 'repeated step' END FROM p)
        SELECT s AS statement_id, part, ref, problem FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) WHERE problem IS NOT NULL""",
    "article_contexts": """WITH x AS (SELECT doc_id, text, CASE WHEN doc_id % 11 = 3 THEN length(text) ELSE doc_id % 20 END AS s, substr(text, doc_id % 20 + CASE WHEN doc_id % 7 = 1 THEN 2 ELSE 1 END, 25) AS cut FROM documents)
        SELECT doc_id AS article_id, 'e' || doc_id AS evidence_id, doc_id % 5 <> 2 AS fingerprint_verified, s + 25 <= length(text) AS in_range, s + 25 <= length(text) AND substr(text, s + 1, 25) = cut AS in_place FROM x""",
    "recomputed_masses": f"""WITH m AS ({_MASS.format(pred=PRED, k='claim_id')}) SELECT side, n FROM (SELECT 'stored' AS side, count(*) AS n FROM m WHERE claim_id % 9 <> 4 AND claim_id % 7 = 3 UNION ALL SELECT 'recomputed', count(*) FROM m WHERE claim_id % 9 = 4 OR claim_id % 7 = 3) WHERE n > 0""",
    "analysis_checks": """WITH b AS (SELECT item_id AS k, upper(text) <> text AS bent, CASE WHEN item_id % 4 = 1 THEN 'failed' ELSE 'completed' END AS st FROM benchmark), r AS (SELECT * FROM b WHERE k % 17 <> 2),
        p AS (SELECT k % 6 AS s, CASE WHEN count(*) FILTER (WHERE st = 'failed') = 0 THEN 'completed' WHEN count(*) FILTER (WHERE st = 'failed') < count(*) THEN 'partial_failure' ELSE 'failed' END AS want FROM r GROUP BY 1)
        SELECT 'missing_result' AS "check", count(*) AS violations FROM b WHERE k % 13 <> 5 AND k % 17 = 2 UNION ALL SELECT 'stray_result', count(*) FROM r WHERE k % 13 = 5
        UNION ALL SELECT 'other_claim', count(*) FROM r WHERE k % 13 <> 5 AND k % 19 = 3 AND bent UNION ALL SELECT 'result_fields', count(*) FROM r WHERE st = 'failed' AND k % 7 = 1
        UNION ALL SELECT 'statement_status', count(*) FROM p WHERE want <> CASE s WHEN 0 THEN 'completed' WHEN 3 THEN 'failed' ELSE 'partial_failure' END""",
    "presentation_checks": f"""WITH {STEPS}, {_STEPS_OF}, k AS (SELECT claims.claim_id, evidence_status, coalesce(i.n, 0) AS into_n, coalesce(o.n, 0) AS out_n, coalesce(g, false) AS g FROM claims LEFT JOIN i USING (claim_id) LEFT JOIN o USING (claim_id))
        SELECT 'role' AS "check", count(*) AS violations FROM k WHERE claim_id % 8 = 1 UNION ALL SELECT 'integrity', 0 UNION ALL SELECT 'incoming', 0
        UNION ALL SELECT 'outgoing', coalesce(sum(out_n), 0)::BIGINT FROM k WHERE claim_id % 10 = 3 UNION ALL SELECT 'gapped', count(*) FROM k WHERE claim_id % 12 = 2 AND NOT g""",
}
