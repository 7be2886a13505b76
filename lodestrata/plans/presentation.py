"""Queries over articles, sentences and what is shown of a run."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions.text import abstract_of, title_of
from lodestrata.operators import argument, articles, presentation, stance
from lodestrata.operators.corpus import violations
from lodestrata.operators.fusion import fused
from lodestrata.plans.evaluation import RUNS, _runs
from lodestrata.plans.graphs import PRED, STEPS, _claims_steps, _predictions
from lodestrata.plans.roles import table


def _articles(spark, d):
    """Documents as articles; every third has its abstract under two headings."""
    rows = table(spark, d, "documents").select("doc_id", title_of(F.col("text")).alias("title"), abstract_of(F.col("text")).alias("a"))
    headed = F.concat(F.lit("Intro. BACKGROUND: "), F.col("a"), F.lit(" Conclusions and  relevance : done."))
    return rows.select("doc_id", "title", F.when(F.col("doc_id") % 3 == 0, headed).otherwise(F.col("a")).alias("abstract"))


def article_segments(spark, d):
    return articles.segments(_articles(spark, d), "doc_id").select("doc_id", "section_index", "section", F.length("text").alias("chars"), "document_start")


def article_sentences(spark, d):
    return articles.sentences(articles.segments(_articles(spark, d), "doc_id"), "doc_id").drop("sentence_text")


def sentence_checks(spark, d):
    parts = articles.segments(_articles(spark, d), "doc_id")
    texts = parts.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_index", "text"))), lambda s: s["text"]), "\n\n").alias("source_text"))
    return articles.sentence_violations(articles.sentences(parts, "doc_id"), texts, "doc_id")


def highlight_segments(spark, d):
    """Turns cut at four ranges that overlap."""
    one = lambda k, s, e: F.struct(F.lit(k).alias("id"), F.lit(s).alias("start"), F.lit(e).alias("end"))
    rows = table(spark, d, "conversations").where("turn = 0").select("conv_id", F.length("text").alias("n"), F.array(one(1, 0, 10), one(2, 5, 20), one(3, 15, 10_000), one(4, 7, 7)).alias("ranges"))
    out = articles.range_segments(rows, "conv_id", "n", "ranges")
    return out.groupBy("conv_id").agg(F.count("*").alias("pieces"), F.sum((F.col("end") - F.col("start")) * F.size("ids")).cast("long").alias("covered"))


def evidence_types(spark, d):
    words = F.element_at(F.array(*map(F.lit, ["Adverse event", "method", "finding", "", "risk-of-bias", "scope"])), (F.col("doc_id") % 6 + 1).cast("int"))
    return table(spark, d, "documents").groupBy(presentation.evidence_type(words).alias("evidence_type")).agg(F.count("*").alias("n"))


def retrieval_traces(spark, d):
    """Fused rows by what is wrong with their trace."""
    rows = fused(_runs(spark, d), "item_id", "doc_id")
    rows = rows.withColumn("judged_score", F.when(F.col("doc_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("judged_score")))
    sources = ["bm25", "judged"]
    problem = presentation.trace_problem(F.col("trace"), sources)
    return rows.withColumn("trace", presentation.retrieval_trace(sources)).groupBy(F.coalesce(problem, F.lit("sound")).alias("problem")).agg(F.count("*").alias("n"))


def evidence_states(spark, d):
    verdicts = stance.verdicts(_predictions(spark, d)).select("claim_id", "verdict")
    claims = table(spark, d, "benchmark").select(F.col("item_id").alias("claim_id"))
    states = claims.join(verdicts, "claim_id", "left").select(presentation.evidence_state(F.col("verdict")).alias("state"))
    return presentation.zero_filled(states, "state", [*presentation.STATES.values(), "ERROR"])


def role_summary(spark, d):
    return presentation.zero_filled(argument.roles(*_claims_steps(spark, d)), "role", ["PREMISE", "INTERMEDIATE", "CONCLUSION", "STANDALONE"])


def presentation_bundle(spark, d):
    """Claims with their evidence nested, as JSON."""
    rows = _predictions(spark, d)
    claims = rows.select("claim_id").distinct()
    out = presentation.nested(claims, rows.select("claim_id", "rank", "input_id", "label"), "claim_id", "evidence", ["rank"])
    return out.select("claim_id", F.size("evidence").alias("n"), F.sha2(F.to_json("evidence"), 256).alias("json_hash"))


def llm_execution_plan(spark, d):
    return presentation.execution_plan(table(spark, d, "conversations"), "conv_id", "text", 3)


def pool_audit(spark, d):
    sizes = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"), F.countDistinct("role").alias("roles"))
    return sizes.agg(F.count("*").alias("pools"), F.min("turns").alias("fewest"), F.max("turns").alias("most"), F.round(F.avg("turns"), 6).alias("mean"), F.max("chars").alias("largest"), F.max("roles").alias("roles"))


def rank_checks(spark, d):
    runs = _runs(spark, d)["bm25"]
    per = runs.groupBy("item_id").agg(F.count("*").alias("n"), F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.countDistinct("rank").alias("u"))
    return violations({"ranks": per.where("lo <> 1 or hi <> n or u <> n"), "finite": runs.where(F.isnan("score") | F.col("score").isNull()), "short": per.where("n < 50")})


def step_gaps(spark, d):
    """Steps by whether they have a gap, with the claims they conclude."""
    _, steps = _claims_steps(spark, d)
    return steps.groupBy("gap").agg(F.count("*").alias("steps"), F.countDistinct("conclusion").alias("claims"), F.sort_array(F.collect_set("conclusion")).cast("array<string>").alias("c")).select("gap", "steps", "claims", F.array_join("c", ",").alias("conclusions"))


def stage_seconds(spark, d):
    events = table(spark, d, "events")
    rows = events.select(F.col("event_type").alias("stage"), F.col("ts").alias("started"), (F.col("ts") + F.expr("interval 2 seconds")).alias("ended"))
    return presentation.stage_seconds(rows)


QUERIES = [article_segments, article_sentences, sentence_checks, highlight_segments, evidence_types, retrieval_traces, evidence_states, role_summary, presentation_bundle, llm_execution_plan, pool_audit, rank_checks, step_gaps, stage_seconds]

_LABELS = "|".join(sorted(articles.SECTION_LABELS, key=len, reverse=True))
_ARTICLES = f"""p AS (SELECT doc_id, replace(text, chr(13), '') AS t FROM documents),
q AS (SELECT doc_id, trim(CASE WHEN instr(t, chr(10)) > 0 THEN substr(t, 1, instr(t, chr(10)) - 1) ELSE t END) AS title, trim(CASE WHEN instr(t, chr(10)) > 0 THEN substr(t, instr(t, chr(10)) + 1) ELSE '' END) AS a FROM p),
art AS (SELECT doc_id, title, CASE WHEN doc_id % 3 = 0 THEN 'Intro. BACKGROUND: ' || a || ' Conclusions and  relevance : done.' ELSE a END AS abstract FROM q),
m AS (SELECT doc_id, title, abstract, string_split(regexp_replace(abstract, '(^|\\s)({_LABELS})\\s*:\\s*', '\\1{articles.OPEN}\\2{articles.CLOSE}', 'gi'), '{articles.OPEN}') AS ps FROM art),
raw AS (SELECT doc_id, 0 AS k, 'title' AS section, title AS text FROM m WHERE title <> ''
  UNION ALL SELECT doc_id, 1, 'abstract', regexp_replace(abstract, '^\\s+|\\s+$', '', 'g') FROM m WHERE len(ps) <= 2
  UNION ALL SELECT doc_id, k, CASE WHEN k = 1 THEN 'abstract' ELSE regexp_replace(lower(string_split(piece, '{articles.CLOSE}')[1]), '\\s+', '_', 'g') END,
    regexp_replace(CASE WHEN k = 1 THEN piece ELSE string_split(piece, '{articles.CLOSE}')[2] END, '^\\s+|\\s+$', '', 'g') FROM (SELECT doc_id, unnest(ps) AS piece, unnest(range(1, len(ps) + 1)) AS k FROM m WHERE len(ps) > 2))"""

ORACLE = {
    "article_segments": f"""WITH {_ARTICLES} SELECT doc_id, row_number() OVER w - 1 AS section_index, section, length(text) AS chars,
        coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS document_start FROM raw WHERE text <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY k)""",
    "article_sentences": rf"""WITH {_ARTICLES}, seg AS (SELECT doc_id, row_number() OVER w - 1 AS section_index, section, text, coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off
          FROM raw WHERE text <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
        cut AS (SELECT *, string_split(regexp_replace(text, '([.!?])(\s)', '\1' || chr(1) || '\2', 'g'), chr(1)) AS ps FROM seg),
        pc AS (SELECT doc_id, section_index, section, off, unnest(ps) AS piece, unnest(range(1, len(ps) + 1)) AS j FROM cut),
        o AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id, section_index ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before, regexp_replace(piece, '^\s+', '') AS bare FROM pc),
        s AS (SELECT doc_id, section_index, section, off, j, before + length(piece) - length(bare) AS st, regexp_replace(bare, '\s+$', '') AS core FROM o),
        t AS (SELECT *, st + length(core) AS en FROM s WHERE core <> '')
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY section_index, j) - 1 AS sentence_index, row_number() OVER (PARTITION BY doc_id, section_index ORDER BY j) - 1 AS sentence_index_within_section,
          CASE WHEN section = 'title' THEN 'title' ELSE 'abstract' END AS sentence_type, section, section_index, off + st AS character_start, off + en AS character_end, st AS section_character_start, en AS section_character_end,
          substr(sha256(doc_id || chr(0) || (off + st) || chr(0) || (off + en) || chr(0) || core), 1, 24) AS sentence_id FROM t""",
    "sentence_checks": "SELECT unnest(['contiguous', 'offsets_rise', 'text_in_place']) AS \"check\", 0::BIGINT AS violations",
    "highlight_segments": """WITH r AS (SELECT conv_id, length(text) AS n FROM conversations WHERE turn = 0), c AS (SELECT conv_id, n, list_sort(list_distinct([0, n, least(n, 10), least(n, 5), least(n, 20), least(n, 15)])) AS c FROM r)
        SELECT conv_id, len(c) - 1 AS pieces, least(n, 10) + (least(n, 20) - least(n, 5)) + (n - least(n, 15)) AS covered FROM c""",
    "evidence_types": "SELECT (['mixed_or_other', 'safety', 'method', 'direct_result', 'mixed_or_other', 'mixed_or_other', 'population_or_scope'])[CASE WHEN doc_id % 6 = 0 THEN 2 ELSE doc_id % 6 + 2 END] AS evidence_type, count(*) AS n FROM documents GROUP BY 1",
    "retrieval_traces": f"WITH {RUNS} SELECT CASE WHEN judged_rank IS NOT NULL AND doc_id % 5 = 0 THEN 'incomplete judged' ELSE 'sound' END AS problem, count(*) AS n FROM rrf GROUP BY 1",
    "evidence_states": f"""WITH {PRED}, v AS (SELECT claim_id, count(*) FILTER (WHERE label = 'support') AS s, count(*) FILTER (WHERE label = 'refute') AS r FROM pred GROUP BY 1),
        x AS (SELECT CASE WHEN s IS NULL THEN 'ERROR' WHEN s > 0 AND r > 0 THEN 'CONFLICTED' WHEN s > 0 THEN 'SUPPORTED' WHEN r > 0 THEN 'REFUTED' ELSE 'INSUFFICIENT' END AS state FROM benchmark LEFT JOIN v ON claim_id = item_id)
        SELECT category, count(state) AS n FROM (SELECT unnest(['SUPPORTED', 'REFUTED', 'CONFLICTED', 'INSUFFICIENT', 'ERROR']) AS category) LEFT JOIN x ON state = category GROUP BY 1""",
    "role_summary": f"""WITH {STEPS}, u AS (SELECT claim_id IN (SELECT premise FROM links) AS p, claim_id IN (SELECT next FROM links) AS c FROM claims),
        x AS (SELECT CASE WHEN p AND c THEN 'INTERMEDIATE' WHEN p THEN 'PREMISE' WHEN c THEN 'CONCLUSION' ELSE 'STANDALONE' END AS role FROM u)
        SELECT category, count(role) AS n FROM (SELECT unnest(['PREMISE', 'INTERMEDIATE', 'CONCLUSION', 'STANDALONE']) AS category) LEFT JOIN x ON role = category GROUP BY 1""",
    "presentation_bundle": f"""WITH {PRED} SELECT claim_id, count(*)::INTEGER AS n, sha256('[' || string_agg('{{"rank":' || rank || ',"input_id":' || input_id || ',"label":"' || label || '"}}', ',' ORDER BY rank) || ']') AS json_hash FROM pred GROUP BY 1""",
    "llm_execution_plan": """WITH p AS (SELECT conv_id, count(*) AS n, sum(length(text)) AS c FROM conversations GROUP BY 1) SELECT count(*) AS groups, sum(n)::BIGINT AS "rows", sum(CAST(ceil(n / 3) AS BIGINT))::BIGINT AS requests, sum(c)::BIGINT AS characters, max(n) AS largest_group FROM p""",
    "pool_audit": """WITH p AS (SELECT conv_id, count(*) AS turns, sum(length(text)) AS chars, count(DISTINCT role) AS roles FROM conversations GROUP BY 1)
        SELECT count(*) AS pools, min(turns) AS fewest, max(turns) AS most, round(avg(turns), 6) AS mean, max(chars)::BIGINT AS largest, max(roles) AS roles FROM p""",
    "rank_checks": f"""WITH {RUNS} SELECT 'ranks' AS "check", 0::BIGINT AS violations UNION ALL SELECT 'finite', 0 UNION ALL SELECT 'short', count(*) FROM (SELECT item_id FROM run_a GROUP BY 1 HAVING count(*) < 50)""",
    "step_gaps": f"WITH {STEPS} SELECT gap, count(*) AS steps, count(DISTINCT conclusion) AS claims, array_to_string(list_sort(list(DISTINCT conclusion)), ',') AS conclusions FROM steps GROUP BY 1",
    "stage_seconds": "WITH p AS (SELECT event_type AS stage, count(*) * 2.0::DOUBLE AS seconds FROM events GROUP BY 1) SELECT stage, seconds, round(seconds / (SELECT sum(seconds) FROM p), 6) AS share FROM p",
}
