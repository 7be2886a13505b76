"""Claims, articles, evidence, steps and gaps put together as bundles, and what a sound bundle keeps to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import duplicate_key, short_id
from lodestrata.operators.corpus import violations

#: What an article's stance says of its claim.
ARTICLE_RELATIONS = {"support": "article_supports", "refute": "article_refutes", "insufficient": "article_insufficient"}
VERDICTS = ("supported", "refuted", "mixed", "insufficient")


def node_id(kind: str, *key: Column) -> Column:
    return short_id(f"{kind}:", *[k.cast("string") for k in key], digits=16)


def final_nodes(articles: DataFrame, evidence: DataFrame) -> DataFrame:
    """(graph_id, node_id, node_type, claim_id, article_id, rank): a claim's node, those of its articles, and those of their evidence.

    articles: (claim_id, article_id, rank, stance); evidence: (claim_id, article_id, evidence_id, rank).
    """
    graph = node_id("graph", F.col("claim_id")).alias("graph_id")
    none = F.lit(None).cast("long")
    claim = articles.select("claim_id").distinct().select(graph, node_id("claim", F.col("claim_id")).alias("node_id"), F.lit("claim").alias("node_type"), "claim_id", none.alias("article_id"), none.alias("rank"))
    article = articles.select(graph, node_id("article", F.col("claim_id"), F.col("article_id")), F.lit("article"), "claim_id", F.col("article_id").cast("long"), F.col("rank").cast("long"))
    item = evidence.select(graph, node_id("evidence", F.col("evidence_id")), F.lit("evidence"), "claim_id", F.col("article_id").cast("long"), F.col("rank").cast("long"))
    return claim.union(article).union(item)


def final_edges(articles: DataFrame, evidence: DataFrame) -> DataFrame:
    """(graph_id, edge_id, source, target, relation): each article's stance towards its claim, and the evidence it contains."""
    graph = node_id("graph", F.col("claim_id")).alias("graph_id")
    article = node_id("article", F.col("claim_id"), F.col("article_id"))
    relation = F.element_at(F.create_map(*[F.lit(x) for pair in ARTICLE_RELATIONS.items() for x in pair]), F.col("stance"))
    says = articles.select(graph, article.alias("source"), node_id("claim", F.col("claim_id")).alias("target"), relation.alias("relation"))
    holds = evidence.select(graph, article.alias("source"), node_id("evidence", F.col("evidence_id")).alias("target"), F.lit("contains_evidence").alias("relation"))
    return says.union(holds).select("graph_id", short_id("", F.col("relation"), F.col("source"), F.col("target"), digits=24).alias("edge_id"), "source", "target", "relation")


def merged_evidence(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(claim_id, article_node_id, evidence_id, rank): evidence of all graphs in one table; its id is set in its claim's namespace, its parent found by the edges."""
    parent = edges.where("relation = 'contains_evidence'").select("graph_id", F.col("source").alias("article_node_id"), F.col("target").alias("node_id"))
    found = nodes.where("node_type = 'evidence'").join(parent, ["graph_id", "node_id"])
    return found.select("claim_id", "article_node_id", F.concat(F.col("claim_id").cast("string"), F.lit(":"), "node_id").alias("evidence_id"), "rank")


def merged_articles(nodes: DataFrame, evidence: DataFrame) -> DataFrame:
    """(claim_id, article_node_id, rank, evidence_ids): articles of all graphs, each with its evidence in order."""
    held = evidence.groupBy("article_node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "evidence_id"))), lambda x: x["evidence_id"]).alias("evidence_ids"))
    found = nodes.where("node_type = 'article'").select("claim_id", F.col("node_id").alias("article_node_id"), "rank")
    return found.join(held, "article_node_id", "left").withColumn("evidence_ids", F.coalesce("evidence_ids", F.array().cast("array<string>")))


def step_id(premises: Column, conclusion: Column) -> Column:
    """A step's id follows from its claims, whatever the order of the premises."""
    return short_id("step_", F.array_join(F.array_sort(premises.cast("array<string>")), ","), conclusion.cast("string"), digits=16)


def _blank(column: str) -> Column:
    return F.coalesce(F.trim(F.col(column).cast("string")), F.lit("")) == ""


def _repeated(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def bundle_violations(statements: DataFrame, claims: DataFrame, steps: DataFrame, articles: DataFrame, evidence: DataFrame) -> DataFrame:
    """(check, violations) of a statement bundle.

    statements: (statement_id, original_text, source_language, analysis_status, total_claims, completed_claims,
    failed_claims, articles, evidence); claims: (statement_id, claim_id, analysis_status, verdict, error,
    article_node_ids); steps: (statement_id, step_id, premises, conclusion); articles: (article_node_id, claim_id,
    stance, evidence_ids); evidence: (evidence_id, article_node_id, claim_id).
    """
    completed = F.col("analysis_status") == "completed"
    known = claims.select("claim_id").distinct()
    uses = steps.select("step_id", F.explode(F.array_append("premises", F.col("conclusion"))).alias("claim_id"))
    sorted_steps = steps.select("statement_id", F.array_sort("premises").alias("premises"), "conclusion")
    owner = articles.select("article_node_id", F.col("claim_id").alias("own_claim"))
    kept = evidence.groupBy("article_node_id").agg(F.array_sort(F.collect_set("evidence_id")).alias("real"))
    of_claim = articles.groupBy("claim_id").agg(F.array_sort(F.collect_set("article_node_id")).alias("real"))
    none = F.array().cast("array<string>")
    unlike = lambda given, real: F.array_sort(F.array_distinct(F.coalesce(given, none))) != F.coalesce(real, none)
    per = claims.groupBy("statement_id").agg(F.count("*").alias("c"), F.count_if(completed).alias("d"), F.count_if(F.col("analysis_status") == "failed").alias("f"))
    counted = articles.join(claims.select("claim_id", "statement_id").distinct(), "claim_id").groupBy("statement_id").agg(F.count("*").alias("a"), F.sum(F.size("evidence_ids")).alias("e"))
    sums = statements.join(per, "statement_id", "left").join(counted, "statement_id", "left")
    sums = sums.where(" or ".join(f"{x} <> coalesce({y}, 0)" for x, y in (("total_claims", "c"), ("completed_claims", "d"), ("failed_claims", "f"), ("articles", "a"), ("evidence", "e"))))
    return violations(
        {
            "statement_fields": statements.where(_blank("statement_id") | _blank("original_text") | _blank("source_language") | _blank("analysis_status")),
            "claim_identity": claims.where(_blank("claim_id")).select("claim_id").union(_repeated(claims, "claim_id").select("claim_id")),
            "claim_status": claims.where(~F.coalesce(F.col("analysis_status").isin("completed", "failed"), F.lit(False))),
            "completed_claim": claims.where(completed & (~F.coalesce(F.col("verdict").isin(*VERDICTS), F.lit(False)) | F.col("error").isNotNull())),
            "failed_claim": claims.where((F.col("analysis_status") == "failed") & (F.col("verdict").isNotNull() | (F.size(F.coalesce("article_node_ids", none)) > 0) | _blank("error"))),
            "step_premises": steps.where((F.size("premises") < 1) | (F.size(F.array_distinct("premises")) < F.size("premises"))),
            "step_references": uses.join(known, "claim_id", "left_anti").select("step_id").distinct(),
            "step_circle": steps.where(F.array_contains("premises", F.col("conclusion"))),
            "step_identity": steps.where(F.col("step_id") != step_id(F.col("premises"), F.col("conclusion"))),
            "step_repeated": _repeated(sorted_steps, "statement_id", "premises", "conclusion"),
            "article_identity": articles.where(_blank("article_node_id")).select("article_node_id").union(_repeated(articles, "article_node_id").select("article_node_id")),
            "article_claim": articles.join(claims.where(completed).select("claim_id").distinct(), "claim_id", "left_anti"),
            "article_stance": articles.where(~F.coalesce(F.col("stance").isin(*ARTICLE_RELATIONS), F.lit(False))),
            "evidence_identity": evidence.where(_blank("evidence_id")).select("evidence_id").union(_repeated(evidence, "evidence_id").select("evidence_id")),
            "evidence_article": evidence.join(owner, "article_node_id", "left_anti"),
            "evidence_claim": evidence.join(owner, "article_node_id").where("claim_id <> own_claim"),
            "article_evidence_ids": articles.join(kept, "article_node_id", "left").where(unlike(F.col("evidence_ids"), F.col("real"))),
            "claim_article_ids": claims.join(of_claim, "claim_id", "left").where(unlike(F.col("article_node_ids"), F.col("real"))),
            "summary": sums,
        }
    )


def gap_bundle(steps: DataFrame, analyses: DataFrame) -> DataFrame:
    """Per statement its steps' gap analyses in the order of the steps, and counts; a step without an analysis, or with two, is an error, as is one for no step.

    steps: (statement_id, position, step_id); analyses: (step_id, scope_gap boolean, causal_gap boolean).
    """
    once = analyses.groupBy("step_id").agg(F.count("*").alias("n"), F.first("scope_gap").alias("scope_gap"), F.first("causal_gap").alias("causal_gap"))
    both = steps.join(once, "step_id", "full_outer")
    problem = F.when(F.col("position").isNull(), "unknown step").when(F.col("n").isNull(), "no analysis").when(F.col("n") > 1, "several analyses")
    checked = F.when(problem.isNotNull(), F.raise_error(F.concat(problem, F.lit(": "), F.col("step_id").cast("string"))).cast("long")).otherwise(F.col("position").cast("long"))
    rows = both.withColumn("position", checked)
    listed = F.array_sort(F.collect_list(F.struct("position", "step_id", "scope_gap", "causal_gap")))
    return rows.groupBy("statement_id").agg(listed.alias("analyses"), F.count("*").alias("steps"), F.count_if("scope_gap").alias("scope_gaps"), F.count_if("causal_gap").alias("causal_gaps"))


def evidence_violations(evidence: DataFrame, sentences: DataFrame, articles: DataFrame, depth: int = 5) -> DataFrame:
    """(check, violations) of the evidence chosen for articles.

    evidence: (evidence_id, article_id, sentence_id, sentence_index, sentence_text, rank, score, source_rank);
    sentences: (sentence_id, article_id, sentence_index, sentence_text, eligible); articles: (article_id).
    """
    source = sentences.select("sentence_id", F.col("article_id").alias("a"), F.col("sentence_index").alias("i"), F.col("sentence_text").alias("t"), "eligible")
    found = evidence.join(source, "sentence_id", "left")
    wanted = articles.select("article_id").join(sentences.where("eligible").groupBy("article_id").agg(F.least(F.count("*"), F.lit(depth)).alias("wanted")), "article_id", "left")
    ranks = evidence.groupBy("article_id").agg(F.count("*").alias("n"), F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.countDistinct("rank").alias("u"))
    depths = wanted.join(ranks, "article_id", "left").where("coalesce(n, 0) <> coalesce(wanted, 0) or (n > 0 and (lo <> 1 or hi <> n or u <> n))")
    return violations(
        {
            "evidence_identity": evidence.where(_blank("evidence_id")).select("evidence_id").union(_repeated(evidence, "evidence_id").select("evidence_id")),
            "sentence_chosen_twice": _repeated(evidence, "sentence_id"),
            "unknown_sentence": found.where("a is null"),
            "other_article": found.where("a <> article_id"),
            "other_index": found.where("i <> sentence_index"),
            "other_text": found.where("t <> sentence_text"),
            "ineligible": found.where("not eligible"),
            "score": evidence.where(F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))),
            "no_source": evidence.where("source_rank is null"),
            "unknown_article": evidence.join(articles.select("article_id"), "article_id", "left_anti").select("article_id").distinct(),
            "depth": depths,
        }
    )


def decomposition_problems(claims: DataFrame, steps: DataFrame, statements: DataFrame) -> DataFrame:
    """(statement_id, part, ref, problem): what is wrong with a statement's claims and steps as a model gave them.

    claims: (statement_id, position from 1, claim_ref, source_text, canonical); steps: (statement_id, position,
    premise_refs, conclusion_ref); statements: (statement_id, original_text). A claim is quoted from its statement and
    named C1, C2, ... in order; its canonical form is one line with a letter A-Z, and no two claims of a statement are
    the same but for case, blanks and closing marks.
    """
    quote = F.trim(F.coalesce("source_text", F.lit("")))
    canonical = F.trim(F.coalesce("canonical", F.lit("")))
    key = duplicate_key(canonical)
    earlier = F.row_number().over(Window.partitionBy("statement_id", key).orderBy("position")) > 1
    rows = claims.join(statements, "statement_id", "left").withColumn("again", earlier)
    problem = (
        F.when(~F.trim(F.coalesce("claim_ref", F.lit(""))).eqNullSafe(F.concat(F.lit("C"), F.col("position").cast("string"))), "claim_ref")
        .when((quote == "") | ~F.coalesce(F.contains("original_text", quote), F.lit(False)), "not a quote")
        .when((canonical == "") | F.contains(canonical, F.lit("\n")), "not one sentence")
        .when(~canonical.rlike("[A-Za-z]"), "not English")
        .when(F.col("again"), "repeated claim")
    )
    bad_claims = rows.select("statement_id", F.lit("claim").alias("part"), F.col("position").cast("string").alias("ref"), problem.alias("problem"))
    refs = claims.groupBy("statement_id").agg(F.collect_set("claim_ref").alias("known"))
    premises = F.transform(F.coalesce("premise_refs", F.array().cast("array<string>")), lambda x: F.trim(x))
    end = F.trim(F.coalesce("conclusion_ref", F.lit("")))
    same = F.row_number().over(Window.partitionBy("statement_id", F.array_sort(premises), end).orderBy("position")) > 1
    known = F.coalesce("known", F.array().cast("array<string>"))
    wrong = (
        F.when(F.size(premises) == 0, "no premise")
        .when(F.size(F.array_except(F.array_append(premises, end), known)) > 0, "unknown claim")
        .when((F.size(F.array_distinct(premises)) < F.size(premises)) | F.array_contains(premises, end), "circular")
        .when(F.col("again"), "repeated step")
    )
    bad_steps = steps.withColumn("again", same).join(refs, "statement_id", "left").select("statement_id", F.lit("step").alias("part"), F.col("position").cast("string").alias("ref"), wrong.alias("problem"))
    return bad_claims.union(bad_steps).where("problem is not null")


def article_context(texts: DataFrame, evidence: DataFrame) -> DataFrame:
    """evidence with fingerprint_verified, in_range and in_place: whether the article's text is the one it was cut from, and stands where its offsets say.

    texts: (article_id, source_text); evidence: (article_id, evidence_id, character_start, character_end, text, fingerprint).
    """
    rows = evidence.join(texts, "article_id", "left")
    start, end = F.col("character_start"), F.col("character_end")
    in_range = F.coalesce((start >= 0) & (start < end) & (end <= F.length("source_text")), F.lit(False))
    there = F.substring(F.col("source_text"), (start + 1).cast("int"), (end - start).cast("int"))
    checked = {
        "fingerprint_verified": F.coalesce(F.sha2("source_text", 256) == F.col("fingerprint"), F.lit(False)),
        "in_range": in_range,
        "in_place": F.when(in_range, there == F.col("text")).otherwise(False),
    }
    return rows.withColumns(checked).drop("source_text")


def recomputed(stored: DataFrame, again: DataFrame) -> DataFrame:
    """(side, n): rows that only the stored table has, and rows that only the recomputed one has; none if they are the same.

    Rows are compared whole, repeats counted, without a join of each with each.
    """
    names = sorted(again.columns)
    if sorted(stored.columns) != names:
        raise ValueError(f"columns differ: {sorted(stored.columns)} and {names}")
    marked = stored.select(*names, F.lit(1).alias("of")).union(again.select(*names, F.lit(-1).alias("of")))
    left = marked.groupBy(*names).agg(F.sum("of").alias("n")).where("n <> 0")
    return left.groupBy(F.when(F.col("n") > 0, "stored").otherwise("recomputed").alias("side")).agg(F.sum(F.abs("n")).alias("n"))


def analysis_violations(results: DataFrame, decomposition: DataFrame) -> DataFrame:
    """(check, violations): an analysis covers its decomposition's claims, and its status follows from theirs.

    results: (statement_id, claim_id, canonical, status, verdict, error, statement_status); decomposition: (statement_id, claim_id, canonical).
    """
    per = results.groupBy("statement_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "failed").alias("f"), F.min("statement_status").alias("low"), F.max("statement_status").alias("high"))
    wanted = F.when(F.col("f") == 0, "completed").when(F.col("f") < F.col("n"), "partial_failure").otherwise("failed")
    both = decomposition.select("statement_id", "claim_id", F.col("canonical").alias("c")).join(results, ["statement_id", "claim_id"], "full_outer")
    return violations(
        {
            "missing_result": both.where("status is null"),
            "stray_result": both.where("c is null and status is not null"),
            "other_claim": both.where("c <> canonical"),
            "result_fields": results.where("(status = 'completed' and (verdict is null or error is not null)) or (status = 'failed' and (verdict is not null or error is null))"),
            "statement_status": per.where(~(F.col("low").eqNullSafe(wanted) & F.col("high").eqNullSafe(wanted))),
        }
    )


def presentation_violations(claims: DataFrame, steps: DataFrame) -> DataFrame:
    """(check, violations) of presented claims: roles and integrity in their domains, step links both ways, and integrity that follows from the gaps.

    claims: (claim_id, role, integrity, incoming_step_ids, outgoing_step_ids); steps: (step_id, premises, conclusion, gap).
    """
    into = claims.select("claim_id", F.explode("incoming_step_ids").alias("step_id"))
    out_of = claims.select("claim_id", F.explode("outgoing_step_ids").alias("step_id"))
    true_into = steps.select(F.col("conclusion").alias("claim_id"), "step_id")
    true_out = steps.select(F.explode(F.array_distinct("premises")).alias("claim_id"), "step_id")
    shown = claims.select("claim_id")
    gapped = steps.where("gap").select(F.col("conclusion").alias("claim_id")).distinct()
    return violations(
        {
            "role": claims.where(~F.col("role").isin("PREMISE", "INTERMEDIATE", "CONCLUSION", "STANDALONE")),
            "integrity": claims.where(~F.col("integrity").isin("ERROR", "NOT_APPLICABLE", "GAPPED", "INTACT")),
            "incoming": into.exceptAll(true_into.join(shown, "claim_id", "left_semi")).union(true_into.join(shown, "claim_id", "left_semi").exceptAll(into)),
            "outgoing": out_of.exceptAll(true_out.join(shown, "claim_id", "left_semi")).union(true_out.join(shown, "claim_id", "left_semi").exceptAll(out_of)),
            "gapped": claims.where("integrity = 'GAPPED'").join(gapped, "claim_id", "left_anti"),
        }
    )
