"""Stances: prediction columns and their checks, rank-weighted masses, verdicts, and the evidence graph as two tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Order of precedence among equals.
STANCES = ("support", "refute", "insufficient")
#: Spellings that mean a stance.
ALIASES = {"supports": "support", "supported": "support", "refutes": "refute", "refuted": "refute", "contradict": "refute", "not enough information": "insufficient", "nei": "insufficient", "neutral": "insufficient"}


def canonical_stance(label: Column) -> Column:
    """The stance a label spells; an unknown label is an error."""
    plain = F.lower(F.regexp_replace(label, r"(?U)^\s+|\s+$", ""))
    pairs = [F.lit(x) for pair in ALIASES.items() for x in pair]
    found = F.coalesce(F.try_element_at(F.create_map(*pairs), plain), plain)
    return F.when(found.isin(*STANCES), found).otherwise(F.raise_error(F.concat(F.lit("unknown stance: "), F.coalesce(label, F.lit("null")))).cast("string"))


def _probabilities() -> list[Column]:
    return [F.col(f"p_{s}") for s in STANCES]


def predicted(rows: DataFrame) -> DataFrame:
    """rows (p_support, p_refute, p_insufficient) with label, confidence and margin: argmax in the order of STANCES."""
    p = _probabilities()
    ordered = F.sort_array(F.array(*p), asc=False)
    top = F.greatest(*p)
    label = F.when(p[0] == top, STANCES[0]).when(p[1] == top, STANCES[1]).otherwise(STANCES[2])
    return rows.withColumns({"label": label, "confidence": top, "margin": F.get(ordered, F.lit(0)) - F.get(ordered, F.lit(1))})


def invalid_predictions(rows: DataFrame, sum_tolerance: float = 1e-4, tolerance: float = 1e-5) -> DataFrame:
    """(check, violations) for predictions: domain, sum, label, confidence, margin."""
    p = _probabilities()
    good = predicted(rows.withColumnsRenamed({c: f"given_{c}" for c in ("label", "confidence", "margin")}))
    checks = {
        "probability_domain": F.exists(F.array(*p), lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x > 1)),
        "probability_sum": F.abs(p[0] + p[1] + p[2] - 1) > sum_tolerance,
        "label_is_argmax": ~F.col("given_label").eqNullSafe(F.col("label")),
        "confidence": F.abs(F.col("given_confidence") - F.col("confidence")) > tolerance,
        "margin": F.abs(F.col("given_margin") - F.col("margin")) > tolerance,
    }
    counts = good.agg(*[F.count_if(c).alias(n) for n, c in checks.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("violations")) for n in checks])
    return counts.select(F.inline(pairs))


def repaired(rows: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Judge answers put right: sums within the tolerance are scaled to 1; a blank or unknown label becomes the argmax; where a known label isn't the argmax the two probabilities change places."""
    p = _probabilities()
    total = p[0] + p[1] + p[2]
    scaled = rows.withColumn("valid", F.abs(total - 1) <= tolerance).withColumns({f"p_{s}": F.try_divide(F.col(f"p_{s}"), total) for s in STANCES})
    known = F.coalesce(F.col("label").isin(*STANCES), F.lit(False))
    best = predicted(scaled.withColumn("given", F.when(known, F.col("label"))))
    final = F.coalesce("given", "label")
    own = F.when(final == STANCES[0], F.col("p_support")).when(final == STANCES[1], F.col("p_refute")).otherwise(F.col("p_insufficient"))
    swapped = {f"p_{s}": F.when(final == s, F.col("confidence")).when(F.col("label") == s, own).otherwise(F.col(f"p_{s}")) for s in STANCES}
    return best.withColumns(swapped | {"label": final}).drop("given", "confidence", "margin")


def masses(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: stance masses (probability over rank), direction, pattern, leader and the top input of each label.

    rows: keys, input_id, rank, label and the probabilities. Groups may be nested: call once for each key list.
    """
    sums = [F.sum(F.col(f"p_{s}") / F.col("rank")).alias(f"{s}_mass") for s in STANCES]
    top = [F.max_by("input_id", F.when(F.col("label") == s, F.struct((F.col(f"p_{s}") / F.col("rank")).alias("m"), (-F.col("rank")).alias("r"), (-F.col("input_id")).alias("i")))).alias(f"top_{s}") for s in STANCES]
    counts = [F.count_if(F.col("label") == s).alias(f"{s}_count") for s in STANCES]
    out = rows.groupBy(*keys).agg(*sums, *counts, *top)
    s, r, i = (F.col(f"{x}_mass") for x in STANCES)
    yes, no = F.col("support_count") > 0, F.col("refute_count") > 0
    return out.withColumns(
        {
            "directional_margin": s - r,
            "directional_share": F.coalesce(F.try_divide(s + r, s + r + i), F.lit(0.0)),
            "pattern": F.when(yes & no, "mixed").when(yes, "support_only").when(no, "refute_only").otherwise("none"),
            "conflict": yes & no,
            "leader": F.when((s >= r) & (s >= i), STANCES[0]).when(r >= i, STANCES[1]).otherwise(STANCES[2]),
        }
    )


def verdicts(rows: DataFrame, claim_key: str = "claim_id", id_key: str = "input_id") -> DataFrame:
    """Per claim: mixed, supported, refuted or insufficient, and the ids of each stance in order of rank."""
    ids = [
        F.transform(F.array_sort(F.collect_list(F.when(F.col("label") == s, F.struct("rank", id_key)))), lambda x: x[id_key]).alias(f"{s}_ids") for s in STANCES
    ]
    out = rows.groupBy(claim_key).agg(*ids)
    yes, no = F.size("support_ids") > 0, F.size("refute_ids") > 0
    return out.withColumn("verdict", F.when(yes & no, "mixed").when(yes, "supported").when(no, "refuted").otherwise("insufficient"))


def graph_nodes(rows: DataFrame) -> DataFrame:
    """(graph_id, node_id, node_type): a claim, its articles and its evidence. rows: claim_id, article_id, input_id, label."""
    graph = F.col("claim_id").cast("string").alias("graph_id")
    claim = rows.select(graph, F.concat(F.lit("claim:"), "claim_id").alias("node_id"), F.lit("claim").alias("node_type"))
    article = rows.select(graph, F.concat(F.lit("article:"), "article_id").alias("node_id"), F.lit("article").alias("node_type"))
    evidence = rows.select(graph, F.concat(F.lit("evidence:"), "input_id").alias("node_id"), F.lit("evidence").alias("node_type"))
    return claim.union(article).distinct().union(evidence)


def graph_edges(rows: DataFrame) -> DataFrame:
    """(graph_id, source, target, relation): retrieved_from, contains_evidence, and the stance of each evidence."""
    graph = F.col("claim_id").cast("string").alias("graph_id")
    claim, article, evidence = (F.concat(F.lit(f"{n}:"), c) for n, c in (("claim", "claim_id"), ("article", "article_id"), ("evidence", "input_id")))
    found = rows.select(graph, claim.alias("source"), article.alias("target"), F.lit("retrieved_from").alias("relation")).distinct()
    holds = rows.select(graph, article.alias("source"), evidence.alias("target"), F.lit("contains_evidence").alias("relation"))
    relation = F.when(F.col("label") == "support", "supports").when(F.col("label") == "refute", "refutes").otherwise("insufficient_for")
    says = rows.select(graph, evidence.alias("source"), claim.alias("target"), relation.alias("relation"))
    return found.union(holds).union(says)


def graph_violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(check, violations): one claim a graph, unique node ids, no loose ends, one parent and one stance an evidence."""
    from lodestrata.operators.corpus import violations

    ends = edges.select("graph_id", F.explode(F.array("source", "target")).alias("node_id"))
    evidence = nodes.where("node_type = 'evidence'").select("graph_id", "node_id")
    parents = evidence.join(edges.where("relation = 'contains_evidence'").select("graph_id", F.col("target").alias("node_id"), F.lit(1).alias("e")), ["graph_id", "node_id"], "left")
    says = evidence.join(edges.where("relation in ('supports', 'refutes', 'insufficient_for')").select("graph_id", F.col("source").alias("node_id"), F.lit(1).alias("e")), ["graph_id", "node_id"], "left")
    once = lambda rows: rows.groupBy("graph_id", "node_id").agg(F.count("e").alias("n")).where("n <> 1")
    return violations(
        {
            "one_claim": nodes.groupBy("graph_id").agg(F.count_if(F.col("node_type") == "claim").alias("n")).where("n <> 1"),
            "unique_nodes": nodes.groupBy("graph_id", "node_id").count().where("count > 1"),
            "dangling_edges": ends.join(nodes, ["graph_id", "node_id"], "left_anti"),
            "one_parent": once(parents),
            "one_stance": once(says),
        }
    )


def sentence_context(rows: DataFrame, group: str, index: str, text: str = "text", width: int = 1) -> DataFrame:
    """rows with context_before and context_after: the neighbouring ``width`` texts on lines of their own."""
    order = Window.partitionBy(group).orderBy(index)
    join = lambda low, high: F.array_join(F.collect_list(text).over(order.rowsBetween(low, high)), "\n")
    return rows.withColumns({"context_before": join(-width, -1), "context_after": join(1, width)})
