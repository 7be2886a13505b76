"""Graphs of claims and inference steps, and of rows that belong together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.storage import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component): smallest node reachable, by spreading minima and jumping to the minimum's own minimum.

    edges: (a, b). Each round is written to the shared folder, which cuts lineage and survives lost executors; rounds
    go on until nothing changes. Each join is of two written tables, so adaptive execution splits a hot node's rows.
    """
    spark = edges.sparkSession
    both, edge_path = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels, path = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    while True:
        spread = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        nearer, near_path = stored(labels.join(spread, "node").select("node", F.least("component", "near").alias("component")), "nearer")
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("far"))
        new, new_path = stored(nearer.join(jump, "component").select("node", F.least("component", "far").alias("component")), "labels")
        changed = new.join(labels, "node").where(new.component != labels.component).limit(1).count()
        discard(spark, path, near_path)
        labels, path = new, new_path
        if not changed:
            discard(spark, edge_path)
            return labels


def closure(links: DataFrame) -> DataFrame:
    """(a, b, depth): b is reached from a over links (a, b), in ``depth`` of them at least; cycles included.

    A path of up to 2n links is one of exactly n links and a rest of up to n, so rounds double what is known: their
    number grows with the logarithm of the longest path, and each pair is made about once.
    """
    spark = links.sparkSession
    known, path = stored(links.select("a", "b").distinct().withColumn("depth", F.lit(1)), "reached")
    reach = 1
    while True:
        first = known.where(F.col("depth") == reach).select("a", F.col("b").alias("m"), F.col("depth").alias("d"))
        rest = known.select(F.col("a").alias("m"), "b", "depth")
        found = first.join(rest, "m").groupBy("a", "b").agg(F.min(F.col("d") + F.col("depth")).alias("depth"))
        fresh, fresh_path = stored(found.join(known, ["a", "b"], "left_anti"), "fresh")
        if not fresh.head(1):
            discard(spark, fresh_path)
            return known
        new, new_path = stored(known.union(fresh), "reached")
        discard(spark, path, fresh_path)
        known, path, reach = new, new_path, 2 * reach


def reachable(steps: DataFrame) -> DataFrame:
    """(step_id, claim_id, depth): claims that a step's conclusion leads to, cycles included; depth counts steps.

    steps: (step_id, premises array, conclusion).
    """
    links = steps.select(F.explode("premises").alias("a"), F.col("conclusion").alias("b"))
    further = closure(links).select(F.col("a").alias("conclusion"), "b", "depth")
    own = steps.select("step_id", "conclusion").distinct()
    found = own.select("step_id", F.col("conclusion").alias("claim_id"), F.lit(1).alias("depth")).union(own.join(further, "conclusion").select("step_id", "b", F.col("depth") + 1))
    return found.groupBy("step_id", "claim_id").agg(F.min("depth").alias("depth"))


def impacts(steps: DataFrame) -> DataFrame:
    """Per step: affected claims, terminal claims among them (no step leaves them), and whether it lies on a cycle."""
    reach = reachable(steps)
    leaves = steps.select(F.explode("premises").alias("claim_id")).distinct().withColumn("goes_on", F.lit(True))
    own = steps.select("step_id", F.explode("premises").alias("claim_id")).withColumn("own", F.lit(True)).distinct()
    rows = reach.join(leaves, "claim_id", "left").join(own, ["step_id", "claim_id"], "left")
    ends = F.when(F.col("goes_on").isNull(), F.col("claim_id"))
    return rows.groupBy("step_id").agg(
        F.count("*").alias("affected_claims"),
        F.sort_array(F.collect_set(ends)).alias("terminal_claim_ids"),
        F.bool_or(F.coalesce("own", F.lit(False))).alias("cycle_detected"),
        F.max("depth").alias("longest_path"),
    ).withColumn("affects_terminal_conclusion", F.size("terminal_claim_ids") > 0)


def roles(claims: DataFrame, steps: DataFrame) -> DataFrame:
    """(claim_id, role): PREMISE, INTERMEDIATE, CONCLUSION or STANDALONE."""
    uses = steps.select(F.explode("premises").alias("claim_id"), F.lit(True).alias("p"), F.lit(False).alias("c")).union(steps.select(F.col("conclusion"), F.lit(False), F.lit(True)))
    marks = uses.groupBy("claim_id").agg(F.bool_or("p").alias("p"), F.bool_or("c").alias("c"))
    p, c = F.coalesce("p", F.lit(False)), F.coalesce("c", F.lit(False))
    return claims.select("claim_id").join(marks, "claim_id", "left").select("claim_id", F.when(p & c, "INTERMEDIATE").when(p, "PREMISE").when(c, "CONCLUSION").otherwise("STANDALONE").alias("role"))


def audit(claims: DataFrame, steps: DataFrame) -> DataFrame:
    """Per claim: ERROR if its evidence failed, NOT_APPLICABLE without incoming steps, GAPPED if one has a gap, else INTACT; with the steps that do so.

    claims: (claim_id, evidence_status); steps: (step_id, conclusion, gap boolean).
    """
    into = steps.groupBy(F.col("conclusion").alias("claim_id")).agg(F.count("*").alias("incoming"), F.sort_array(F.collect_list(F.when(F.col("gap"), F.col("step_id")))).alias("gapped"))
    out = claims.join(into, "claim_id", "left")
    gapped = F.coalesce("gapped", F.array().cast("array<bigint>"))
    state = F.when(F.col("evidence_status") == "ERROR", "ERROR").when(F.coalesce("incoming", F.lit(0)) == 0, "NOT_APPLICABLE").when(F.size(gapped) > 0, "GAPPED").otherwise("INTACT")
    return out.select("claim_id", state.alias("integrity"), gapped.alias("affecting_step_ids"))


def run_status(rows: DataFrame, key: str) -> DataFrame:
    """(key, total, failed, status): completed, partial_failure or failed by how many of a run's parts failed."""
    out = rows.groupBy(key).agg(F.count("*").alias("total"), F.count_if(F.col("failed")).alias("failed"))
    return out.withColumn("status", F.when(F.col("failed") == 0, "completed").when(F.col("failed") < F.col("total"), "partial_failure").otherwise("failed"))


def nearest_cutoff(groups: DataFrame, order: list[str], size: str, target: int) -> DataFrame:
    """Whole groups, in order, up to the cumulative size nearest to the target; none if that is nearer, the fewer if two are equal.

    Groups are sorted by ranges and summed up within each; only a sum a range is put in order by one task.
    """
    spread = groups.select(F.struct(*[F.col(f"`{c}`") for c in groups.columns]).alias("row"), *[F.col(c).alias(f"o{k}") for k, c in enumerate(order)], F.col(size).alias("n"))
    keys = [f"o{k}" for k in range(len(order))]
    parts, _ = stored(spread.repartitionByRange(*keys).withColumn("p", F.spark_partition_id()), "ranges")
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    firsts = parts.groupBy("p").agg(F.sum("n").alias("s"), F.count("*").alias("c"))
    firsts = firsts.select("p", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c"))  # a row a range
    within = Window.partitionBy("p").orderBy(*keys)
    grown = parts.join(F.broadcast(firsts), "p").select("row", (F.col("s") + F.sum("n").over(within.rowsBetween(Window.unboundedPreceding, 0))).alias("cum"), (F.col("c") + F.row_number().over(within)).alias("k"))
    best = grown.agg(F.min(F.struct(F.abs(F.col("cum") - target).alias("off"), "k")).alias("b")).first()["b"]
    last = best["k"] if best is not None and best["off"] < target else 0
    return grown.where(F.col("k") <= last).select("row.*")
