"""What is shown of a run: provenance traces, states, summaries with zeros filled in, nested bundles and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Verdicts and what they are shown as.
STATES = {"supported": "SUPPORTED", "refuted": "REFUTED", "mixed": "CONFLICTED", "insufficient": "INSUFFICIENT"}
#: Kinds of evidence, and other wordings of them.
EVIDENCE_TYPES = ("direct_result", "background", "method", "population_or_scope", "safety", "statistical_uncertainty", "mixed_or_other")
EVIDENCE_ALIASES = {
    "result": "direct_result",
    "study_result": "direct_result",
    "finding": "direct_result",
    "direct_evidence": "direct_result",
    "context": "background",
    "background_information": "background",
    "methods": "method",
    "methodology": "method",
    "population": "population_or_scope",
    "scope": "population_or_scope",
    "population_constraint": "population_or_scope",
    "scope_limitation": "population_or_scope",
    "safety_signal": "safety",
    "adverse_event": "safety",
    "adverse_events": "safety",
    "uncertainty": "statistical_uncertainty",
    "statistical_limitation": "statistical_uncertainty",
    "non_significant_result": "statistical_uncertainty",
}


def _mapped(value: Column, names: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), value)


def evidence_type(value: Column) -> Column:
    """A kind of evidence; wording that isn't known is mixed_or_other, never an error."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(value, F.lit("")), r"(?U)^\s+|\s+$", "")), "[- ]", "_")
    found = F.coalesce(_mapped(plain, EVIDENCE_ALIASES), plain)
    return F.when(found.isin(*EVIDENCE_TYPES), found).otherwise("mixed_or_other")


def evidence_state(verdict: Column) -> Column:
    """How a verdict is shown; a missing or unknown one is ERROR."""
    return F.coalesce(_mapped(verdict, STATES), F.lit("ERROR"))


def positive_int(value: Column) -> Column:
    """A whole number above zero, or null: for text, NaN, infinities, fractions and anything else."""
    number = value.try_cast("double")
    whole = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < 9e15)
    return F.when(whole & (number == F.floor(F.when(whole, number))) & (number > 0), F.when(whole, number).cast("long"))


def finite(value: Column) -> Column:
    number = value.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


def retrieval_trace(sources: list[str]) -> Column:
    """struct of each source's rank and score, the fusion's and the final ones; from columns {source}_rank and {source}_score."""
    one = lambda s: F.struct(positive_int(F.col(f"{s}_rank")).alias("rank"), finite(F.col(f"{s}_score")).alias("score")).alias(s)
    return F.struct(*[one(s) for s in sources], F.struct(positive_int(F.col("fusion_rank")).alias("rank"), finite(F.col("fusion_score")).alias("score")).alias("fusion"))


def trace_problem(trace: Column, sources: list[str]) -> Column:
    """What is wrong with a trace, or null: a source with a rank or a score but not both, or no fusion rank."""
    torn = F.lit(None).cast("string")
    for s in reversed(sources):
        torn = F.when(trace[s]["rank"].isNull() != trace[s]["score"].isNull(), F.lit(f"incomplete {s}")).otherwise(torn)
    return F.when(trace["fusion"]["rank"].isNull(), "no fusion rank").otherwise(torn)


def zero_filled(rows: DataFrame, column: str, categories: list[str]) -> DataFrame:
    """(category, n) of all categories, those that don't occur too."""
    spark = rows.sparkSession
    names = spark.createDataFrame([(c,) for c in categories], "category string")
    counts = rows.groupBy(F.col(column).alias("category")).agg(F.count("*").alias("n"))
    return names.join(counts, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))


def nested(parents: DataFrame, children: DataFrame, key: str, name: str, order: list[str]) -> DataFrame:
    """parents with their children as one array column of structs, in order; none is an empty array."""
    fields = [c for c in children.columns if c != key]
    lists = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in fields if c not in order]))).alias(name))
    kind = lists.schema[name].dataType
    return parents.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def stage_seconds(rows: DataFrame) -> DataFrame:
    """(stage, seconds, share) from (stage, started, ended)."""
    per = rows.groupBy("stage").agg(F.round(F.sum(F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) / 1e6, 3).alias("seconds"))
    total = per.agg(F.sum("seconds").alias("total"))
    return per.join(F.broadcast(total)).select("stage", "seconds", F.round(F.try_divide(F.col("seconds"), F.col("total")), 6).alias("share"))


def execution_plan(rows: DataFrame, group: str, text: str, batch: int) -> DataFrame:
    """One row: groups, rows, requests when a group's rows go ``batch`` at a time, and characters."""
    per = rows.groupBy(group).agg(F.count("*").alias("n"), F.sum(F.length(text)).alias("chars"))
    return per.agg(F.count("*").alias("groups"), F.sum("n").alias("rows"), F.sum(F.ceil(F.col("n") / batch)).alias("requests"), F.sum("chars").alias("characters"), F.max("n").alias("largest_group"))


def markdown(summary: DataFrame, title: str, most: int = 1000) -> str:
    """A summary of at most ``most`` rows as a Markdown table; a larger one is an error, as it isn't a summary."""
    rows = summary.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", "| " + " | ".join(summary.columns) + " |", "|" + "-|" * len(summary.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]) + "\n"
