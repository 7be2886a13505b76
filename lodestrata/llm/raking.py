"""Mixing by iterative proportional fitting.

Tokens are counted by cell (source, language and topic together); the cell weights are raked until their sums meet
every target share; documents are then sampled with the probability that gives each cell its weight of the budget.
Values that the targets don't name share the class OTHER and what the named targets leave, so the number of cells is
bounded by the parameters and the fit runs on the driver. Topics come with the table or are fitted on all of it (see topics).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import topics
from lodestrata.llm.common import WORD

OTHER = "other"
TOPICS = 8
TARGETS = {
    "source": {f"src{k}": 0.045 for k in range(20)},
    "lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1},
    "topic": {f"topic{k}": 1 / TOPICS for k in range(TOPICS)},
}
DIMENSIONS = ("source", "lang", "topic")


def _class(column: Column, named: dict[str, float]) -> Column:
    return F.when(column.isin(*named), column).otherwise(F.lit(OTHER)) if named else F.lit(OTHER)


def classed(docs: DataFrame, targets: dict[str, dict[str, float]], topic_col: str | None = None, seed: int = 42) -> DataFrame:
    """(row, i, x, source, lang, topic, tokens): docs' rows as structs, their ids and texts, classes and words.

    Topics are those of topic_col, or fitted on all of docs; then texts without words are OTHER.
    """
    if topic_col is None:
        found = topics.judged_column(topics.fit(docs, TOPICS, seed=seed), F.col("text"), F.col("lang"))
        number, tokens = found.getField("topic"), found.getField("words")
        topic = F.when(number >= 0, F.concat(F.lit("topic"), number.cast("string"))).otherwise(OTHER)
    else:
        topic = F.col(topic_col)
        tokens = F.size(F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(f"({WORD})"), F.lit(1))).cast("long")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("i"), F.col("text").alias("x"), "source", "lang", topic.alias("topic"), tokens.alias("tokens"))
    return rows.withColumns({d: _class(F.col(d), targets[d]) for d in DIMENSIONS})


def rake(cells: list[tuple], tokens: np.ndarray, targets: list[dict], rounds: int = 1000, tolerance: float = 1e-9) -> tuple[np.ndarray, float]:
    """(weights, miss): weights of the cells, summing to 1, whose sums by each dimension meet its targets.

    Starts at the cells' shares of tokens. Targets of classes that no cell has are dropped and the rest scaled to 1.
    Rounds end when all sums are within the tolerance or no longer come nearer. If targets contradict each other
    through empty cells they can't all be met: miss is the largest share by which a target is missed then.
    """
    weights = tokens / tokens.sum()
    plans = []
    for d, target in enumerate(targets):
        names, index = np.unique([c[d] for c in cells], return_inverse=True)
        wanted = np.array([target.get(n, max(0.0, 1 - sum(target.values())) if n == OTHER else 0.0) for n in names])
        plans.append((index, wanted / wanted.sum() if wanted.sum() > 0 else np.full(len(names), 1 / len(names))))

    def missed() -> float:
        return max(float(np.abs(np.bincount(index, weights, len(wanted)) - wanted).max()) for index, wanted in plans)

    for _ in range(rounds):
        before = weights
        for index, wanted in plans:
            have = np.bincount(index, weights, len(wanted))
            weights = weights * np.divide(wanted, have, out=np.zeros_like(wanted), where=have > 0)[index]
            weights = weights / weights.sum() if weights.sum() > 0 else before
        if missed() < tolerance or np.abs(weights - before).max() < tolerance / 1000:
            break
    return weights, missed()


def probabilities(weights: np.ndarray, tokens: np.ndarray, budget: float) -> np.ndarray:
    """Chance of each cell's documents: tokens * chance is in proportion to weight and sums to the budget; 1 at most.

    What cells that are taken whole can't give is shared among the others, again in proportion to weight.
    """
    chance = np.zeros(len(weights))
    whole = np.zeros(len(weights), bool)
    while True:
        free = ~whole & (weights > 0)
        left = budget - tokens[whole].sum()
        if left <= 0 or not free.any():
            break
        chance[free] = left * weights[free] / weights[free].sum() / tokens[free]
        over = free & (chance >= 1)
        chance[over] = 1
        if not over.any():
            break
        whole |= over
    return np.minimum(chance, 1)


def _fitted(rows: DataFrame, targets: dict[str, dict[str, float]], keep: float) -> tuple[list[tuple], float]:
    """((source, lang, topic, weight, chance) of each cell with tokens, miss)."""
    cells = rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("n")).where("n > 0").orderBy(*DIMENSIONS).collect()
    if not cells:
        return [], 0.0
    keys = [tuple(c)[:3] for c in cells]
    tokens = np.array([float(c["n"]) for c in cells])
    weights, miss = rake(keys, tokens, [targets[d] for d in DIMENSIONS])
    chance = probabilities(weights, tokens, keep * tokens.sum())
    return [(*k, float(w), float(p)) for k, w, p in zip(keys, weights, chance)], miss


def _drawn(docs: DataFrame, targets: dict[str, dict[str, float]], keep: float, seed: int, topic_col: str | None, most_miss: float) -> DataFrame:
    """(row, topic, n_tokens, weight, probability, miss, sampled)."""
    rows = classed(docs, targets, topic_col, seed)
    cells, miss = _fitted(rows, targets, keep)
    if miss > most_miss:
        raise ValueError(f"the targets contradict each other: one is missed by {miss:.3f}")
    table = docs.sparkSession.createDataFrame(cells, "source string, lang string, topic string, weight double, chance double")
    key = F.coalesce(F.col("i").cast("string"), F.col("x"), F.lit(""))
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 12), 16, 10).cast("double") / float(16**12)
    chance = F.coalesce("chance", F.lit(0.0))
    out = rows.join(F.broadcast(table), list(DIMENSIONS), "left")  # a row for each cell, which the targets bound
    return out.select("row", "topic", F.col("tokens").alias("n_tokens"), F.coalesce("weight", F.lit(0.0)).alias("weight"), chance.alias("probability"), F.lit(miss).alias("miss"), (drawn < chance).alias("sampled"))


def mixed(docs: DataFrame, targets: dict[str, dict[str, float]] = TARGETS, keep: float = 0.5, seed: int = 42, topic_col: str | None = None, most_miss: float = 1.0) -> DataFrame:
    """docs with topic, n_tokens, weight (its cell's share after raking), probability, miss and sampled added.

    A column of docs with one of these names is replaced; others may have any name. ``keep`` is the budget as a share
    of all tokens. The draw is a hash of seed and doc_id, so it is the same in every run and for repeated rows; a row
    without doc_id is drawn by its text. Null sources and languages are OTHER; a null or wordless text has no tokens,
    gains its cell nothing, and is drawn like its cell's others. In a cell without tokens nothing is sampled. miss is
    the same in all rows: the largest share by which a target can't be met; over ``most_miss`` it is an error. An empty
    table stays empty.
    """
    found = ["topic", "n_tokens", "weight", "probability", "miss", "sampled"]
    out = _drawn(docs, targets, keep, seed, topic_col, most_miss)
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in found], *found)


def sample(docs: DataFrame, targets: dict[str, dict[str, float]] = TARGETS, keep: float = 0.5, seed: int = 42, topic_col: str | None = None, most_miss: float = 1.0) -> DataFrame:
    """The sampled rows of docs, with all their columns."""
    return _drawn(docs, targets, keep, seed, topic_col, most_miss).where("sampled").select("row.*")
