"""BM25: index statistics, top-k search, scores of given candidates, and pools with statistics of their own.

A search reads the texts once: tokens that no query asks for are dropped where they are made, and what is left of each
document (its length, and numbers of terms with their counts) is written as one row. Statistics and scores come from that
table. Queries go to every task as numbers too; a task scores its documents block by block and hands on the best k of
each query alone, so pairs of queries and documents are never shuffled, however common a word they share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import tokens
from lodestrata.storage import stored

#: Rows (query, term) of queries that go to every task: some 16 bytes each, and the terms' own text. More are joined by shuffles.
MOST_QUERY_TERMS = 1_000_000
#: Scores of documents by queries that a task holds at once.
BLOCK_SCORES = 1 << 21


def tokenised(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, terms, dl): a document's tokens and how many they are."""
    return docs.select(F.col(key), tokens(F.col(text)).alias("terms")).withColumn("dl", F.size("terms"))


def query_terms(queries: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, term, qtf): a term that occurs twice in a query counts twice."""
    found = queries.select(F.col(key), F.explode(tokens(F.col(text))).alias("term"))
    return found.groupBy(key, "term").agg(F.count("*").alias("qtf"))


def postings(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, term, tf, dl): the inverted index; write it partitioned by a hash of term to search it often."""
    found = tokenised(docs, key, text)
    return found.select(key, "dl", F.explode("terms").alias("term")).groupBy(key, "term", "dl").agg(F.count("*").alias("tf"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def saturation(tf: Column, dl: Column, avgdl: Column, k1: float, b: float) -> Column:
    return tf / (tf + k1 * (1 - b + b * dl / avgdl))


def scored(docs: DataFrame, queries: DataFrame, doc_key: str = "doc_id", query_key: str = "item_id", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query, document, score) for every pair that shares a term: by shuffles, for query sets of any size.

    Scores are rounded to 9 places so that ties don't hang on the order of summation.
    """
    terms = query_terms(queries, query_key)
    found = tokenised(docs, doc_key)
    totals = found.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    wanted = terms.select("term").distinct()
    hits = found.select(doc_key, "dl", F.explode("terms").alias("term")).join(wanted, "term", "left_semi")
    tf = hits.groupBy(doc_key, "term", "dl").agg(F.count("*").alias("tf"))
    weights = tf.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(totals))
    weighted = tf.join(weights, "term").withColumn("w", idf(F.col("n"), F.col("df")) * saturation(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b))
    pairs = weighted.join(terms, "term").groupBy(query_key, doc_key)
    return pairs.agg(F.round(F.sum(F.col("qtf") * F.col("w")), 9).alias("score"))


@dataclass(frozen=True)
class _Asked:
    """Queries as numbers: for term t the queries first[t] .. first[t + 1] of ``query`` with ``weight``, their count of it times its idf."""

    first: np.ndarray
    query: np.ndarray
    weight: np.ndarray
    queries: int
    avgdl: float
    k1: float
    b: float

    def blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        """(keys, scores, shared): documents by queries, and whether they share a term; from rows (key, dl, terms, tfs)."""
        rows = max(1, BLOCK_SCORES // max(1, self.queries))
        for batch in batches:
            for low in range(0, batch.num_rows, rows):
                part = batch.slice(low, rows)
                row, term, share = self.shares(part)
                times = self.first[term + 1] - self.first[term]
                of = np.repeat(np.arange(len(term)), times)
                asked = np.repeat(self.first[term] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(len(of))
                place = row[of] * self.queries + self.query[asked]
                shape = (part.num_rows, self.queries)
                scores = np.bincount(place, self.weight[asked] * share[of], part.num_rows * self.queries).astype(float).reshape(shape)
                yield part.column(0), np.round(scores, 9), np.bincount(place, minlength=part.num_rows * self.queries).reshape(shape) > 0

    def shares(self, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, saturation) of each posting."""
        dl = part.column(1).to_numpy().astype(float)
        row = np.repeat(np.arange(part.num_rows), pc.list_value_length(part.column(2)).to_numpy(zero_copy_only=False))
        term, tf = part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy().astype(float)
        return row, term, tf / (tf + self.k1 * (1 - self.b + self.b * dl[row] / self.avgdl))


def _compact(docs: DataFrame, key: str, terms: list[str]) -> DataFrame:
    """(key, dl, terms, tfs), a row for each document: of the terms asked for, by number, how often it holds them; written once."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value, pa.string())
        for batch in batches:
            lengths = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            number = pc.index_in(batch.column(1).flatten(), known)
            hit = np.flatnonzero(np.asarray(number.is_valid()))
            row = np.repeat(np.arange(batch.num_rows), lengths)[hit]
            code, tf = np.unique(row * len(known) + number.fill_null(0).to_numpy()[hit], return_counts=True)
            row, term = code // max(1, len(known)), code % max(1, len(known))
            offsets = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (term, tf)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int32()), *lists], [key, "dl", "terms", "tfs"])

    found = docs.select(key, tokens(F.col("text")).alias("terms"))
    out = found.mapInArrow(run, f"{key} {found.schema[key].dataType.simpleString()}, dl int, terms array<int>, tfs array<int>")
    return stored(out, "postings")[0]


def _asked(docs: DataFrame, queries: DataFrame, doc_key: str, query_key: str, k1: float, b: float) -> tuple[DataFrame, _Asked, list] | None:
    """(postings, queries by number, their keys in order), or None if the queries are too many to go to every task."""
    rows = query_terms(queries, query_key).limit(MOST_QUERY_TERMS + 1).collect()
    if len(rows) > MOST_QUERY_TERMS:
        return None
    names, terms = sorted({r[0] for r in rows if r[0] is not None}), sorted({r["term"] for r in rows})
    postings = _compact(docs, doc_key, terms)
    facts = postings.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    df = np.zeros(max(1, len(terms)))
    for r in postings.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row a term asked for
        df[r["t"]] = r["count"]
    query_of, term_of = {q: k for k, q in enumerate(names)}, {t: k for k, t in enumerate(terms)}
    triples = np.array(sorted((term_of[r["term"]], query_of[r[0]], r["qtf"]) for r in rows if r[0] is not None), np.int64).reshape(-1, 3)
    first = np.searchsorted(triples[:, 0], np.arange(len(terms) + 1))
    weight = triples[:, 2] * np.log(1 + (facts["n"] - df[triples[:, 0]] + 0.5) / (df[triples[:, 0]] + 0.5))
    return postings, _Asked(first, triples[:, 1], weight, len(names), facts["avgdl"] or 1.0, k1, b), names


def _keys(column: pa.Array) -> np.ndarray:
    out = column.to_numpy(zero_copy_only=False)
    return np.array([str(x) for x in out]) if out.dtype == object else out


def _best(asked: _Asked, k: int, doc_key: str):
    """Task body, postings to (q, document, score): the k best documents of each query among the task's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        for column, scores, shared in asked.blocks(batches):
            if scores.size == 0:
                continue
            scores[~shared] = -np.inf
            if len(scores) > k:
                shared &= scores >= np.partition(scores, len(scores) - k, axis=0)[len(scores) - k]  # ties stay
            row, q = np.nonzero(shared)
            found = (q, _keys(column)[row], scores[row, q])
            if best is not None:
                found = tuple(np.concatenate(x) for x in zip(best, found))
            order = np.lexsort((found[1], -found[2], found[0]))
            q = found[0][order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            best = tuple(x[order][place < k] for x in found)
        if best is not None and len(best[0]):
            yield pa.RecordBatch.from_arrays([pa.array(best[0], pa.int32()), pa.array(best[1]), pa.array(best[2])], ["q", doc_key, "score"])

    return run


def _named(found: DataFrame, queries: DataFrame, query_key: str, names: list) -> DataFrame:
    """found with its queries' keys instead of their numbers q."""
    kind = queries.schema[query_key].dataType.simpleString()
    numbers = found.sparkSession.createDataFrame(list(enumerate(names)), f"q int, {query_key} {kind}")
    return found.join(F.broadcast(numbers), "q").drop("q")  # at most MOST_QUERY_TERMS rows


def top_k(scores: DataFrame, query_key: str, doc_key: str, k: int | None = 10, score: str = "score") -> DataFrame:
    """scores with rank: by score, then by key; k rows of each query at most."""
    place = Window.partitionBy(query_key).orderBy(F.desc(score), F.asc(doc_key))
    ranked = scores.withColumn("rank", F.row_number().over(place))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, k: int = 10, exclude: DataFrame | None = None, doc_key: str = "doc_id", query_key: str = "item_id", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query, document, score, rank): top k documents of each query that share a term with it; pairs in ``exclude`` are taken out before the cut.

    Keys are numbers or strings. So that enough is left, as many more are fetched as a query has exclusions at most.
    """
    found = _asked(docs, queries, doc_key, query_key, k1, b)
    if found is None:
        scores = scored(docs, queries, doc_key, query_key, k1, b)
    else:
        postings, asked, names = found
        more = 0
        if exclude is not None:
            more = exclude.groupBy(query_key).count().agg(F.max("count")).first()[0] or 0
        kind = docs.schema[doc_key].dataType.simpleString()
        scores = _named(postings.mapInArrow(_best(asked, k + more, doc_key), f"q int, {doc_key} {kind}, score double"), queries, query_key, names)
        scores = scores.select(query_key, doc_key, "score")
    if exclude is not None:
        scores = scores.join(exclude.select(query_key, doc_key), [query_key, doc_key], "left_anti")
    return top_k(scores, query_key, doc_key, k)


def score_candidates(docs: DataFrame, queries: DataFrame, candidates: DataFrame, doc_key: str = "doc_id", query_key: str = "item_id", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """candidates (query, document, ...) with their score; a pair without a common term has score 0. Only candidates are scored."""
    found = _asked(docs, queries, doc_key, query_key, k1, b)
    if found is None:
        scores = scored(docs, queries, doc_key, query_key, k1, b)
    else:
        postings, asked, names = found
        numbers = docs.sparkSession.createDataFrame(list(enumerate(names)), f"q int, {query_key} {queries.schema[query_key].dataType.simpleString()}")
        wanted = candidates.select(query_key, doc_key).distinct().join(F.broadcast(numbers), query_key).select(doc_key, "q")
        met = wanted.join(postings, doc_key).select(doc_key, "dl", "terms", "tfs", "q")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row, term, share = asked.shares(batch)
                # Postings and queries' terms are both sorted by (query, term), so a pair's weights are found by their place.
                wanted = batch.column(4).to_numpy()[row].astype(np.int64)
                code = np.repeat(np.arange(len(asked.first) - 1), np.diff(asked.first)) * max(1, asked.queries) + asked.query
                own = term * max(1, asked.queries) + wanted
                at = np.minimum(np.searchsorted(code, own), max(len(code) - 1, 0))
                hit = code[at] == own if len(code) else np.zeros(len(own), bool)
                scores = np.bincount(row[hit], asked.weight[at[hit]] * share[hit], batch.num_rows).astype(float)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), pa.array(np.round(scores, 9))], [doc_key, "q", "score"])

        kind = docs.schema[doc_key].dataType.simpleString()
        scores = _named(met.mapInArrow(run, f"{doc_key} {kind}, q int, score double"), queries, query_key, names)
    out = candidates.join(scores, [query_key, doc_key], "left")
    return out.withColumn("score", F.coalesce("score", F.lit(0.0)))


def pool_scores(pool: DataFrame, queries: DataFrame, pool_key: str, item_key: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(pool, item, score): BM25 whose statistics are the pool's own; every item of a pool gets a row.

    pool: (pool_key, item_key, text); queries: (pool_key, text), one a pool.
    """
    items = pool.select(pool_key, item_key, tokens(F.col("text")).alias("terms")).withColumn("dl", F.size("terms"))
    totals = items.groupBy(pool_key).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    tf = items.select(pool_key, item_key, "dl", F.explode("terms").alias("term")).groupBy(pool_key, item_key, "dl", "term").agg(F.count("*").alias("tf"))
    terms = query_terms(queries, pool_key)
    df = tf.groupBy(pool_key, "term").agg(F.count("*").alias("df"))
    hits = tf.join(terms, [pool_key, "term"]).join(df, [pool_key, "term"]).join(totals, pool_key)
    part = F.col("qtf") * idf(F.col("n"), F.col("df")) * (k1 + 1) * saturation(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)
    scores = hits.groupBy(pool_key, item_key).agg(F.round(F.sum(part), 9).alias("score"))
    return items.select(pool_key, item_key).join(scores, [pool_key, item_key], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
