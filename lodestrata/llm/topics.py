"""Topics of texts: clusters of their words, fitted on every text of a table; every text is then labelled by the nearest one.

A text is its words' counts in hashed buckets, damped by a logarithm, weighted by rarity and scaled to length one. Each
language's mean is taken off, so that clusters part texts of one language rather than languages; then spherical k-means.

Words are counted once and the vectors written to the shared folder; rarity, means and each round of the clustering are
a pass over all of them. Vectors, means and centres are whole numbers, and so are all sums, which are therefore the same
however the rows lie. The driver sees sums alone: 16 KB for each topic and language.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.characters import BYTE_BLANK
from lodestrata.llm.common import discard, stored
from lodestrata.llm.sentence_spans import BATCH_CHARS, word_codes

BUCKETS = 2048
ROUNDS = 15
#: Languages that have a mean of their own, those of most texts; all others share one.
LANGUAGES = 64
#: Texts whose vectors a task lays out at once, 4 MB.
TEXTS = 256
#: Length of a text's vector; what means and centres, as whole numbers, are times as fine.
LENGTH, MEAN, CENTRE = 1 << 14, 1 << 8, 1 << 20
#: What remains of a vector without its language's mean counts as nothing below this length.
LEAST = 16


@dataclass(frozen=True)
class Topics:
    """weights (buckets); centres (topics x buckets); means (languages and one for all others x buckets); languages: rows of means."""

    weights: np.ndarray
    centres: np.ndarray
    means: np.ndarray
    languages: dict[str | None, int]

    def label(self, texts: list[str], langs: list[str | None]) -> np.ndarray:
        """Number of each text's topic, -1 for a text without words; of equally near topics the first."""
        out = np.empty(len(texts), np.int32)
        for low, high in _batches(texts):
            lengths, places, found = _sparse(texts[low:high])
            of = np.array([self.languages.get(x, len(self.languages)) for x in langs[low:high]], np.int64)
            vectors = _dense(lengths, places, _values(lengths, places, found, self.weights))
            out[low:high] = np.where(lengths > 0, self.nearest(vectors, of), -1)
        return out

    def nearest(self, vectors: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Number of the topic nearest to each vector less its language's mean."""
        return (MEAN * (vectors @ self.centres.T) - (self.means @ self.centres.T)[of]).argmax(axis=1)


def _batches(texts: list[str], most: int = TEXTS):
    low, held = 0, 0
    for k, text in enumerate(texts):
        if k > low and (k - low >= most or held + len(text) > BATCH_CHARS):
            yield low, k
            low, held = k, 0
        held += len(text)
    if low < len(texts):
        yield low, len(texts)


def counts(texts: list[str]) -> np.ndarray:
    """texts x BUCKETS: how many words of each text fall in each bucket."""
    of, codes = word_codes(texts)
    places = of * BUCKETS + (codes & np.uint64(BUCKETS - 1)).astype(np.int64)
    return np.bincount(places, minlength=len(texts) * BUCKETS).reshape(len(texts), BUCKETS)


def word_totals(texts: list[str]) -> np.ndarray:
    """Words of each text, as ASCII's blanks part them."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    ink = ~BYTE_BLANK[np.frombuffer(b"\n".join([*data, b""]), np.uint8)]
    ink[1:] &= ~ink[:-1].copy()
    return np.diff(np.searchsorted(np.flatnonzero(ink), np.cumsum([0, *(len(d) + 1 for d in data)])))


def _sparse(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets that each text holds, those buckets, words in them)."""
    found = counts(texts).ravel()
    at = np.flatnonzero(found)
    return np.bincount(at // BUCKETS, minlength=len(texts)), at % BUCKETS, found[at]


def _values(lengths: np.ndarray, places: np.ndarray, found: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The vectors' numbers at their places: whole, of length LENGTH."""
    value = np.rint(2048 * np.log1p(found) * weights[places])
    of = np.repeat(np.arange(len(lengths)), lengths)
    squares = np.bincount(of, value * value, len(lengths))
    return np.rint(value * (LENGTH / np.sqrt(np.maximum(squares, 1)))[of])


def _dense(lengths: np.ndarray, places: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros((len(lengths), BUCKETS))
    out[np.repeat(np.arange(len(lengths)), lengths), places] = values
    return out


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers in a column of binaries, and how many each holds."""
    column = column.cast(pa.binary())
    ends = np.frombuffer(column.buffers()[1], "<i4")[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held if held is not None else b"", np.uint8)[ends[0] : ends[-1]].view(kind)
    return data, np.diff(ends) // data.itemsize


def _binaries(numbers: np.ndarray, lengths: np.ndarray) -> pa.Array:
    ends = np.r_[0, np.cumsum(lengths * numbers.itemsize)].astype("<i4")
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(numbers.tobytes())])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task body, (h, lang, text) to (h, lang, places, counts); texts without words are left out."""
    for batch in batches:
        texts = batch.column(2).to_pylist()
        for low, high in _batches(texts):
            lengths, places, found = _sparse(texts[low:high])
            columns = [batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low), _binaries(places.astype("<u2"), lengths), _binaries(found.astype("<u4"), lengths)]
            yield pa.RecordBatch.from_arrays(columns, ["h", "lang", "places", "counts"]).filter(pa.array(lengths > 0))


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task body: in how many texts each bucket is, and last the number of texts."""
    sums = np.zeros(BUCKETS + 1, np.int64)
    for batch in batches:
        sums[:-1] += np.bincount(_flat(batch.column(2), "<u2")[0], minlength=BUCKETS)
        sums[-1] += batch.num_rows
    yield _parts({0: sums})


def _weighted(weights: np.ndarray, languages: dict[str | None, int]):
    """Task body, (h, lang, places, counts) to (h, of, places, vector): of is the language's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, lengths = _flat(batch.column(2), "<u2")
            values = _values(lengths, places, _flat(batch.column(3), "<u4")[0], weights)
            of = pa.array([languages.get(x, len(languages)) for x in batch.column(1).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), of, batch.column(2), _binaries(values.astype("<i2"), lengths)], ["h", "of", "places", "vector"])

    return run


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, their languages' numbers, their vectors laid out) of a batch, some rows at a time."""
    of = batch.column(1).to_numpy()
    (places, lengths), (values, _) = _flat(batch.column(2), "<u2"), _flat(batch.column(3), "<i2")
    ends = np.r_[0, np.cumsum(lengths)]
    for low in range(0, len(of), TEXTS):
        rows = slice(low, min(low + TEXTS, len(of)))
        part = slice(ends[rows.start], ends[rows.stop])
        yield rows, of[rows], _dense(lengths[rows], places[part], values[part])


def _of_languages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task body: for each language the sum of its vectors, and last their number."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for _, of, vectors in _vectors(batch):
            for k in np.unique(of).tolist():
                own = sums.setdefault(k, np.zeros(BUCKETS + 1, np.int64))
                own[:-1] += vectors[of == k].sum(axis=0).astype(np.int64)
                own[-1] += int((of == k).sum())
    yield _parts(sums)


def _scales(vectors: np.ndarray, of: np.ndarray, means: np.ndarray) -> np.ndarray:
    """What brings each vector less its language's mean to one length, as a whole number; 0 if nothing is left."""
    own = np.einsum("ij,ij->i", vectors, vectors)
    across = (vectors @ means.T)[np.arange(len(of)), of]
    left = np.sqrt(np.maximum(MEAN * MEAN * own - 2 * MEAN * across + np.einsum("ij,ij->i", means, means)[of], 0)) / MEAN
    return np.where(left < LEAST, 0, np.rint((1 << 26) / np.maximum(left, LEAST)))


def _first(means: np.ndarray, topics: int):
    """Task body: the texts of the least hashes, none alike, of which something is left without their means."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[int, int]] = {}
        for batch in batches:
            h, of = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            scale = np.concatenate([_scales(vectors, own, means) for _, own, vectors in _vectors(batch)] or [np.zeros(0)])
            open_ = np.flatnonzero(scale > 0)
            for k in open_[np.unique(np.stack([h[open_], of[open_]]), axis=1, return_index=True)[1]].tolist():
                place = (int(h[k]), int(of[k]))
                if len(held) >= topics and place >= max(held.values()):
                    break
                name = tuple(batch.column(c)[k].as_py() for c in (1, 2, 3))
                held[name] = min(place, held.get(name, place))
                if len(held) > topics:
                    del held[max(held, key=held.get)]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([[h for h, _ in held.values()], *zip(*held)], [pa.int64(), pa.int32(), pa.binary(), pa.binary()])], ["h", "of", "places", "vector"])

    return run


def _round(model: Topics):
    """Task body: for each topic the sum of its vectors by their scales, then the scales' sums by language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        topics, languages = len(model.centres), len(model.means)
        sums = np.zeros((topics, BUCKETS + languages), np.int64)
        for batch in batches:
            for _, of, vectors in _vectors(batch):
                scale, near = _scales(vectors, of, model.means), model.nearest(vectors, of)
                share = np.zeros((topics, len(of)))
                share[near, np.arange(len(of))] = scale
                sums[:, :BUCKETS] += (share @ vectors).astype(np.int64)
                np.add.at(sums, (near, BUCKETS + of), scale.astype(np.int64))
        yield _parts(dict(enumerate(sums)))

    return run


def _parts(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.astype("<i8").tobytes() for x in sums.values()], pa.binary())], ["k", "part"])


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task body: sums of the parts of each k, of their upper and lower halves, so that none can run over."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, part in zip(batch.column(0).to_pylist(), batch.column(1)):
            x = np.frombuffer(part.as_buffer(), "<i8")
            both = np.concatenate([x >> 32, x & 0xFFFFFFFF])
            sums[k] = sums[k] + both if k in sums else both
    yield _parts(sums)


def _summed(rows: DataFrame, task: Callable) -> dict[int, np.ndarray]:
    """Sums by k of what the task makes of all rows."""
    parts = rows.mapInArrow(task, "k int, part binary").repartition("k").mapInArrow(_halves, "k int, part binary")
    out = {}
    for r in parts.collect():
        upper, lower = np.frombuffer(r["part"], "<i8").astype(float).reshape(2, -1)
        out[r["k"]] = upper * 2.0**32 + lower
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    return np.rint(rows * (CENTRE / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)))


def fit(docs: DataFrame, topics: int = 8, seed: int = 42) -> Topics:
    """Topics of docs (doc_id, text, lang), from all texts with words, repeats included; without any, topics that label every text 0.

    Clusters start at the texts of the least hashes of seed and text, no two alike, and go through ROUNDS over all
    texts, fewer if nothing moves any more.
    """
    spark = docs.sparkSession
    texts = docs.where("text is not null").select(F.xxhash64(F.lit(seed), "text").alias("h"), F.col("lang").cast("string").alias("lang"), "text")
    found, found_path = stored(texts.mapInArrow(_counted, "h long, lang string, places binary, counts binary"), "word-counts")
    often = found.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    languages = {r["lang"]: k for k, r in enumerate(often)}
    none = Topics(np.ones(BUCKETS), np.zeros((1, BUCKETS)), np.zeros((len(languages) + 1, BUCKETS)), languages)
    if not often:
        discard(spark, found_path)
        return none
    held = _summed(found, _held)[0]
    weights = np.log((1 + held[-1]) / (1 + held[:-1]))
    vectors, path = stored(found.mapInArrow(_weighted(weights, languages), "h long, of int, places binary, vector binary"), "word-vectors")
    discard(spark, found_path)
    sums = _summed(vectors, _of_languages)
    sums.setdefault(len(languages), sum(sums.values()))  # languages that no text here has are met by the mean of all
    means = np.stack([np.rint(MEAN * sums[k][:-1] / sums[k][-1]) for k in range(len(languages) + 1)])
    start = vectors.mapInArrow(_first(means, topics), vectors.schema).groupBy("of", "places", "vector").agg(F.min("h").alias("h"))
    start = start.orderBy("h", "of", "places", "vector").limit(topics).collect()
    rows = np.zeros((max(len(start), 1), BUCKETS))
    for row, r in zip(rows, start):
        row[np.frombuffer(r["places"], "<u2")] = np.frombuffer(r["vector"], "<i2")
        row -= means[r["of"]] / MEAN
    model = Topics(weights, _unit(rows), means, languages)
    for _ in range(ROUNDS if start else 0):
        sums = _summed(vectors, _round(model))
        moved = model.centres.copy()
        for k in range(len(moved)):
            if sums[k][BUCKETS:].any():  # a topic that no text is nearest to stays where it is
                moved[k] = _unit((sums[k][:BUCKETS] - sums[k][BUCKETS:] @ means / MEAN)[None])[0]
        if np.array_equal(moved, model.centres):
            break
        model = Topics(weights, moved, means, languages)
    discard(spark, path)
    return model


def topic_column(model: Topics, text: Column, lang: Column) -> Column:
    """Number of each row's topic; -1 without words."""
    return judged_column(model, text, lang).getField("topic")


def judged_column(model: Topics, text: Column, lang: Column) -> Column:
    """(topic, words) of each row: number of its topic, -1 without words, and its words as ASCII's blanks part them."""
    shared = model

    @F.pandas_udf("topic int, words long")
    def judge(texts: pd.Series, langs: pd.Series) -> pd.DataFrame:
        held = texts.tolist()
        words = np.concatenate([word_totals(held[low:high]) for low, high in _batches(held)] or [np.zeros(0, np.int64)])
        return pd.DataFrame({"topic": shared.label(held, langs.tolist()), "words": words})

    return judge(F.coalesce(text, F.lit("")), lang)
