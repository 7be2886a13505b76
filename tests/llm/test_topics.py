"""Topics are fitted on every row: weights, means and centres against a plain version over all texts."""

import random

import numpy as np
from pyspark.sql import functions as F

from lodestrata.llm import raking, topics


def made():
    """Over 2000 texts of three kinds in two languages, one kind of few texts, copies, and rows without words or language."""
    rng = random.Random(8)
    kinds = [[f"{kind}{k}" for k in range(12)] for kind in ("sea", "law", "sun")]
    rows = []
    for n in range(2600):
        kind = 2 if n % 40 == 0 else n % 2
        lang = ("en", "de")[n % 3 == 0]
        rows.append((n, " ".join(rng.choice(kinds[kind] + ["the", f"{lang}word"]) for _ in range(15)), lang))
    return rows + [(3000 + n, rows[5][1], "en") for n in range(300)] + [(4000, None, "en"), (4001, " ", "de"), (4002, "sea1 law2 sun3 sea4", None)]


def plain(rows, first, number):
    """(weights, centres) by spherical k-means in floating point, from the texts ``first``."""
    found = topics.counts([t for _, t, _ in rows])
    weights = np.log((1 + len(rows)) / (1 + (found > 0).sum(axis=0)))
    vectors = np.log1p(found) * weights
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    langs = np.array([x or "" for *_, x in rows])
    for x in set(langs.tolist()):
        vectors[langs == x] -= vectors[langs == x].mean(axis=0)
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = np.where(size > 1e-3, vectors / np.maximum(size, 1e-12), 0)
    place = {t: k for k, (_, t, _) in enumerate(rows)}
    centres = vectors[[place[t] for t in first[:number]]]
    for _ in range(topics.ROUNDS):
        near = (vectors @ centres.T).argmax(axis=1)
        centres = np.stack([vectors[near == k].sum(axis=0) if (near == k).any() else centres[k] for k in range(number)])
        centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    return weights, centres


def test_topics_come_from_all_rows(spark):
    rows = made()
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    hashed = frame.where("trim(text) <> '' and lang is not null").select("text", F.xxhash64(F.lit(42), "text").alias("h")).distinct().orderBy("h")
    weights, centres = plain([r for r in rows if r[1] and r[1].strip()], [r.text for r in hashed.limit(3).collect()], 3)
    model = topics.fit(frame.repartition(7), 3)
    assert np.allclose(model.weights, weights)
    assert np.allclose(model.centres / np.linalg.norm(model.centres, axis=1, keepdims=True), centres, atol=1e-3)
    again = topics.fit(frame.orderBy(F.desc("doc_id")).coalesce(2), 3)
    assert np.array_equal(again.centres, model.centres) and np.array_equal(again.means, model.means)


def test_languages_without_a_mean_of_their_own(spark, monkeypatch):
    """Languages beyond the bound share a mean, and one that no text has is met by that of all others."""
    monkeypatch.setattr(topics, "LANGUAGES", 1)
    rows = [(k, f"word{k % 7} other{k % 5} more{k % 3}", ("en", "en", "de", "fr", None)[k % 5]) for k in range(60)]
    model = topics.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 2)
    assert model.languages == {"en": 0} and len(model.means) == 2
    langs = [x for *_, x in rows]
    assert np.array_equal(model.label([t for _, t, _ in rows], langs), model.label([t for _, t, _ in rows], [x if x == "en" else "xx" for x in langs]))


def test_words_are_counted_as_by_the_pattern(spark):
    texts = ["", " ", "a", "  two\twords ", "a\x0bb\x0cc\rd\ne", "no break 　 wide", "\x1cx\x1f y", "é😀 ü", "end "]
    frame = spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    want = [r.n for r in frame.select("doc_id", F.expr(r"size(regexp_extract_all(text, '([^\\x20\\x09-\\x0D]+)', 1))").alias("n")).orderBy("doc_id").collect()]
    assert topics.word_totals(texts).tolist() == want
    assert [r.n_tokens for r in raking.mixed(frame).orderBy("doc_id").collect()] == want
