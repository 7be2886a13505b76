"""The queries that SQL can express against that SQL; the others against the brute-force versions, on whole small tables."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from lodestrata.llm import raking, registry, topics
from tests.llm import brute
from tests.oracle import connect, difference

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.fixture(scope="module")
def docs(con):
    return con.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_sql(spark, con, name):
    assert difference(registry.queries()[name](spark, FOLDER), con, registry.oracle_sql()[name]) == ""


def run(spark, name, *columns):
    return sorted(tuple(r) for r in registry.queries()[name](spark, FOLDER).select(*columns).collect())


def test_op1(spark, docs):
    assert run(spark, "op1_simhash", "doc_id", "fingerprint", "component_id") == sorted(brute.op1(docs))


def test_op2(spark, docs):
    assert run(spark, "op2_suffix_dedup", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.op2(docs))


def test_op3(spark, docs):
    want = [(d, n, gone, words, hashlib.sha256(text.encode()).hexdigest()) for d, n, gone, words, text in brute.op3(docs)]
    assert run(spark, "op3_sentence_spans", "doc_id", "n_sentences", "n_removed", "removed_words", "kept_sha256") == sorted(want)


def test_op5(spark, docs):
    assert run(spark, "op5_vector_packing", "doc_id", "size", "text_crc32") == sorted((d, *brute.op5_facts(t)) for d, t in docs)


def test_op6(spark, docs):
    tokenizer = Tokenizer.from_file(registry.tokenizer_file())
    want, start = [], 0
    for d, t in docs:
        ids = np.array(tokenizer.encode(t, add_special_tokens=False).ids + [2], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert run(spark, "op6_token_files", "doc_id", "start", "n_tokens", "ids_crc32") == want


@pytest.mark.parametrize("name", [n for n in registry.queries() if n not in registry.oracle_sql()])
def test_every_document_has_a_row(spark, con, name):
    table = "pages" if name.startswith("op4_") else "documents"
    assert registry.queries()[name](spark, FOLDER).count() == con.execute(f"SELECT count(*) FROM {table}").fetchone()[0]


def plain_pipeline(spark, rows, items):
    """What the pipeline gives for rows (doc_id, text, lang, source), stage by stage, from plain versions."""
    from tests.llm.test_near_copies import classes

    kept = []
    for d, text, lang, source in rows:
        _, _, chars, *_, failed = brute.op9([(d, text)])[0]
        lines = (text or "").split("\n")
        lost = sum(len(w) for x in lines if fails(x) for w in brute.BLANKS.findall(x))
        if not failed and 100 * lost <= 50 * chars:
            kept.append((d, "\n".join(x for x in lines if not fails(x)), lang, source))
    groups: dict = {}
    for row, c in zip(kept, classes([r[:2] for r in kept])):
        if c is None or row[0] == c:
            key = c if c is not None else ("nameless", row[1])
            groups[key] = min(groups.get(key, row), row, key=lambda r: r[1])
    kept = list(groups.values())
    kept = [r for r, found in zip(kept, brute.op8([r[:2] for r in kept], items)) if not found[5]]
    frame = spark.createDataFrame(kept, "doc_id long, text string, lang string, source string")
    labels = topics.fit(frame, raking.TOPICS).label([r[1] for r in kept], [r[2] for r in kept]).tolist()
    named = [(*r, f"topic{n}" if n >= 0 else "other", len(brute.BLANKS.findall(r[1]))) for r, n in zip(kept, labels)]
    kept = [r for r, (_, _, drawn) in zip(kept, brute.op10(named, raking.TARGETS, 0.5, 42)) if drawn]
    tokenizer = Tokenizer.from_file(registry.tokenizer_file())
    want, start = [], 0
    for d, t, *_ in sorted(kept, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = np.array(tokenizer.encode(t, add_special_tokens=False).ids + [2], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return want


def test_pipeline(spark, con):
    """Each stage's documents against a plain version, all the way."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = con.execute("SELECT doc_id, text, lang, source FROM documents").fetchall()
    want = plain_pipeline(spark, rows, con.execute("SELECT item_id, text FROM benchmark").fetchall())
    assert len(want) > 20
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, FOLDER).collect()) == want


def test_pipeline_on_odd_documents(spark, tmp_path):
    """Nulls in all columns, empty and long texts, repeated rows and ids, clashing names, and no documents at all."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from tests.llm.test_contracts import DOCS, ITEMS

    extra = [(40 + k, f"{t} Number {k}. " + " ".join(f"w{k}x{j}" for j in range(60)), None if k % 3 else "de", "src1" if k % 2 else None) for k, (_, t) in enumerate(DOCS) if t]
    rows = [(d, t, "en" if d else None, f"src{(d or 0) % 3}") for d, t in DOCS] + extra + extra[:2]
    rows += [(100 + k, " ".join(f"word{k}x{j}." for j in range(60 + k % 9)), ["de", "fr", "en", "es", None][k % 5], f"src{k % 3}") for k in range(120)]
    schema = "doc_id long, text string, lang string, source string, i string, t string, row string, class string, topic string, `a.b` string"
    for name, chosen in (("some", rows), ("none", [])):
        spark.createDataFrame([(*r, "i", "t", "row", "class", "mine", "ab") for r in chosen], schema).repartition(3).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    found = corpus_pipeline.run(spark, f"{tmp_path}/some").collect()
    want = plain_pipeline(spark, rows, [x for x in ITEMS if x[0] is not None])
    assert len(want) > 20
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted((tuple(r) for r in found), key=key) == want
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def fails(line):
    from lodestrata.llm.line_quality import BOILERPLATE

    words = len(brute.BLANKS.findall(line))
    if not words:
        return False
    symbols, between = sum(c in "#*$%&|<>" for c in line), sum(c in "|›»·•" for c in line)
    navigation = between >= 3 or 0 < between and 3 * between >= words
    return navigation or any(re.search("(?<![a-z])" + b, line.lower()) for b in BOILERPLATE) or not any(c in ".!?…。؟" for c in line) or 10 * symbols > len(line)
