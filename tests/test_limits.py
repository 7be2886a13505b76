"""Inputs that once met a cap or a prefix, and ways that must agree with each other."""

import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lodestrata.functions import text as tx
from lodestrata.operators import argument, articles, bundles, dense, fusion, metrics, presentation, records, selection, sparse
from lodestrata.sources import readers, writers

SMALL = "/root/testdata/sf0.001"


def test_a_late_byte_decides_the_encoding(spark, tmp_path):
    lines = ["id;label", *(f"{k};plain" for k in range(20_000)), "x;café"]
    (tmp_path / "late.csv").write_bytes("\n".join(lines).encode("latin-1"))
    out = readers.csv_any(spark, f"{tmp_path}/late.csv")
    assert out.count() == 20_001 and out.where("id = 'x'").first().label == "café"
    (tmp_path / "marked.csv").write_bytes("﻿id,label\n1,\"two\nlines é\"\n".encode())
    assert [tuple(r) for r in readers.csv_any(spark, f"{tmp_path}/marked.csv").collect()] == [("1", "two\nlines é")]
    (tmp_path / "empty.csv").write_bytes(b"")
    assert readers.sniff_csv(spark, f"{tmp_path}/empty.csv") == ("UTF-8", ",", False)


def test_a_chain_of_a_thousand_steps(spark):
    steps = spark.range(1000).select(F.col("id").alias("step_id"), F.array("id").alias("premises"), (F.col("id") + 1).alias("conclusion"))
    out = argument.reachable(steps)
    assert out.count() == 1000 * 1001 // 2
    assert out.where("step_id = 0").agg(F.max("depth")).first()[0] == 1000
    assert out.where("step_id = 400 and claim_id = 777").first().depth == 377


def test_reachability_and_components_by_brute_force(spark):
    rng = random.Random(3)
    rows = [(k, rng.sample(range(30), 2), rng.randrange(30)) for k in range(25)]
    links = {(p, c) for _, ps, c in rows for p in ps}
    found = {(r.step_id, r.claim_id): r.depth for r in argument.reachable(spark.createDataFrame(rows, "step_id long, premises array<long>, conclusion long")).collect()}
    want = {}
    for k, _, c in rows:
        front, depth, seen = {c}, 1, {}
        while front:
            seen |= {x: depth for x in front}
            front, depth = {b for a, b in links if a in front} - set(seen), depth + 1
        want |= {(k, x): d for x, d in seen.items()}
    assert found == want
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 400)]
    mine = {r.node: r.component for r in argument.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert mine == label


def test_lineitem_components_on_a_small_table(spark):
    from lodestrata import catalog

    rows = {(r.l_orderkey * 2, r.l_suppkey * 2 + 1) for r in spark.read.parquet(f"{SMALL}/lineitem.parquet").select("l_orderkey", "l_suppkey").collect()}
    parent = {x: x for e in rows for x in e}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in rows:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    sizes: dict = {}
    for x in parent:
        sizes[find(x)] = sizes.get(find(x), 0) + 1
    assert {r.component: r.size for r in catalog.queries()["graph_components"](spark, SMALL).collect()} == sizes


def test_tokens_are_of_the_normal_form(spark):
    rows = spark.createDataFrame([("ﬁne ＦＵＬＬ１ Ⅳ",), ("fine FULL1 IV",), ("été",), (None,), ("it's a-b/c",)], "t string")
    found = [r[0] for r in rows.select(tx.tokens(F.col("t"))).collect()]
    assert found[0] == found[1] == ["fine", "full1", "iv"] and found[2] == ["été"] and found[3] == [] and found[4] == ["it", "s", "a-b/c"]
    docs = spark.createDataFrame([(1, "a ﬁne day"), (2, "another day")], "doc_id long, text string")
    hits = sparse.search(docs, spark.createDataFrame([(7, "fine")], "item_id long, text string"))
    assert [(r.item_id, r.doc_id) for r in hits.collect()] == [(7, 1)]


@pytest.mark.parametrize("exclude", [False, True])
def test_search_in_blocks_is_search_by_shuffles(spark, monkeypatch, exclude):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    text = lambda n: " ".join(rng.choice(words[: rng.choice((3, 20, 60))]) for _ in range(n))
    docs = spark.createDataFrame([(k, text(rng.randrange(0, 40))) for k in range(300)] + [(900, None), (901, "w1 w2"), (902, "w1 w2")], "doc_id long, text string").repartition(4)
    queries = spark.createDataFrame([(f"q{k}", text(rng.randrange(1, 8))) for k in range(12)] + [("none", "zzz"), ("nothing", "")], "item_id string, text string")
    out = spark.createDataFrame([("q0", k) for k in range(0, 300, 2)] + [("q1", 5)], "item_id string, doc_id long") if exclude else None
    pairs = spark.createDataFrame([(f"q{k % 14}", d) for k, d in enumerate(range(0, 300, 7))] + [("none", 901), ("absent", 3)], "item_id string, doc_id long")
    found = []
    for most, block in ((1_000_000, 100), (1_000_000, 1 << 21), (0, 1)):
        monkeypatch.setattr(sparse, "MOST_QUERY_TERMS", most)
        monkeypatch.setattr(sparse, "BLOCK_SCORES", block)
        hits = sorted((r.item_id, r["rank"], r.doc_id, round(r.score, 8)) for r in sparse.search(docs, queries, 9, out).collect())
        scores = sorted((r.item_id, r.doc_id, round(r.score, 8)) for r in sparse.score_candidates(docs, queries, pairs).collect())
        found.append((hits, scores))
    monkeypatch.setattr(sparse, "MOST_QUERY_TERMS", 1_000_000)
    assert sparse.search(docs.limit(0), queries, 9, out).count() == sparse.search(docs, queries.limit(0), 9, out).count() == 0
    assert sparse.score_candidates(docs.limit(0), queries.limit(0), pairs).agg(F.sum("score")).first()[0] == 0
    assert found[0] == found[1] == found[2] and len(found[0][0]) > 90 and len(found[0][1]) == pairs.count()


def test_exact_search_in_rounds(spark, monkeypatch):
    vectors = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    queries = vectors.where("vec_id % 25 = 0").withColumnRenamed("vec_id", "query_id")
    once = sorted(map(tuple, dense.exact_search(vectors, queries, 7).collect()))
    monkeypatch.setattr(dense, "BROADCAST_BYTES", 2000)
    monkeypatch.setattr(dense, "BLOCK_SCORES", 50)
    assert sorted(map(tuple, dense.exact_search(vectors, queries, 7).collect())) == once
    assert dense.exact_search(vectors.limit(0), queries).count() == dense.exact_search(vectors, queries.limit(0)).count() == 0
    with pytest.raises(PySparkException):
        dense.score_pairs(spark.createDataFrame([(0, -5)], "query_id long, vec_id long"), queries, vectors, "query_id", "vec_id").collect()


@pytest.mark.parametrize("half", [False, True])
def test_list_search_recall_on_the_embeddings(spark, half):
    vectors = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    queries = vectors.where("vec_id % 25 = 0").withColumnRenamed("vec_id", "query_id")
    exact = dense.exact_search(vectors, queries).select("query_id", "vec_id")
    near = dense.list_search(vectors, queries, half=half).select("query_id", "vec_id")
    assert exact.join(near, ["query_id", "vec_id"]).count() >= 0.9 * exact.count()
    with pytest.raises(ValueError):
        dense.list_search(vectors, queries, lists=400)
    with pytest.raises(ValueError):
        dense.list_search(vectors, queries, probes=0)


def test_counted_pairs_are_the_pairs(spark):
    rng = random.Random(8)
    rows = [(q, rng.randrange(4), float(rng.randrange(6)), k) for q in range(5) for k in range(rng.randrange(0, 40))]
    frame = spark.createDataFrame(rows, "query_id int, grade int, score double, rank int")
    pairs = [(a, b) for a in rows for b in rows if a[0] == b[0] and a[1] > b[1]]
    out = fusion.direction_accuracy(frame).first()
    assert (out.pairs, out.correct, out.ties) == (len(pairs), sum(a[2] > b[2] for a, b in pairs), sum(a[2] == b[2] for a, b in pairs))
    per = {r.query_id: (r.pairwise_accuracy, r.pairs) for r in metrics.pairwise_accuracy(frame, "query_id").collect()}
    for q in range(5):
        own = [(a, b) for a, b in pairs if a[0] == q]
        if own:
            assert per[q][1] == len(own) and math.isclose(per[q][0], sum(1.0 if a[2] > b[2] else 0.5 if a[2] == b[2] else 0.0 for a, b in own) / len(own))
        else:
            assert q not in per


def test_texts_that_hold_the_marks_of_headings(spark):
    text = "Intro x yo. Methods: a b. Results: cd."
    found = spark.createDataFrame([(text,)], "t string").select(articles.sections(F.col("t")).alias("s")).first().s
    assert [(s.section, s.text) for s in found] == [("abstract", "Intro x yo."), ("methods", "a b."), ("results", "cd.")]


def test_kinds_of_evidence_with_blanks_of_any_kind(spark):
    found = spark.createDataFrame([(" Adverse event\n",), ("\tscope",)], "t string").select(presentation.evidence_type(F.col("t"))).collect()
    assert [r[0] for r in found] == ["safety", "population_or_scope"]


def test_joins_that_must_be_whole(spark):
    left, right = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string"), spark.createDataFrame([("1", "c"), ("2", "d")], "r string, y string")
    assert sorted(map(tuple, records.one_to_one(left, right, "k", "r").collect())) == [(1, "a", "1", "c"), (2, "b", "2", "d")]
    for bad in (right.where("r = '1'"), right.union(right.limit(1)), right.union(spark.createDataFrame([("9", "z")], "r string, y string"))):
        with pytest.raises(PySparkException):
            records.one_to_one(left, bad, "k", "r").collect()
    with pytest.raises(PySparkException):
        records.covered(left, [(spark.createDataFrame([(1,)], "k int"), "k")]).collect()
    manifest = spark.createDataFrame([(0, "q1", "dev", "p", "r"), (1, "q1", "dev", "p", "r")], "position int, query_id string, split string, path string, record_id string")
    for rows in (manifest, manifest.limit(1).withColumn("split", F.lit("train")), manifest.limit(1).withColumn("path", F.lit("")), manifest.limit(1).withColumn("query_id", F.lit(""))):
        with pytest.raises(PySparkException):
            records.selected_manifest(rows, "dev").collect()
    with pytest.raises(PySparkException):
        records.located(manifest.limit(1), spark.createDataFrame([("p", "other")], "path string, record_id string")).collect()
    steps, one = spark.createDataFrame([("s", 1, "a"), ("s", 2, "b")], "statement_id string, position int, step_id string"), ("a", True, False)
    for rows in ([one], [one, one, ("b", True, True)], [one, ("b", True, True), ("c", True, True)]):
        with pytest.raises(PySparkException):
            bundles.gap_bundle(steps, spark.createDataFrame(rows, "step_id string, scope_gap boolean, causal_gap boolean")).collect()


def test_shards_and_schemas(spark, tmp_path):
    rows = spark.range(10).withColumn("x", F.col("id") * 2)
    for k in (0, 1):
        rows.where(f"id % 2 = {k}").write.parquet(f"{tmp_path}/{k}")
    rows.where("id = 3").write.parquet(f"{tmp_path}/again")
    assert readers.combined_shards(spark, [f"{tmp_path}/0", f"{tmp_path}/1"], "id", rows).count() == 10
    for paths, wanted in ((["0", "1", "again"], rows), (["0"], rows), (["0", "1"], rows.where("id < 9"))):
        with pytest.raises(PySparkException):
            readers.combined_shards(spark, [f"{tmp_path}/{p}" for p in paths], "id", wanted).collect()
    with pytest.raises(ValueError):
        writers.conformed(rows, "id long")
    with pytest.raises(PySparkException):
        writers.conformed(spark.createDataFrame([("x",)], "a string"), "a int").collect()
    with pytest.raises(ValueError):
        selection.chosen_rows(rows, "id", "x", offset=1, group_limit=2)
    with pytest.raises(ValueError):
        bundles.recomputed(rows, rows.drop("x"))
    assert bundles.recomputed(rows.union(rows.limit(1)), rows).collect()[0].n == 1
