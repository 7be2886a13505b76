"""Small fixtures with results derived by hand."""

import datetime
import math

import pytest
from pyspark.errors import PySparkException

from lodestrata.functions import text as tx
from lodestrata.operators import argument, corpus, dense, fusion, metrics, selection, sparse, stance
from lodestrata.sources import readers, writers
from lodestrata.streaming import runs


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_rrf(spark):
    run = lambda rows: frame(spark, [("q", *r) for r in rows], "q string, d string, rank int, score double")
    sources = {"bm25": run([("a", 1, 9.0), ("b", 2, 8.0)]), "x": run([("b", 1, 0.9), ("a", 2, 0.8)]), "y": run([("a", 1, 0.7), ("c", 2, 0.6)])}
    out = {r.d: r for r in fusion.fused(sources, "q", "d").collect()}
    assert [out[k].fusion_rank for k in "abc"] == [1, 2, 3]
    assert [out[k].source_mask for k in "abc"] == [7, 3, 4]
    assert out["a"].source_count == 3 and out["b"].y_rank is None
    assert math.isclose(out["a"].fusion_score, 1 / 61 + 1 / 62 + 1 / 61) and math.isclose(out["c"].fusion_score, 1 / 62)
    union = {r.d: r for r in fusion.fused(sources, "q", "d", "union").collect()}
    assert union["a"].fusion_score == 3.0
    with pytest.raises(ValueError):
        fusion.fused(sources, "q", "d", "other")


def test_rerank_keeps_the_tail(spark):
    first = frame(spark, [("q", "a", 1, 0.5), ("q", "b", 2, 0.4), ("q", "t", 101, 0.1)], "q string, d string, fusion_rank int, fusion_score double")
    scores = frame(spark, [("q", "a", 0.2), ("q", "b", 0.9), ("q", "t", 5.0)], "q string, d string, score double")
    out = fusion.reranked(first, scores, "q", "d", 100).orderBy("rerank_rank").collect()
    assert [r.d for r in out] == ["b", "a", "t"] and out[2].ce_score is None


def test_ranking_metrics(spark):
    ranked = frame(spark, [(1, 0, 1), (1, 2, 2), (1, 1, 3)], "claim_id int, grade int, rank int")
    m = metrics.judged_metrics(ranked).first()
    assert m.mrr == 0.5
    assert math.isclose(m.ndcg_at_3, (3 / math.log2(3) + 0.5) / (3 + 1 / math.log2(3)))
    scored = frame(spark, [(1, 1, 1, 0.9), (1, 2, 2, 0.5), (1, 3, 0, 0.5)], "claim_id int, rank int, grade int, score double")
    p = metrics.pairwise_accuracy(scored).first()
    assert (p.pairs, p.pairwise_accuracy) == (3, 0.5)
    gold = frame(spark, [(1, "a"), (1, "b")], "q int, d string")
    run = frame(spark, [(1, "a", 3), (1, "b", 60)], "q int, d string, rank int")
    o = metrics.open_metrics(gold, run, "q", "d").first()
    assert (o.recall_at_10, o.recall_at_50, o.recall_at_100, o.hit_at_10, o.first_positive_rank) == (0.5, 0.5, 1.0, 1, 3)


def test_set_cover():
    assert metrics.cover_size([{"x", "y"}, {"y", "z"}, {"z"}, {"x"}]) == 2
    assert metrics.cover_size([]) == 0
    assert metrics.cover_size([{1, 2, 3, 4}, {1, 3, 5}, {2, 4, 6}, {5}, {6}]) == 2
    import itertools
    import random

    rng = random.Random(0)
    for _ in range(60):
        sets = [set(rng.sample(range(8), rng.randrange(1, 5))) for _ in range(7)]
        every = set().union(*sets)
        assert metrics.cover_size(sets) == next(n for n in range(1, 8) if any(set().union(*c) == every for c in itertools.combinations(sets, n)))


def test_confusion_of_an_absent_class(spark):
    rows = frame(spark, [("a", "a"), ("a", "b")], "gold string, pred string")
    out = {r.label: r for r in metrics.confusion(rows, ["a", "b", "c"]).collect()}
    assert (out["c"].precision, out["c"].recall, out["c"].f1) == (0.0, 0.0, 0.0)
    assert math.isclose(out["a"].f1, 2 / 3)


def test_judgment_conflict(spark):
    rows = frame(spark, [(1, "x", 1, 1, False, "train"), (1, "x", -2, 2, True, "dev")], "claim_id int, article_id string, stance int, grade int, is_origin boolean, split string")
    out = corpus.consolidated(rows).first()
    assert out.stance_label is None and out.label_conflict and not out.eligible_for_qrels
    assert (out.min_label, out.max_label, out.split_count, out.is_origin_source) == (-2, 1, 2, True)


def test_article_variant_order(spark):
    rows = frame(spark, [("a", "short"), ("a", "longer text"), ("a", "longer  text"), ("b", "x")], "article_id string, text string")
    out = {r.article_id: r for r in corpus.articles(rows).collect()}
    assert out["a"].text == "longer text" and out["a"].selected_variant_occurrence_count == 2 and out["a"].text_variant_count == 2


def test_stance_masses_and_verdicts(spark):
    schema = "claim_id int, input_id int, article_id int, rank int, label string, p_support double, p_refute double, p_insufficient double"
    rows = frame(spark, [(1, 1, 1, 1, "support", 0.9, 0.02, 0.08), (1, 2, 1, 2, "insufficient", 0.1, 0.1, 0.8), (1, 3, 2, 3, "refute", 0.05, 0.7, 0.25)], schema)
    out = stance.masses(rows, ["claim_id"]).first()
    assert math.isclose(out.support_mass, 0.9 + 0.05 + 0.05 / 3) and math.isclose(out.insufficient_mass, 0.08 + 0.4 + 0.25 / 3)
    assert (out.pattern, out.conflict, out.top_support, out.top_refute) == ("mixed", True, 1, 3)
    assert stance.verdicts(rows).first().verdict == "mixed"
    nodes, edges = stance.graph_nodes(rows), stance.graph_edges(rows)
    assert {r.violations for r in stance.graph_violations(nodes, edges).collect()} == {0}
    broken = {r.check: r.violations for r in stance.graph_violations(nodes, edges.where("relation <> 'supports'")).collect()}
    assert broken["one_stance"] == 1 and broken["dangling_edges"] == 0
    with pytest.raises(PySparkException):
        frame(spark, [("perhaps",)], "l string").select(stance.canonical_stance(tx.F.col("l"))).collect()


def test_components_and_cutoff(spark):
    edges = frame(spark, [(1, 10), (1, 11), (2, 12), (20, 12)], "a long, b long")
    assert {r.node: r.component for r in argument.components(edges).collect()} == {1: 1, 10: 1, 11: 1, 2: 2, 12: 2, 20: 2}
    sizes = frame(spark, [("a", 3), ("b", 4), ("c", 5)], "h string, n int")
    assert sorted(r.h for r in argument.nearest_cutoff(sizes, ["h"], "n", 6).collect()) == ["a", "b"]
    assert argument.nearest_cutoff(sizes, ["h"], "n", 1).count() == 0


def test_cycles_end(spark):
    steps = frame(spark, [(1, [1], 2), (2, [2], 1)], "step_id long, premises array<long>, conclusion long")
    for r in argument.impacts(steps).collect():
        assert r.cycle_detected and list(r.terminal_claim_ids) == [] and not r.affects_terminal_conclusion
    claims = frame(spark, [(1,), (2,), (3,)], "claim_id long")
    assert {r.claim_id: r.role for r in argument.roles(claims, steps).collect()} == {1: "INTERMEDIATE", 2: "INTERMEDIATE", 3: "STANDALONE"}


def test_text_expressions(spark):
    F = tx.F
    row = frame(spark, [(" a \n b ", "aaa", "Title", "body", "Same Thing?!")], "a string, b string, c string, d string, e string").select(
        tx.squeezed(F.col("a")).alias("squeezed"), tx.exact_spans(F.col("b"), F.lit("aa")).alias("spans"), tx.article_text(F.col("c"), F.col("d")).alias("article"), tx.duplicate_key(F.col("e")).alias("key"), tx.tokens(F.lit("TNF-α and/or x_1")).alias("tokens")
    ).first()
    assert row.squeezed == "a b" and row.spans == [0, 1] and row.article == "Title. body" and row.key == "same thing" and row.tokens == ["tnf-α", "and/or", "x_1"]
    reasons = frame(spark, [("title", "abstract", "A."), ("abstract", "results", "no end"), ("abstract", "abstract", "no end"), ("abstract", "results", 'End."')], "k string, s string, t string")
    found = [r[0] for r in reasons.select(tx.exclusion_reason(F.col("k"), F.col("s"), F.col("t"))).collect()]
    assert found == ["title_sentence", "unterminated_structured_section_fragment", None, None]


def test_pool_scores_repeat_query_terms(spark):
    pool = frame(spark, [(1, 0, "a b"), (1, 1, "b c"), (1, 2, "")], "p int, i int, text string")
    one, two = (sparse.pool_scores(pool, frame(spark, [(1, q)], "p int, text string"), "p", "i").orderBy("i").collect() for q in ("a", "a a"))
    assert math.isclose(two[0].score, 2 * one[0].score, rel_tol=1e-8) and one[2].score == 0


def test_lists_recall(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    rows = frame(spark, [(k, [float(x) for x in rng.normal(size=8)]) for k in range(800)], "vec_id long, embedding array<float>")
    queries = rows.where("vec_id < 20").withColumnRenamed("vec_id", "query_id")
    exact = dense.exact_search(rows, queries).select("query_id", "vec_id")
    near = dense.list_search(rows, queries).select("query_id", "vec_id")
    assert exact.join(near, ["query_id", "vec_id"]).count() >= 0.9 * exact.count()


def test_pages(spark):
    rows = frame(spark, [(k, datetime.datetime(2024, 1, 1 + k // 2)) for k in range(9)], "id int, at timestamp")
    seen, cursor = [], None
    while got := selection.page(rows, "at", "id", 4, cursor).collect():
        got = sorted(got, key=lambda r: (r["at"], r["id"]), reverse=True)
        seen += [r["id"] for r in got]
        cursor = (got[-1]["at"], got[-1]["id"])
    assert seen == list(range(8, -1, -1))
    with pytest.raises(ValueError):
        selection.page(rows, "at", "id", 101)


def test_trec_files(spark, tmp_path):
    run = frame(spark, [("q1", "d1", 1, 2.5), ("q1", "d2", 2, 1.0)], "query string, document string, rank int, score double")
    writers.write_trec(run, f"{tmp_path}/run", "mine")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/run").collect()) == ["q1 Q0 d1 1 2.5000000000 mine", "q1 Q0 d2 2 1.0000000000 mine"]
    back = readers.trec_run(spark, f"{tmp_path}/run")
    assert back.count() == 2 and readers.run_violations(back).count() == 0
    gap = frame(spark, [("q", "d", 2)], "query string, document string, rank int")
    assert [r.problem for r in readers.run_violations(gap).collect()] == ["ranks"]
    (tmp_path / "bad").write_text("only three fields\n")
    with pytest.raises(PySparkException):
        readers.trec_run(spark, f"{tmp_path}/bad").collect()


def test_csv_and_articles(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("id;label\n1;caf\xe9\n".encode("latin-1"))
    assert readers.csv_any(spark, f"{tmp_path}/a.csv").collect() == [("1", "café")]
    with pytest.raises(ValueError):
        readers.union_csv(spark, [f"{tmp_path}/a.csv"], ["missing"], "label", [])
    (tmp_path / "a.jsonl").write_text('{"paper_id": "p1", "text": "t"}\n{"paper_id": "p1", "text": "u"}\n')
    with pytest.raises(PySparkException):
        readers.load_articles(spark, f"{tmp_path}/a.jsonl").collect()


def test_stream_agrees_with_batch(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    batch.repartition(2).write.parquet(f"{tmp_path}/in")
    stream = runs.windowed(runs.read_events(spark, f"{tmp_path}/in", batch.schema), late="100000 days")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", f"{tmp_path}/cp").start()
    query.processAllAvailable()
    query.stop()
    key = lambda r: (r.start, r.event_type, r.n)
    assert sorted(map(key, spark.table("windows").collect())) == sorted(map(key, runs.windowed(batch).collect()))


def test_manifest_ignores_order(spark):
    a = frame(spark, [(1, "x"), (2, "y")], "a int, b string")
    assert writers.manifest(a).first() == writers.manifest(a.orderBy("a", ascending=False).select("b", "a")).first()
