"""The pipeline's near-dedup stage against all pairs by exact similarity."""

import random

import numpy as np
import pytest

import corpus_pipeline
from lodestrata.llm import blocks, near_copies
from tests.llm import brute
from tests.llm.test_contracts import DOCS, docs, none  # noqa: F401


def shingles(text):
    words = brute.BLANKS.findall((text or "").translate(brute.LOWER))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())


def classes(rows):
    """[(doc_id, text)] -> smallest doc_id of each row's class, by all pairs."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if label[i] != label[j] and 5 * len(a & b) >= 4 * len(a | b):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for x, (d, _) in zip(label, rows):
        if d is not None:
            least[x] = min(d, least.get(x, d))
    return [least.get(x) for x in label]


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


@pytest.mark.parametrize("bounded", [False, True])
def test_near_copies_are_all_pairs_of_the_similarity(spark, monkeypatch, bounded):
    """Chains, edits on both sides of 0.8, short and long texts, a passage that all share; with tasks of a few sets too."""
    if bounded:
        monkeypatch.setattr(near_copies, "KEY_SETS", 4)
        monkeypatch.setattr(near_copies, "GROUP_SHINGLES", 3000)
    rng = random.Random(9)
    shared = [f"common{k}" for k in range(30)]
    rows = []
    for n in (3, 5, 7, 9, 14, 30, 60, 150, 700, 2500):
        for _ in range(6):
            base = [f"w{rng.randrange(10**5)}" for _ in range(n)] + (shared if n > 9 else [])
            rows += [" ".join(base), " ".join(base).upper(), " ".join(base + ["end"])]
            rows += [" ".join(edited(rng, base, max(1, len(base) * k // 200))) for k in range(1, 9)]
    rng.shuffle(rows)
    rows = [(None if k % 50 == 7 else k, t) for k, t in enumerate(rows)]
    want = classes(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = near_copies.near_copies(frame)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(key, (tuple(r) for r in found.select("doc_id", "component_id").collect()))) == sorted(map(key, ((d, c) for (d, _), c in zip(rows, want))))
    assert len(set(want)) < 0.7 * len(rows)


def test_stage_drops_near_copies(spark):
    """A few words changed, or a line added: beyond two bits of a fingerprint, yet near copies."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**5)}" for _ in range(300)]
    texts = [base, edited(rng, base, 5), base + ["one", "more", "line"], [f"v{rng.randrange(10**5)}" for _ in range(300)]]
    frame = spark.createDataFrame([(k, " ".join(t), "en", "s", 1) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, frame, "").collect()) == [0, 3]


def test_keep_one(docs, none):  # noqa: F811
    kept = near_copies.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    want = classes(DOCS)
    assert sorted(x for x in ids if x is not None) == sorted({c for c in want if c is not None})
    assert ids.count(None) == sum(c is None for c in want)
    assert near_copies.keep_one(none).count() == 0


@pytest.mark.parametrize("limit", [5, 23, 1000])
def test_blocks_link_what_one_task_links(spark, limit):
    """One key with a large class, several small ones and single sets; classes must not hang on how the key is dealt."""
    rng = np.random.default_rng(5)
    base = [rng.integers(0, 2**63, 100).astype(np.uint64) for _ in range(6)]
    sets = [np.unique(np.r_[b[: 100 - e], rng.integers(0, 2**63, e).astype(np.uint64)]) for k, b in enumerate(base) for e in rng.integers(0, 14, 60 if k == 0 else 5 + k)]
    sets += [rng.integers(0, 2**63, 90).astype(np.uint64) for _ in range(9)]
    names = rng.permutation(len(sets)).tolist()
    rows = [(7, n, 1, bytearray(np.sort(s).tobytes())) for n, s in zip(names, sets)] + [(8, n, 1, bytearray(np.sort(s).tobytes())) for n, s in zip(names[:40], sets)]
    frame = spark.createDataFrame(rows, "key long, code long, w long, members binary").repartition(3)
    links = blocks.linked_in_blocks(frame, near_copies._exact, near_copies._exact_across, limit, 10).collect()
    whole = near_copies.linked([np.sort(s) for s in sets])
    label = {n: n for n in names}
    for a, b in links:
        old, new = label[a], label[b]
        label = {n: new if x == old else x for n, x in label.items()}
    mine, want = {}, {}
    for n, w in zip(names, whole):
        mine.setdefault(label[n], set()).add(n)
        want.setdefault(w, set()).add(n)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_hot_keys_are_shared_in_any_order():
    """What _routed and _shared hand on, against a plain count, when keys are hot from the third set on."""
    import pyarrow as pa

    rows = {(1, 5), (1, 6), (2, 5), (3, 7), (3, 8), (3, 9)}
    hot = [(9, 1 + n % 4, n) for n in range(50)] + [(9, 0, -1), (9, 0, -2), (9, 0, 777)]
    table = sorted([*((k, 0, c) for k, c in rows), *hot, (1, 0, 5), (9, 2, 1)])
    for size in (1, 2, 7, 100):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in table[low : low + size]], pa.int64() if i != 1 else pa.int32()) for i in range(3)], ["key", "salt", "code"]) for low in range(0, len(table), size)]
        found = [tuple(r.values()) for b in near_copies._shared(iter(batches)) for r in b.to_pylist()]
        assert sorted(found) == sorted({(1, 5), (1, 6), (3, 7), (3, 8), (3, 9), (9, -1), (9, -2), (9, 777), *((9, n) for n in range(50))})


def test_a_large_group_links_as_all_pairs_do():
    """Groups under one key of over 33 sets, near and far."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 120).astype(np.uint64)
    sets = [np.unique(np.r_[base[k % 30 :], rng.integers(0, 2**63, k % 30).astype(np.uint64)]) for k in range(90)]
    labels = near_copies.linked(sets)
    near = [[5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)) for b in sets] for a in sets]
    want = list(range(90))
    for i in range(90):
        for j in range(i):
            if near[i][j] and want[i] != want[j]:
                low, high = min(want[i], want[j]), max(want[i], want[j])
                want = [low if x == high else x for x in want]
    assert labels.tolist() == want


def test_fingerprints_link_all_codes_within_the_radius(spark):
    """Equal fingerprints of several sets, chains within the radius, pairs just beyond it; wordless texts take no part."""
    rng = random.Random(12)
    prints = [rng.getrandbits(64) for _ in range(150)]
    for k in range(150):
        moved = prints[k]
        for bit in rng.sample(range(64), 1 + k % 6):
            moved ^= 1 << bit
        prints.append(moved)
    rows = [(k, 9, p - (1 << 64) if p >> 63 else p) for k, p in enumerate(prints + prints[:40])] + [(1000, 0, 0), (1001, 9, 0)]
    frame = spark.createDataFrame(rows, "code long, size long, fp long").repartition(6)
    label = {c: c for c, size, _ in rows if size}
    want = dict(label)

    def unite(of, a, b):
        old, new = max(of[a], of[b]), min(of[a], of[b])
        of.update({c: new for c, x in of.items() if x == old})

    for a, b in ((r.a, r.b) for r in near_copies.fingerprint_links(frame)[0].collect()):
        unite(label, a, b)
    for i, (a, size, p) in enumerate(rows):
        for b, other, q in rows[:i]:
            if size and other and ((p ^ q) & (2**64 - 1)).bit_count() <= near_copies.RADIUS:
                unite(want, a, b)
    assert label == want and len(set(want.values())) < len(want) - 100


def test_fingerprints_alone_find_close_copies(spark, monkeypatch):
    """Without the keys, long texts with a word changed are still found, and what isn't similar enough is still told apart."""

    def nothing(batches):
        for _ in batches:
            pass
        yield from ()

    monkeypatch.setattr(near_copies, "_routed", nothing)
    rng = random.Random(3)
    rows = []
    for n in range(6):
        base = [f"w{rng.randrange(10**5)}" for _ in range(3000)]
        rows += [(10 * n, " ".join(base)), (10 * n + 1, " ".join(edited(rng, base, 1)))]
    rows += [(90, " ".join(["tick"] * 50)), (91, " ".join(["tick"] * 49 + ["tock"]))]  # equal fingerprints, half the shingles in common
    found = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(r) for r in found.select("doc_id", "component_id").collect()) == sorted((d, c) for (d, _), c in zip(rows, classes(rows)))
    assert sum(d != c for (d, _), c in zip(rows, classes(rows))) == 6
