"""Cuts of long sentences meet again after any prefix."""

import random

from lodestrata.llm import sentence_spans


def test_passage_without_marks_goes_at_every_offset(spark):
    rng = random.Random(3)
    w = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    rows = []
    for group in range(20):
        passage = w(51)
        rows += [(100 * group + k, w(k) + " " + passage + " " + w(15) + ".") for k in range(1, 13)]
    out = {r.doc_id: r for r in sentence_spans.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, _ in rows:
        assert (out[d].n_removed == 0) if d % 100 == 1 else (12 <= out[d].removed_words <= 51)
    assert sum(out[d].removed_words for d, _ in rows if d % 100 > 1) > 0.6 * 51 * 220


def test_cuts_are_bounded_and_depend_on_the_words_near():
    rng = random.Random(7)
    missed = 0
    for _ in range(3000):
        passage = [f"w{rng.randrange(10**6)}" for _ in range(51)]
        places = []
        for n in (rng.randrange(40), rng.randrange(40)):
            words = [f"x{rng.randrange(10**6)}" for _ in range(n)] + passage + [f"z{rng.randrange(10**6)}" for _ in range(rng.randrange(40))]
            cuts = sentence_spans._cuts(words, 12)
            gaps = [b - a for a, b in zip([0, *cuts], [*cuts, len(words)])]
            assert all(4 <= g <= 12 for g in gaps)
            places.append([c - n for c in cuts if n <= c <= n + 51])
        runs = [{tuple(p[k : k + 4]) for k in range(len(p) - 3)} for p in places]
        missed += not runs[0] & runs[1]
    assert missed <= 3
    for words in (["same"] * 5000, ["a", "b"] * 2500):
        cuts = sentence_spans._cuts(words, 12)
        assert all(4 <= b - a <= 12 for a, b in zip([0, *cuts], [*cuts, 5000]))
