"""Every operator on small tables with nulls, empty and long texts, ties, repeated rows, clashing columns, and no rows."""

import random
import zlib

import numpy as np
import pytest

from lodestrata.llm import decontaminate, html_render, line_quality, raking, sentence_spans, simhash, suffix_dedup, token_files, topics, vector_packing, viterbi_counts
from lodestrata.llm.registry import tokenizer_file
from lodestrata.llm.simple8b import decode, encode
from lodestrata.llm.suffix_array import Shard, common_prefixes, merged_least, padded, suffix_array
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, w string, i int, t int, key string, weight string, kept string, sampled int, shard string"


def texts():
    rng = random.Random(5)
    words = ["the", "Of", "and", "river", "Éclair", "stone,", "light.", "moon!", "x|y", "ÜBER", "&&&", "naïve", "日本", "😀"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = prose(90), prose(60)
    return [
        (1, base),
        (2, base),
        (3, base + " end"),
        (4, None),
        (5, ""),
        (6, " \n\t "),
        (7, "one"),
        (8, "one two"),
        (9, prose(40) + "\n" + passage + "\n" + prose(30)),
        (10, passage + " " + prose(20)),
        (10, passage + " " + prose(20)),
        (11, "a b c\n" * 40),
        (12, prose(30000)),
        (13, "x" * 300),
        (14, "menu | home | about | more | help |\n" * 3 + prose(55)),
        (None, base),
        (None, "null id text " * 30),
        (16, "Licensed under the MIT License.\n" + prose(70)),
        (17, "\x00nul\x00 " + prose(60)),
        (18, "  two  blanks \n and  ends "),
    ]


DOCS = texts()
ITEMS = [(1, DOCS[9][1][:200]), (2, "river stone, light."), (3, None), (4, ""), (5, "Éclair"), (6, DOCS[0][1][100:300]), (6, DOCS[0][1][100:300]), (None, "the Of and river")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, "en" if d else None, f"src{(d or 0) % 3}", 1, 1, "w", 2, 3, "k", "w", "no", 0, "s") for d, t in DOCS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def expected(found):
    return sorted(found, key=repr)


def test_simhash(docs, none):
    assert rows(simhash.near_duplicates(docs)) == expected(brute.op1(DOCS))
    assert rows(simhash.near_duplicates(none)) == []
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    classes = {(d, c) for d, _, c in brute.op1(DOCS)}
    assert sorted(x for x in ids if x is not None) == sorted({c for _, c in classes if c is not None})
    assert simhash.keep_one(none).count() == 0


def test_simhash_hot_groups_link_alike(spark):
    rng = np.random.default_rng(3)
    codes = {int(x) for x in rng.integers(0, 2**12, 150)} | {int(x) << 40 for x in rng.integers(0, 2**10, 100)} | {2**63 - 1, 0}
    frame = spark.createDataFrame([(c,) for c in codes], "fp long")
    for limit in (8, 4096):
        links = simhash.hamming_links(frame, 2, limit).collect()
        parent = {c: c for c in codes}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            assert (a ^ b) >= 0
            parent[find(a)] = find(b)
        mine = {c: min(x for x in codes if find(x) == find(c)) for c in codes}
        todo, true = set(codes), {}
        while todo:
            group, front = set(), [todo.pop()]
            while front:
                x = front.pop()
                group.add(x)
                near = {y for y in todo if (x ^ y).bit_count() <= 2}
                todo -= near
                front += near
            true |= {x: min(group) for x in group}
        assert mine == true


def test_long_text_fingerprint_is_that_of_the_whole(monkeypatch):
    text = DOCS[12][1].encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "BLOCK_BYTES", 1000)
    assert simhash.fingerprint(text) == whole == brute.simhash(DOCS[12][1])


@pytest.mark.parametrize("options", [{}, {"hot": 0}, {"array_bytes": 700, "doc_shard_bytes": 4000}])
def test_suffix_dedup(docs, none, options):
    import hashlib

    found = suffix_dedup.deduplicated(docs, **options)
    mine = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in found.collect()), key=repr)
    big = 10**9
    want = [(None if d == big else d, *x) for d, *x in brute.op2([(big if d is None else d, t) for d, t in DOCS])]
    assert mine == expected(want)
    assert suffix_dedup.deduplicated(none).count() == 0


def test_suffix_array_is_right():
    rng = random.Random(1)
    for data in (b"banana", b"a" * 70, bytes(rng.choice(b"ab") for _ in range(700)), bytes(range(256)), b"ab" * 150 + b"\x00" * 40):
        text = padded(data)
        order = suffix_array(text).tolist()
        assert order == sorted(range(len(data)), key=lambda k: data[k:])
        lcp = common_prefixes(text, np.array(order), 50, lanes=7)
        for k in range(1, len(order)):
            a, b = data[order[k - 1] :], data[order[k] :]
            n = next((m for m in range(min(len(a), len(b), 50)) if a[m] != b[m]), min(len(a), len(b), 50))
            assert lcp[k] == n


def test_shards_merge_to_the_least_owner():
    a = Shard([b"x" * 60, b"0123456789" * 7], np.array([5, 9]), 50)
    b = Shard([b"y" * 52, b"56789" + b"0123456789" * 6], np.array([1, 2]), 50)
    least = merged_least([a, b])
    assert set(least[0][a.class_of[a.segment == 1]].tolist()) == {2} and set(least[0][a.class_of[a.segment == 0]].tolist()) == {5}


def test_sentence_spans(docs, none, spark):
    odd = ["\n\n lead. and  on\n", "日本。語です。foo…bar) baz. 3.14 is (so.) \"yes.\" no", "…", "a.b.c d.\te", "İstanbul ΟΔΟΣ. " * 9, DOCS[9][1] + "。" + DOCS[0][1]]
    for text in [t for _, t in DOCS] + odd:
        assert "".join(sentence_spans.sentences(text or "")) == (text or "")
        assert sentence_spans.sentences(text or "") == [(text or "")[a:b] for a, b, _ in brute.op3_pieces(text)]
    named = sorted({(d, t) for d, t in DOCS if d is not None}, key=lambda r: r[0])
    want = brute.op3([*named, *((None, t) for d, t in DOCS if d is None)])
    out = sentence_spans.deduplicated(docs)
    columns = ["doc_id", "n_sentences", "n_removed", "removed_words", "text"]
    assert rows(out.where("doc_id is not null").distinct(), *columns) == expected(r for r in want if r[0] is not None)
    assert out.count() == len(DOCS)
    assert sentence_spans.deduplicated(none).count() == 0


def test_repeated_passage_of_fifty_words_goes(spark):
    rng = random.Random(8)
    w = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    for passage in (w(52) + ".", w(25) + ". " + w(27) + ".", ". ".join(w(6) for _ in range(9)) + "."):
        frame = spark.createDataFrame([(1, w(30) + ".\n" + passage + "\n" + w(20) + "."), (2, w(10) + ". " + passage + " " + w(9) + ".")], "doc_id long, text string")
        out = {r.doc_id: r for r in sentence_spans.deduplicated(frame).collect()}
        assert out[1].n_removed == 0 and out[2].removed_words >= 36


BOXES = {
    "<table><tr><td><h1>T</h1><p>One<p>Two<ul><li>a<li>b</ul><pre>x\n y</pre></td></tr></table>": "T\n\nOne\n\nTwo\n\n- a\n- b\n\nx\n y",
    "<table><tr><td>left<br>two<td><ul><li>p<li>q</ul><tr><td rowspan=70000>R<br>S<br>T<td>1<tr><td>2</table>": "left  - p\ntwo   - q\nR     1\nS     2\nT",
    "<table><tr><td>a<td><table><tr><td>in<td>ner<tr><td>x</table></table>": "a  in  ner\n   x",
    "<table>oops<tr><td>a<td>b</table>z": "oops\n\na  b\n\nz",
    "<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b>no</div>": "yes",
    "<div style='display:none'><b style='visibility:visible'>no</b></div>": "",
    "<p style='display:none;display:block'>yes": "yes",
    "<style>.x{display:none} @media print{p{display:none}} #y, h2 {visibility:hidden}</style><p class='a x'>no</p><p>yes<h2>no</h2><i id=y>no</i>": "yes",
}


@pytest.mark.parametrize("page", list(BOXES))
def test_cells_are_boxes_and_visibility_is_inherited(page):
    assert html_render.render(page) == BOXES[page]


def test_very_wide_tables():
    wide = "<table>" + "".join("<tr>" + "<td colspan=1000 rowspan=65534>c" * 40 for _ in range(40)) + "</table>"
    assert html_render.render(wide).split() == ["c"] * 1600


def test_every_visible_word_of_every_page_once_and_in_order():
    """Against the standard library's parser, which knows no layout, over all pages of the small table."""
    import html.parser
    import re

    import duckdb

    class Words(html.parser.HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.gone, self.depth = [], None, 0

        def handle_starttag(self, tag, attrs):
            own = dict(attrs)
            unseen = tag in {"head", "script", "style", "template", "iframe", "noembed", "object", "svg", "canvas", "video", "audio"} or "hidden" in own or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", own.get("style") or "")
            if self.gone is None and unseen and tag not in ("br", "img", "input", "hr"):
                self.gone, self.depth = tag, 1
            elif self.gone == tag:
                self.depth += 1
            elif self.gone is None and (tag in ("br", "p", "div", "td", "th", "li", "tr", "table") or re.fullmatch("h[1-6]", tag)):
                self.out.append(" ")

        def handle_endtag(self, tag):
            if self.gone == tag:
                self.depth -= 1
                self.gone = self.gone if self.depth else None
            elif self.gone is None and tag not in ("b", "i", "em", "strong", "a", "span", "code", "small"):
                self.out.append(" ")

        def handle_data(self, data):
            if self.gone is None:
                self.out.append(data)

    for (page,) in duckdb.connect().execute("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall():
        parser = Words()
        parser.feed(page or "")
        parser.close()
        found = [re.sub(r"^(\s*(?:- |\d+\. ))+", "", line) for line in html_render.render(page).split("\n")]
        assert " ".join(found).split() == "".join(parser.out).split()


HTML = {
    "<p>One <b>two</b>\nthree<p>Four": "One two three\n\nFour",
    "<ul><li>a<li>b<ul><li>c</ul></ul><ol start=3><li>x<li>y</ol>": "- a\n- b\n  - c\n\n3. x\n4. y",
    "<table><tr><th>Name<th>N<tr><td>Al<td>10</table>": "Name  N\nAl    10",
    "<table><tr><td rowspan=2>R<td>1<tr><td>2</table>": "R  1\n   2",
    "a<div hidden>no</div><div style='display: none'><p>no</div>b": "ab",  # without a box no line breaks
    "a<br>b<br><br>c": "a\nb\n\nc",
    "<pre>  a\n   b</pre>": "  a\n   b",
    "&amp;&lt;x<script>var a='<p>';</script><style>p{}</style><!-- c --> y": "&<x y",
    "<title>t</title><body>b": "b",
    "": "",
    None: "",
    "<": "<",
    "x < y": "x < y",
    "<b" * 3: "",
    "</p></div>z": "z",
}


@pytest.mark.parametrize("page", list(HTML), ids=str)
def test_html(page):
    assert html_render.render(page) == HTML[page]


def test_html_deep_and_long():
    assert html_render.render("<div>" * 50_000 + "x") == "x"
    assert html_render.render("<table><tr><td>" * 300 + "x").strip() == "x"
    assert len(html_render.render("<p>word " * 100_000).split()) == 100_000


def test_html_table(spark):
    frame = spark.createDataFrame([(1, "u", "<p>a", "k"), (1, "u", "<p>a", "k"), (None, None, None, None)], "page_id long, url string, html string, text string")
    assert rows(html_render.rendered(frame)) == expected([(1, "u", "a"), (1, "u", "a"), (None, None, "")])
    assert html_render.rendered(frame.limit(0)).count() == 0


def test_vector_packing(docs, none):
    out = vector_packing.sharded(docs).collect()
    facts = expected((d, *brute.op5_facts(t)) for d, t in DOCS)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in out), key=repr) == facts
    for s in range(8):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))
    assert all(r.law == "bytes" and r.grown_shard is None for r in out)
    assert vector_packing.sharded(none).count() == 0


def test_vector_packing_balances(spark):
    rng = random.Random(2)
    frame = spark.createDataFrame([(k, "same text" if k % 3 == 0 else f"{k} " + "word " * rng.randrange(1, 60)) for k in range(3000)], "doc_id long, text string")
    out = vector_packing.sharded(frame).collect()
    load = [sum(r.size for r in out if r.shard == s) for s in range(8)]
    assert max(load) - min(load) <= 0.01 * sum(load) / 8
    assert len({r.shard for r in out if r.text_crc32 == zlib.crc32(b"same text")}) == 1


def test_vector_packing_balances_all_three(spark, monkeypatch):
    """Many texts over several cells and blocks, one large group, one that outgrows a shard, and rows that repeat."""
    monkeypatch.setattr(vector_packing, "BLOCK", 700)
    monkeypatch.setattr(vector_packing, "LOTS", 3)
    rng = random.Random(2)
    rows_ = [(None if k % 50 == 0 else k // 2, " ".join(str(rng.randrange(10 ** rng.randrange(1, 9))) for _ in range(rng.randrange(1, 80)))) for k in range(6000)]
    rows_ += [(7, "a text that fills a shard and more " * 12)] * 1200 + [(k, "some group " * 9) for k in range(250)]
    out = vector_packing.sharded(spark.createDataFrame(rows_, "doc_id long, text string")).collect()
    assert len(out) == len(rows_)
    for size, most in (("size", 0.01), ("n_tokens", 0.05), ("one", 0.06)):
        load = [sum(1 if size == "one" else r[size] for r in out if r.shard == s) for s in range(8)]
        assert max(load) - min(load) <= most * sum(load) / 8, (size, load)
    for s in range(8):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert len({r.shard for r in out if r.text_crc32 == zlib.crc32(b"some group " * 9)}) == 1


@pytest.mark.parametrize("n", [0, 1, 3, 1023, 1024, 1025, 5000])
def test_simple8b(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 50_000, n), np.zeros(n), rng.integers(0, 2, n), 2.0 ** rng.uniform(0, 59, n), rng.integers(0, 2**64 - 1, n, dtype="u8")):
        ids = ids.astype(np.uint64)
        words, offsets = encode(ids)
        assert (decode(words, offsets, n) == ids).all()


def test_token_files(spark, docs, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file())
    want, start = [], 0
    for d, t in sorted(DOCS, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    found = token_files.token_table(docs, tokenizer_file())
    assert rows(found.where("doc_id is not null")) == expected(w for w in want if w[0] is not None)
    assert rows(found, "n_tokens", "ids_crc32") == expected(w[2:] for w in want)
    assert token_files.token_table(none, tokenizer_file()).count() == 0


@pytest.mark.parametrize("repeats", [1, 100_000])
def test_token_files_are_bounded_and_stay_in_order(spark, monkeypatch, repeats):
    monkeypatch.setattr(token_files, "FILE_SEGMENTS", 2)
    monkeypatch.setattr(token_files, "MOST_REPEATS", repeats)
    rng = random.Random(9)
    frame = spark.createDataFrame([(k % 700 if k % 9 else None, " ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(30)))) for k in range(1500)], "doc_id long, text string")
    path = token_files.write(frame, tokenizer_file(), segment_ids=100)
    found = token_files.read(spark, path).orderBy("file", "local").collect()
    assert len(found) == 1500 and len({r.file for r in found}) > 20
    ids = [-1 if r.doc_id is None else r.doc_id for r in found]
    assert ids == sorted(ids)
    place: dict = {}
    for r in found:
        assert r.local == place.get(r.file, 0)
        place[r.file] = r.local + r.n_tokens


@pytest.mark.parametrize("most", [1, 3, 50, 700])
def test_more_pieces_than_are_remembered(monkeypatch, most):
    monkeypatch.setattr(token_files, "CACHE_PIECES", most)
    rng = random.Random(2)
    with open(tokenizer_file(), encoding="utf-8") as f:
        encoder = token_files.PieceEncoder(f.read())
    texts = ["", " ", *(" ".join(rng.choice(["", "é", "a"]) + f"w{rng.randrange(900)}" + rng.choice(["", ".", ",x", "!", "y" * 70]) for _ in range(n)) for n in (1, 40, 3000, 2, 500)), "", "z" * 300]
    for _ in range(2):
        for part in (texts, texts[3:5], texts[::-1]):
            found = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(part)]
            assert found == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in part]


def test_pieces_encode_as_the_whole():
    rng = random.Random(4)
    with open(tokenizer_file(), encoding="utf-8") as f:
        encoder = token_files.PieceEncoder(f.read())
    bits = ["a", "the", " ", "  ", "\n", "\t", " \n", "é", "日", "😀", "'s", "12", "!", "\x1c", "\xa0", " ", "\x85", "<|endoftext|>", "<|", "|>"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(0, 12)))
        whole = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == whole, repr(text)


def test_viterbi_counts(docs, none):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = viterbi_counts.read_vocabulary(tokenizer_file("piece_bpe_32k.model"))
    ties = [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("aba", -3.0), ("▁", -1.0), ("▁a", -2.0)]
    rng = random.Random(6)
    noise = ["".join(rng.choice("ab c▁é日") for _ in range(rng.randrange(0, 14))) for _ in range(2000)]
    for words, fallback in ((vocabulary, True), (vocabulary, False), (ties, False)):
        tokenizer = Tokenizer(models.Unigram(words, 0, fallback))
        tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
        model = viterbi_counts.CountModel(words, 0, fallback)
        for text in noise + [t or "" for _, t in DOCS[:10]]:
            assert model.count(text) == len(tokenizer.encode(text, add_special_tokens=False).ids), repr(text)
    model = viterbi_counts.CountModel(vocabulary)
    assert rows(viterbi_counts.counted(docs, vocabulary)) == expected((d, model.count(t or ""), len(t or "")) for d, t in DOCS)
    assert viterbi_counts.counted(none, vocabulary).count() == 0


def test_viterbi_memory_does_not_follow_a_long_word():
    import tracemalloc

    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = viterbi_counts.read_vocabulary(tokenizer_file("piece_bpe_32k.model"))
    model = viterbi_counts.CountModel(vocabulary)
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefghij日本éß") for _ in range(300_000))
    tokenizer = Tokenizer(models.Unigram(vocabulary, 0, True))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    assert model.count(long[:100_000]) == len(tokenizer.encode(long[:100_000], add_special_tokens=False).ids)
    tracemalloc.start()
    assert model.count(long) > 100_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * len(long)


@pytest.mark.parametrize("bound", [100_000, 0])
def test_decontamination(spark, docs, none, monkeypatch, bound):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", bound)
    items = spark.createDataFrame([(i, t, 1, "x") for i, t in ITEMS], "item_id long, text string, h long, window string")
    named = spark.createDataFrame([(i, t) for i, t in ITEMS if i is not None], "item_id long, text string")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = brute.op8(DOCS, [x for x in ITEMS if x[0] is not None])
    assert rows(decontaminate.contamination(docs, named), *columns) == expected(want)
    assert decontaminate.contamination(docs, items).count() == len(DOCS)
    if bound:
        kept = decontaminate.decontaminated(docs, named)
        assert kept.columns == docs.columns
        assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(w[0]) for w in want if not w[5])
        assert decontaminate.contamination(none, named).count() == 0
        assert {r.n_hit for r in decontaminate.contamination(docs, named.limit(0)).collect()} == {0}


def test_line_quality(docs, none):
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    out = line_quality.judged(docs)
    assert rows(out, *columns) == expected(brute.op9(DOCS))
    kept = line_quality.cleaned(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, (r.doc_id for r in out.where("kept").collect())))
    assert {r["kept"] for r in kept.collect()} == {"no"}  # the clashing column is the table's own
    assert line_quality.judged(none).count() == 0


def test_line_rules(spark):
    lines = {"Plain prose here.": False, "no mark at all": True, "a | b | c | d.": True, "All rights reserved.": True, "word### word### wo.": True, "  ": False}
    frame = spark.createDataFrame(list(lines.items()), "line string, fails boolean")
    from pyspark.sql import functions as F

    assert frame.where(line_quality.line_fails(F.col("line")) != F.col("fails")).count() == 0


def test_raking_meets_its_targets():
    cells = [(s, g, t) for s in "ab" for g in "xy" for t in "mn"]
    tokens = np.arange(1.0, 9.0) ** 2
    targets = [{"a": 0.3, "b": 0.7}, {"x": 0.6, "y": 0.4}, {"m": 0.5, "n": 0.5}]
    weights, miss = raking.rake(cells, tokens, targets)
    for d, target in enumerate(targets):
        for name, share in target.items():
            assert abs(sum(w for c, w in zip(cells, weights) if c[d] == name) - share) < 1e-6
    assert miss < 1e-6
    chance = raking.probabilities(weights, tokens, 60.0)
    assert abs((chance * tokens).sum() - 60) < 1e-6 and chance.max() <= 1


def test_raking_tells_of_contradictory_targets(spark):
    targets = [{"a": 0.9, "b": 0.1}, {"x": 0.1, "y": 0.9}]
    weights, miss = raking.rake([("a", "x"), ("b", "y")], np.array([1.0, 1.0]), targets)
    assert abs(weights.sum() - 1) < 1e-9 and miss > 0.3
    frame = spark.createDataFrame([(1, "one two", "en", "a", "t"), (2, "three four", "de", "b", "t")], "doc_id long, text string, lang string, source string, topic string")
    named = {"source": {"a": 0.9, "b": 0.1}, "lang": {"en": 0.1, "de": 0.9}, "topic": {"t": 1.0}}
    assert raking.mixed(frame, named, topic_col="topic").first().miss > 0.3
    with pytest.raises(ValueError):
        raking.mixed(frame, named, topic_col="topic", most_miss=0.01)


def test_raking(docs, none, spark):
    out = raking.mixed(docs).cache()
    assert out.count() == len(DOCS) and raking.mixed(none).count() == 0
    found = out.select("doc_id", "text", "lang", "source", "topic", "n_tokens", "weight", "probability", "sampled").collect()
    assert brute.op10([tuple(r)[:6] for r in found], raking.TARGETS, 0.5, 42) == [(pytest.approx(r.weight, abs=1e-7), pytest.approx(r.probability, abs=1e-6), r.sampled) for r in found]
    kept = raking.sample(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, (r.doc_id for r in out.where("sampled").collect())))
    twins = {r.sampled for r in found if r.doc_id == 10}
    assert len(twins) == 1  # repeated rows are drawn alike
    whole = {r.doc_id for r in raking.mixed(docs, keep=1.0).where("n_tokens > 0 and probability > 0.999999").collect()}
    assert whole <= {r.doc_id for r in raking.sample(docs, keep=1.0).collect()}


def test_repeated_words_of_clashing_hashes(spark):
    """With two bits of hash left nearly all windows clash; counts must still be those of equal words."""
    F = pytest.importorskip("pyspark.sql.functions")
    rng = random.Random(6)
    lists = [[rng.choice("abcde") for _ in range(n)] for n in (2, 3, 4, 9, 30, 60)] + [[f"w{k % 17}" for k in range(70)], [f"w{k}" for k in range(50)]]
    frame = spark.createDataFrame([(k, x) for k, x in enumerate(lists)], "k long, w array<string>")
    want = {k: brute.op9([(k, " ".join(x))])[0][5] for k, x in enumerate(lists)}
    for bits, few in ((0, 64), (62, 0), (40, 0), (62, 64), (0, 1)):
        found = frame.select("k", line_quality.repeated_words(F.col("w"), 3, bits, few).alias("n")).collect()
        assert {r.k: r.n for r in found} == want


CLASHES = ["i", "t", "x", "row", "k", "j", "u", "w", "pos", "of", "h", "key", "code", "label", "place", "piece", "__i", "__t", "__text", "__place", "__weight", "__topic", "topic", "lang.x", "class", "component_id", "first", "sampled"]


@pytest.mark.parametrize("stage", [simhash.keep_one, raking.sample, raking.mixed, line_quality.cleaned, line_quality.judged, lambda d: decontaminate.decontaminated(d, d.sparkSession.createDataFrame([(1, "of and river the stone")], "item_id long, text string"))])
def test_columns_of_any_name_pass_through(spark, stage):
    rng = random.Random(1)
    rows_ = [(k, " ".join(rng.choice(["river", "stone.", "light", "moon", "sea"]) + str(rng.randrange(99)) for _ in range(80)) + ".", "en", "src1", *[f"{k}{c}" for c in CLASHES]) for k in range(12)]
    frame = spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASHES))
    out = stage(frame)
    names = [c for c in frame.columns if c in out.columns]
    replaced = {"topic", "sampled"} if stage is raking.mixed else set()
    assert set(CLASHES) <= set(out.columns)
    for r in out.collect():
        assert all(r[c] == f"{r.doc_id}{c}" for c in CLASHES if c in names and c not in replaced)


def test_topics_part_texts_of_unlike_words(spark):
    rng = random.Random(3)
    kinds = {"sea": "ship wave harbor sail tide".split(), "law": "court judge appeal statute clause".split()}
    made = [(k, " ".join(rng.choice(kinds[name] + ["the", "of", f"n{rng.randrange(500)}"]) for _ in range(60)), lang, name) for k, (name, lang) in enumerate((n, x) for n in kinds for x in ("en", "de") for _ in range(60))]
    frame = spark.createDataFrame([(d, t, x, "s") for d, t, x, _ in made], "doc_id long, text string, lang string, source string")
    model = topics.fit(frame, 2)
    found = model.label([t for _, t, _, _ in made], [x for *_, x, _ in made])
    agree = np.mean([(f == 1) == (name == "law") for f, (*_, name) in zip(found, made)])
    assert max(agree, 1 - agree) > 0.97
    assert model.label(["", "  "], ["en", None]).tolist() == [-1, -1]
    assert [r.topic for r in frame.select(topics.topic_column(model, frame.text, frame.lang).alias("topic")).collect()] == found.tolist()
    counted = topics.counts(["The the SEA\nsea", "", "a"])
    assert counted.sum(axis=1).tolist() == [4, 0, 1] and counted[0].max() == 2
