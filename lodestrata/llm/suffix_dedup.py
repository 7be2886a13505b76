"""Removal of byte strings that an earlier document also holds, by suffix arrays over shards.

1. Every window of ``width`` bytes has a minimizer: the least hash among its 16-byte strings. Equal windows have equal
   minimizers, so a window can only repeat where its minimizer stands in two documents. Minimizers are counted over
   the corpus, and each shard of documents learns which of its own are shared.
2. Runs of windows with one shared minimizer become segments. Equal segments of a shard meet there; later owners lose
   them at once. One copy travels on, to the place that its minimizer names, so equal windows always meet. A minimizer
   of very many bytes of segments names too large a place; its windows travel one by one, each to where its bytes say.
3. There, place by place, shards of segments get a suffix array by Larsson-Sadakane refinement and common prefixes by Kasai's walk;
   windows that share ``width`` bytes form classes, shards are merged by binary search, and each class keeps its
   least document. All other windows of a class are cut.

No string is dropped or sampled: step 1 only leaves out windows that no second document can hold.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.suffix_array import Shard, merged_least, padded, words_at

GRAM = 16
BLOCK = 1 << 20
NO_ID = np.iinfo(np.int64).max
#: Partitions at most, so that a shuffle's blocks stay countable; beyond, a task takes several shards or places in turn.
MOST_PARTITIONS = 1 << 16
#: What ``many`` holds of a minimizer's segments in a chunk: whether two documents have one, above a power of two of their bytes.
_TWO, _POWER = 128, 127
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(29)
    x *= _C
    x ^= x >> np.uint64(32)
    return x


def _least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    span = 1
    while span < width:
        step = min(span, width - span)
        values = np.minimum(values[: len(values) - step], values[step:])
        span += step
    return values


def runs(texts: list[bytes], width: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(joined texts, minimizer, text, first, last) of each run of neighbouring windows with one minimizer; first and last are window starts in the joined texts."""
    data = b"".join(texts)
    n = len(data)
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths)
    if n < width:
        none = np.zeros(0, np.int64)
        return data, none.astype(np.uint64), none, none, none
    parts = [_block_runs(data, ends, low, min(low + BLOCK, n - width + 1), width) for low in range(0, n - width + 1, BLOCK)]
    return data, *(np.concatenate(column) for column in zip(*parts))


def _block_runs(data: bytes, ends: np.ndarray, low: int, high: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs of the windows that start from low to high - 1; in blocks, so that memory doesn't follow the text."""
    count = high - low
    words = words_at(padded(data[low : high + width - 1]), big=False)
    grams = _mix(words[: count + width - GRAM] * _A + words[GRAM // 2 : count + width - GRAM + GRAM // 2] * _B)
    least = _least_of(grams, width - GRAM + 1)
    texts = slice(int(np.searchsorted(ends, low, side="right")), int(np.searchsorted(ends, high - 1, side="right")) + 1)
    begin = np.concatenate([[0], ends])[texts].clip(min=low) - low
    stop = (ends[texts] - width + 1).clip(max=high) - low
    some = begin < stop
    head = np.ones(count + 1, bool)
    np.not_equal(least[1:], least[:-1], out=head[1:count])
    head[begin[some]] = head[stop[some]] = True
    starts = np.flatnonzero(head)
    first, last = starts[:-1] + low, starts[1:] - 1 + low
    owner = np.searchsorted(ends, first, side="right")
    valid = first + width <= ends[owner]
    return least[starts[:-1][valid]], owner[valid], first[valid], last[valid]


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each minimizer. Minimizers are least hashes, so they crowd near zero and are hashed again."""
    hashes = _mix(hashes * _A)
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _minimizers(width: int, buckets: int, chunk: int = 16 << 20):
    """Task body: (bucket, hashes, shards, many) of the minimizers of some documents; many: in two of these or more, and how many bytes their segments have."""

    def one(texts: list[bytes], shards: list[int]) -> pa.RecordBatch:
        _, value, owner, first, last = runs(texts, width)
        shard = np.array(shards, np.int32)[owner]
        order = np.lexsort((owner, value))
        size = (last - first + width)[order]
        value, owner, shard = value[order], owner[order], shard[order]
        other = np.concatenate([[True], (value[1:] != value[:-1])]) if len(value) else np.zeros(0, bool)
        several = np.concatenate([[False], (value[1:] == value[:-1]) & (owner[1:] != owner[:-1])]) if len(value) else np.zeros(0, bool)
        group = np.cumsum(other) - 1
        many = (np.bincount(group, several) > 0)[group] if len(value) else several
        bucket = _bucket(value, buckets)
        order = np.lexsort((value, shard, bucket))
        value, shard, many, bucket = value[order], shard[order], many[order], bucket[order]
        new = np.concatenate([[True], (value[1:] != value[:-1]) | (shard[1:] != shard[:-1])]) if len(value) else several
        if len(value):
            size = np.add.reduceat(size[order], np.flatnonzero(new))
        value, shard, many, bucket = value[new], shard[new], many[new], bucket[new]
        many = (many * _TWO + np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64)).astype(np.uint8)
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        own = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
        parts = [slice(cuts[b], cuts[b + 1]) for b in own]
        columns = [pa.array([x[p].tobytes() for p in parts], pa.binary()) for x in (value, shard, many)]
        return pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), *columns], ["bucket", "hashes", "shards", "many"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, shards, held = [], [], 0
        for batch in batches:
            for shard, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                texts.append(text.as_py())
                shards.append(shard)
                held += len(texts[-1])
                if held >= chunk:
                    yield one(texts, shards)
                    texts, shards, held = [], [], 0
        if texts:
            yield one(texts, shards)

    return run


def _shared(hot: int):
    """Task body: minimizers found in two documents or more, by shard: (shard, hashes, hot); hot: their segments have over ``hot`` bytes, or up to half as many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[bytes, bytes, bytes]] = []
        for batch in batches:
            found += zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)))
        if not found:
            return
        value, shard, many = (np.frombuffer(b"".join(part), kind) for part, kind in zip(zip(*found), (np.uint64, np.int32, np.uint8)))
        order = np.argsort(value, kind="stable")
        value, shard, many = value[order], shard[order], many[order]
        head = np.concatenate([[True], value[1:] != value[:-1]])
        group = np.cumsum(head) - 1
        count = np.bincount(group)
        keep = ((count > 1) | (np.bincount(group, many >= _TWO) > 0))[group]
        very = (np.bincount(group, 2.0 ** (many & _POWER)) > hot)[group][keep]
        value, shard = value[keep], shard[keep]
        order = np.lexsort((value, shard))
        value, shard, very = value[order], shard[order], very[order]
        new = np.concatenate([[True], (value[1:] != value[:-1]) | (shard[1:] != shard[:-1])]) if len(value) else np.zeros(0, bool)
        value, shard, very = value[new], shard[new], very[new]
        names, cuts = np.unique(shard, return_index=True)
        parts = [slice(a, b) for a, b in zip(cuts, [*cuts[1:], len(shard)])]
        yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pa.array([value[p].tobytes() for p in parts], pa.binary()), pa.array([very[p].tobytes() for p in parts], pa.binary())], ["shard", "hashes", "hot"])

    return run


_ROUTED = "route long, shard int, cuts binary, owners binary, lengths binary, bytes binary"


def _pack(rows: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> bytes:
    return np.stack([rows, starts, lengths], axis=1).astype("<i4").tobytes() if len(rows) else b""


def _in_order(docs: pa.Table) -> tuple[np.ndarray, list[bytes], pa.Table]:
    """A shard's documents by doc_id, those without one last, then by their text's hash."""
    docs = docs.select(["i", "t", "text"])
    ids = np.array([NO_ID if v is None else v for v in docs.column("i").to_pylist()], np.int64)
    order = np.lexsort((docs.column("t").to_numpy(), ids))
    docs = docs.take(pa.array(order))
    return ids[order], docs.column("text").to_pylist(), docs


def _segments(width: int, routes: int):
    """Group body: a shard's segments on their way, and what its own earlier documents cut at once."""

    def run(key, docs: pa.Table, shared: pa.Table) -> pa.Table:
        shard = int(key[0].as_py())
        known = np.frombuffer(b"".join(shared.column("hashes").to_pylist()), np.uint64) if shared.num_rows else np.zeros(0, np.uint64)
        hot = np.frombuffer(b"".join(shared.column("hot").to_pylist()), bool) if shared.num_rows else np.zeros(0, bool)
        order = np.argsort(known)
        known, hot = known[order], hot[order]
        ids, texts, _ = _in_order(docs)
        data, value, owner, first, last = runs(texts, width)
        at = np.minimum(np.searchsorted(known, value), max(len(known) - 1, 0))
        keep = known[at] == value if len(known) else np.zeros(len(value), bool)
        value, owner, first, last, very = value[keep], owner[keep], first[keep], last[keep], hot[at[keep]] if len(known) else keep[:0]
        base = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        least: dict[bytes, int] = {}
        cut: list[tuple[int, int, int]] = []
        going: dict[int, list[tuple[int, int, bytes, int]]] = {}
        route_of, tag_of = _bucket(value, routes), value & np.uint64(0xFFFFFFFF)
        for o, a, b, r, v, tag in zip(owner.tolist(), first.tolist(), last.tolist(), route_of.tolist(), very.tolist(), tag_of.tolist()):
            piece = data[a : b + width]
            doc = int(ids[o])
            if least.setdefault(piece, doc) < doc:
                cut.append((o, a - int(base[o]), len(piece)))
            elif v:
                for k in range(a, b + 1):
                    window = data[k : k + width]
                    name = int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "big")
                    going.setdefault((name >> 32) % routes, []).append((o, k - int(base[o]), window, name & 0xFFFFFFFF))
            else:
                going.setdefault(r, []).append((o, a - int(base[o]), piece, tag))
        rows = {"route": [], "shard": [], "cuts": [], "owners": [], "lengths": [], "bytes": []}
        if cut:
            for name, x in zip(rows, (shard, shard, np.array(cut, "<i4").tobytes(), None, None, None)):
                rows[name].append(x)
        for r, pieces in going.items():
            o, start, text, tag = zip(*pieces)
            place = np.stack([o, start], axis=1).astype("<i4").tobytes()
            for name, x in zip(rows, (r, shard, None, ids[list(o)].astype("<i8").tobytes() + place + np.array(tag, "<u4").tobytes(), np.array([len(t) for t in text], "<i4").tobytes(), zlib.compress(b"".join(text), 1))):
                rows[name].append(x)
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        return pa.table({n: pa.array(v, k) for (n, v), k in zip(rows.items(), kinds)})

    return run


#: Bytes of a place's segments up to which windows are counted before any are sorted; a larger place's are all sorted.
COUNTED_BYTES = 16 << 20


def _repeated(pieces: list[bytes], width: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(runs, piece, start): what is left of the pieces without the windows that are there once, as a hash of each tells.

    Equal windows have equal hashes, so none that is there twice is left out; a window more may stay.
    """
    lengths = np.array([len(p) for p in pieces], np.int64)
    ends = np.cumsum(lengths)
    if ends[-1] > COUNTED_BYTES:
        return pieces, np.arange(len(pieces)), np.zeros(len(pieces), np.int64)
    data = b"".join(pieces)
    found = []
    for low in range(0, len(data) - width + 1, BLOCK):
        count = min(BLOCK, len(data) - width + 1 - low)
        words = words_at(padded(data[low : low + count + width - 1]), big=False)
        hashes = words[:count] * _A
        for k in [*range(8, width - 8, 8), width - 8]:
            hashes ^= hashes >> np.uint64(32)
            hashes += words[k : k + count]
            hashes *= _B
        found.append(hashes ^ (hashes >> np.uint64(29)))
    hashes = np.concatenate(found)
    piece = np.repeat(np.arange(len(pieces)), lengths - width + 1)
    at = np.arange(len(piece)) + piece * (width - 1)  # each piece but the last ends in width - 1 places that start no window of its own
    hashes = hashes[at]
    inorder = np.sort(hashes)
    twice = np.unique(inorder[1:][inorder[1:] == inorder[:-1]])
    if not len(twice):
        return [], piece[:0], piece[:0]
    keep = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, hashes), len(twice) - 1)] == hashes)
    at, piece = at[keep], piece[keep]
    head = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (piece[1:] != piece[:-1])])
    firsts = np.flatnonzero(head)
    lasts = np.append(firsts[1:], len(at)) - 1
    runs_ = [data[a : b + width] for a, b in zip(at[firsts].tolist(), at[lasts].tolist())]
    piece = piece[firsts]
    return runs_, piece, at[firsts] - (ends - lengths)[piece]


def _cut_classes(width: int, shard_bytes: int):
    """Task body, rows in order of their place: suffix arrays over shards of a place's segments, merged; yields (shard, cuts) of windows with an earlier owner.

    Of equal segments the least owner's is sorted, once; later owners lose theirs whole. A segment that is then the
    only one of its minimizer has no window that another holds, and isn't sorted; nor is a window whose hash no other
    has. Two windows of one segment count as two, so that class stays and is judged by its owners.
    """

    def cuts(home: np.ndarray, row: np.ndarray, start: np.ndarray, length: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(home, kind="stable")
        home, row, start, length = home[order], row[order], start[order], length[order]
        names, firsts = np.unique(home, return_index=True)
        parts = [slice(x, y) for x, y in zip(firsts, [*firsts[1:], len(home)])]
        if len(names):
            yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pa.array([_pack(row[p], start[p], length[p]) for p in parts], pa.binary())], ["shard", "cuts"])

    def place(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        tags: list[np.ndarray] = []
        columns: list[tuple[np.ndarray, ...]] = []  # of each blob: segment, owner, document's row, start, length, home
        for home, owner, lengths, packed in rows:
            sizes = np.frombuffer(lengths, "<i4").astype(np.int64)
            data, ends = zlib.decompress(packed), np.cumsum(sizes)
            which = [known.setdefault(data[e - n : e], len(known)) for n, e in zip(sizes.tolist(), ends.tolist())]
            spot = np.frombuffer(owner, "<i4", 2 * len(sizes), 8 * len(sizes)).reshape(-1, 2)
            tags.append(np.frombuffer(owner, "<u4", len(sizes), 16 * len(sizes)))
            columns.append((np.array(which), np.frombuffer(owner, "<i8", len(sizes)), spot[:, 0], spot[:, 1], sizes, np.full(len(sizes), home, np.int32)))
        if not columns:
            return
        which, owner, row, start, size, home = (np.concatenate(c) for c in zip(*columns))
        first = np.full(len(known), NO_ID)
        np.minimum.at(first, which, owner)
        later = owner > first[which]
        yield from cuts(home[later], row[later], start[later], size[later])
        which, row, start, home = which[~later], row[~later], start[~later], home[~later]
        order = np.argsort(which, kind="stable")
        row, start, home = row[order], start[order], home[order]
        places = np.searchsorted(which[order], np.arange(len(known) + 1))
        tag = np.zeros(len(known), np.uint32)
        tag[which] = np.concatenate(tags)[~later]
        _, index, times = np.unique(tag, return_inverse=True, return_counts=True)
        chosen = np.flatnonzero(times[index] > 1)
        if not len(chosen):
            return
        pieces = list(known)
        pieces, of_chosen, skipped = _repeated([pieces[k] for k in chosen], width)
        if not pieces:
            return
        chosen = chosen[of_chosen]
        sizes = np.cumsum([len(p) for p in pieces])
        bounds = [0, *(np.searchsorted(sizes, np.arange(shard_bytes, int(sizes[-1]), shard_bytes)) + 1).tolist(), len(pieces)]
        spans = [(x, y) for x, y in zip(bounds, bounds[1:]) if x < y]
        shards = [Shard(pieces[x:y], first[chosen[x:y]], width) for x, y in spans]
        for (low, _), shard, least in zip(spans, shards, merged_least(shards)):
            segment = chosen[shard.segment + low]
            gone = least[shard.class_of] < first[segment]
            segment, offset = segment[gone], (shard.offset + skipped[shard.segment + low])[gone]
            order = np.lexsort((offset, segment))
            segment, offset = segment[order], offset[order]
            if not len(segment):
                continue
            head = np.concatenate([[True], (segment[1:] != segment[:-1]) | (offset[1:] != offset[:-1] + 1)])
            firsts = np.flatnonzero(head)
            lasts = np.append(firsts[1:], len(segment)) - 1
            of, begin, length = segment[firsts], offset[firsts], offset[lasts] - offset[firsts] + width
            times = places[of + 1] - places[of]  # a document may hold one segment in several places
            each = np.repeat(np.arange(len(of)), times)
            at = np.repeat(places[of] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(len(each))
            yield from cuts(home[at], row[at], start[at] + begin[each], length[each])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for route, home, done, *blob in zip(*(batch.column(c).to_pylist() for c in range(6))):
                if done is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([home], pa.int32()), pa.array([done], pa.binary())], ["shard", "cuts"])
                    continue
                if route != now:
                    yield from place(held)
                    now, held = route, []
                held.append((home, *blob))
        yield from place(held)

    return run


def _apply():
    """Group body: a shard's documents without the bytes that are cut."""

    def run(docs: pa.Table, cuts: pa.Table) -> pa.Table:
        _, texts, docs = _in_order(docs)
        found = np.frombuffer(b"".join(cuts.column("cuts").to_pylist()), "<i4").reshape(-1, 3).astype(np.int64) if cuts.num_rows else np.zeros((0, 3), np.int64)
        found = found[np.argsort(found[:, 0], kind="stable")]
        at = np.searchsorted(found[:, 0], np.arange(len(texts) + 1))
        removed, spans, kept = [], [], []
        for k, text in enumerate(texts):
            own = found[at[k] : at[k + 1]]
            if not len(own):
                removed.append(0)
                spans.append(0)
                kept.append(text)
                continue
            change = np.zeros(len(text) + 1, np.int32)
            np.add.at(change, own[:, 1], 1)
            np.add.at(change, own[:, 1] + own[:, 2], -1)
            gone = np.cumsum(change[:-1]) > 0
            removed.append(int(gone.sum()))
            spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
            kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
        sizes = [len(t) for t in texts]
        columns = [docs.column("i"), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans)), pa.array(kept, pa.binary())]
        return pa.table(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def deduplicated(docs: DataFrame, width: int = 50, doc_shard_bytes: int = 12 << 20, array_bytes: int = 3 << 20, hot: int = 64 << 20) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept), one row for each row of docs; kept holds the bytes left.

    Each byte covered by a ``width``-byte string that also starts in a document with a smaller doc_id is removed;
    strings are judged on the input. Null texts are empty. A null doc_id is larger than any other. Rows that repeat a
    doc_id count as one document: neither cuts the other. Texts shorter than ``width`` stay whole. Extra columns are
    not read. doc_id must be an integer.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("i"), F.xxhash64("text").alias("t"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // doc_shard_bytes))
    routes = max(1, -(-total // array_bytes))
    buckets = min(routes, MOST_PARTITIONS)
    by_number = lambda df, column, n: df.repartitionById(min(n, MOST_PARTITIONS), F.pmod(F.col(column), F.lit(min(n, MOST_PARTITIONS))).cast("int"))
    # Of as many partitions as there are shards each gets one; a hash of their numbers would put several in one.
    apart = lambda df: df.repartitionById(shards, "shard") if shards <= MOST_PARTITIONS else df.repartition(MOST_PARTITIONS, "shard")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("i", "t"), F.lit(shards)).cast("int"))
    counted = rows.select("shard", "text").mapInArrow(_minimizers(width, buckets), "bucket long, hashes binary, shards binary, many binary")
    shared = by_number(counted, "bucket", buckets).mapInArrow(_shared(hot), "shard int, hashes binary, hot binary")
    by_shard = apart(rows)
    going = by_shard.groupBy("shard").cogroup(apart(shared).groupBy("shard")).applyInArrow(_segments(width, routes), _ROUTED)
    cuts = by_number(going, "route", routes).sortWithinPartitions("route").mapInArrow(_cut_classes(width, array_bytes), "shard int, cuts binary")
    done = by_shard.groupBy("shard").cogroup(apart(cuts).groupBy("shard"))
    return done.applyInArrow(_apply(), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
