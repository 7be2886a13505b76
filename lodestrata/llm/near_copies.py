"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8, and what they link.

Equal sets collapse first. Candidates come in two ways. Texts are linked by op1's method: their SimHash fingerprints are
routed by agreeing blocks and joined by the tree in Gray order, here within RADIUS bits. Most texts of that similarity
lie further apart than any radius at which blocks still tell fingerprints apart, so those links alone would lose pairs;
the keys below find these too. What either way links is then checked exactly.

Two sets of that similarity differ in at most a ninth of their sizes' sum, so when shingles
are dealt by hash to more parts than that, some part holds the same shingles in both: the hash of every part that isn't
empty is a key (for large sets, of every part that isn't small). Sizes fall into classes so wide that a partner's class
is the same or a neighbour. Two sets can only miss each other if all parts in which they agree are empty, or for large
sets small; small sets are dealt several times over, so that this has a chance of under 1e-9 for any pair.

Pairs under a key are dropped when the parities of their shingles' counts in 256 buckets differ more often than the
sets may. What is left hangs together in groups, and in each group similarities are computed exactly. Keys and groups
of any size are compared in tasks of a bounded size (see blocks).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.blocks import linked_in_blocks
from lodestrata.llm.characters import BYTE_BLANK, BYTES, A, B, mix, part_hashes
from lodestrata.llm.common import discard, slices, stored
from lodestrata.llm.components import connected_components, one_of_each
from lodestrata.llm.simhash import _unite, fingerprint, hamming_links

SIZE = 5
#: Bytes of texts that go through together; a longer text goes alone.
BATCH_BYTES = 1 << 19
#: Similarity asked for, as a fraction.
NUM, DEN = 4, 5
#: Bits by which fingerprints of candidates may differ, and how often their blocks are routed anew: then 43 bits are fixed at least.
RADIUS, LEVELS = 3, 4

LOW = [1, 2]
while LOW[-1] < 1 << 40:
    LOW.append(max(LOW[-1] + 1, DEN * (LOW[-1] - 1) // NUM + 1))


def shingle_sets(texts: list[bytes | None], size: int = SIZE) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its word shingles; of the whole text if it has fewer words, none without words."""
    data = [t or b"" for t in texts]
    lengths = np.fromiter(map(len, data), np.int64, len(data))
    base = np.cumsum(lengths) - lengths
    joined = np.frombuffer(b"".join(data), np.uint8)
    begins = np.zeros(len(joined) + 1, bool)
    begins[base] = True
    blank = BYTE_BLANK[joined]
    begins[1:-1] |= blank[:-1]
    begins[:-1] &= ~blank
    starts = np.flatnonzero(begins[:-1])
    word = part_hashes(joined, starts, tables=BYTES[:1])[:, 0]
    first = np.searchsorted(starts, np.append(base, len(joined)))
    run = word.copy()
    for k in range(1, size):  # the hash of the words from each place on; those that cross a text's end aren't taken
        run = mix(run[: len(word) - k] * A + word[k:]) if len(word) > k else run[:0]
    out = []
    for low, high in zip(first[:-1].tolist(), first[1:].tolist()):
        if high - low >= size:
            out.append(np.unique(run[low : high - size + 1]))
            continue
        whole = np.full(min(1, high - low), np.uint64(high - low))
        for k in range(low, high):
            whole = mix(whole * B + word[k : k + 1])
        out.append(whole)
    return out


def code(members: np.ndarray) -> int:
    """64-bit name of a set, as a signed long; 0 for the empty one."""
    named = xxhash.xxh64_intdigest(members.tobytes()) if len(members) else 0
    return named - (1 << 64) if named >> 63 else named


def parities(members: np.ndarray) -> bytes:
    """256 bits: whether each bucket holds an odd number of the set. Two sets' bits differ in as many places as they have elements apart, or fewer."""
    return np.packbits((np.bincount((members >> np.uint64(13)).astype(np.int64) & 255, minlength=256) & 1).astype(np.uint8), bitorder="little").tobytes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _parts(size_class: int) -> int:
    return 2 * (LOW[size_class + 1] - 1) * (DEN - NUM) // (DEN + NUM) + 1


def _deals(parts: int) -> int:
    return next((n for most, n in ((3, 8), (6, 5), (12, 3), (24, 2)) if parts <= most), 1)


def _least_held(parts: int) -> int:
    """Shingles of a part that makes a key. With many parts enough agree to leave small ones out, which a common passage may fill alone."""
    return 6 if parts >= 400 else 4 if parts >= 100 else 1


def keys(members: np.ndarray) -> np.ndarray:
    """Keys of a set; sets of the similarity asked for have one in common, equal sets aside."""
    if not len(members):
        return members
    own = int(np.searchsorted(LOW, len(members), "right")) - 1
    out = []
    for c in (own, own + 1):
        parts = _parts(c)
        if parts == 1:  # only equal sets are near enough
            continue
        for deal in range(_deals(parts)):
            salt = _mixed(np.array([(c << 8) + deal + 1], np.uint64))[0]
            hashes = _mixed(members ^ salt)
            part = (hashes % np.uint64(parts)).astype(np.int64)
            sums = np.zeros(parts, np.uint64)
            np.add.at(sums, part, _mixed(hashes))
            held = np.flatnonzero(np.bincount(part, minlength=parts) >= _least_held(parts))
            out.append(_mixed(sums[held] ^ _mixed(held.astype(np.uint64) + salt)))
    return np.concatenate(out) if out else members[:0]


def _named(docs: DataFrame) -> DataFrame:
    """(doc_id, t, code, size, bits, fp): one row for each row of docs; t is a hash of its text, fp its SimHash fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, BATCH_BYTES):
                texts = part.column(2).to_pylist()
                sets = shingle_sets(texts)
                prints = np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64)
                columns = [part.column(0), part.column(1), pa.array(map(code, sets), pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(map(parities, sets), pa.binary()), pa.array(prints)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "t", "code", "size", "bits", "fp"])

    chosen = docs.select("doc_id", F.xxhash64("text").alias("t"), F.col("text").cast("binary").alias("text"))
    return chosen.mapInArrow(run, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, t long, code long, size long, bits binary, fp long")


def fingerprint_links(rows: DataFrame) -> tuple[DataFrame, str]:
    """Links (a, b) of codes that connect all sets whose texts' fingerprints are equal or within RADIUS bits, and their path. rows: (code, size, fp)."""
    spark = rows.sparkSession
    printed, printed_path = stored(rows.where("size > 0").select("fp", "code").distinct(), "prints")
    first, first_path = stored(printed.groupBy("fp").agg(F.min("code").alias("first")), "first-prints")
    same = printed.join(first, "fp").where("code <> first").select(F.col("code").alias("a"), F.col("first").alias("b"))
    near = hamming_links(first.select("fp"), RADIUS, levels=LEVELS)
    for end in ("a", "b"):
        near = near.join(first.select(F.col("fp").alias(end), F.col("first").alias(f"of_{end}")), end)
    found = stored(same.union(near.select("of_a", "of_b")).where("a <> b"), "print-links")
    discard(spark, printed_path, first_path)
    return found


#: A task that meets over HOT sets under a key sends its further ones to SALTS partitions instead of one.
HOT, SALTS = 2048, 64


def _routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task body, texts to (key, salt, code): every key of every set that the task meets, a set once.

    Salt is 0 but for keys met often (counted in 2**20 places, which may count two keys as one); such a key also gets
    two rows of codes that no set has, so that it counts as shared wherever its other rows go.
    """
    seen: set[int] = set()
    met = np.zeros(1 << 20, np.int32)
    for batch in batches:
        for part in slices(batch, 0, BATCH_BYTES):
            found, names = [], []
            for members in shingle_sets(part.column(0).to_pylist()):
                name = code(members)
                if name not in seen:
                    seen.add(name)
                    found.append(np.unique(keys(members)))
                    names.append(np.full(len(found[-1]), name, np.int64))
            if not found:
                continue
            key, name = np.concatenate(found), np.concatenate(names)
            place = (_mixed(key) >> np.uint64(44)).astype(np.int64)
            np.add.at(met, place, 1)
            hot = met[place] > HOT
            salt = np.where(hot, 1 + (_mixed(name.view(np.uint64)) % np.uint64(SALTS)).astype(np.int32), 0)
            if hot.any():
                often = np.unique(key[hot])
                key = np.concatenate([key, often, often])
                name = np.concatenate([name, np.full(len(often), -1), np.full(len(often), -2)])
                salt = np.concatenate([salt, np.zeros(2 * len(often), salt.dtype)])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(salt, pa.int32()), pa.array(name)], ["key", "salt", "code"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task body, sorted rows (key, salt, code): each row once if its key has several codes or a salt. Holds a batch at a time."""

    def rows(key: np.ndarray, name: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(name)], ["key", "code"])

    last: tuple | None = None  # the row before, and whether it is known to share its key
    for batch in batches:
        key, salt, name = (batch.column(k).to_numpy() for k in range(3))
        known = np.zeros(len(key), bool)
        if last is not None:
            key, salt, name, known = np.r_[last[0], key], np.r_[last[1], salt], np.r_[last[2], name], np.r_[last[3], known]
        if not len(key):
            continue
        same = (key[1:] == key[:-1]) & (salt[1:] == salt[:-1])
        fresh = np.r_[True, ~same | (name[1:] != name[:-1])]
        fresh[0] = True
        key, salt, name, known = key[fresh], salt[fresh], name[fresh], known[fresh]
        same = (key[1:] == key[:-1]) & (salt[1:] == salt[:-1])
        known = known | (salt > 0)
        known[1:] |= same
        known[:-1] |= same
        out = known.copy()
        out[-1] = False
        if out.any():
            yield rows(key[out], name[out])
        last = (key[-1], salt[-1], name[-1], known[-1])
    if last is not None and last[3]:
        yield rows(np.array([last[0]]), np.array([last[2]]))


def _near(size: np.ndarray, bits: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sizes and parities leave it open that the sets a and b are similar enough."""
    small, large = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
    apart = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64)
    return (DEN * small >= NUM * large) & ((DEN + NUM) * apart <= (DEN - NUM) * (small + large))


def _bits_of(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("bits").to_pylist()), "<u8").reshape(-1, 4)


def _candidates(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all pairs under a key that may be similar, as sizes and parities say."""
    key, name, size, bits = table.column(0).to_numpy(), table.column("code").to_numpy(), table.column("size").to_numpy(), _bits_of(table)
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    lengths = np.diff(np.r_[starts, len(key)])
    labels = np.arange(len(key))
    for gap in range(1, min(int(lengths.max()), 33)):
        a = np.flatnonzero(key[gap:] == key[:-gap])
        a = a[_near(size, bits, a, a + gap)]
        _unite(labels, a, a + gap)
    for start, n in zip(starts[lengths > 33], lengths[lengths > 33]):
        for k in range(33, n):
            a = np.arange(start, start + n - k)
            a = a[labels[a] != labels[a + k]]
            a = a[_near(size, bits, a, a + k)]
            _unite(labels, a, a + k)
    links = np.unique(np.stack([name, name[labels]], axis=1)[labels != np.arange(len(labels))], axis=0)
    return links[:, 0], links[:, 1]


def _meet(name: np.ndarray, late: np.ndarray, label: np.ndarray, near) -> tuple[np.ndarray, np.ndarray]:
    """Links of each late row to one row of every other class that near(row, rows) finds; classes linked become one."""
    a, b = [], []
    others = np.flatnonzero(~late)
    for k in np.flatnonzero(late).tolist():
        open_ = others[label[others] != label[k]]
        hits = open_[near(k, open_)] if len(open_) else open_
        if len(hits):
            classes, first = np.unique(label[hits], return_index=True)
            a += [name[k]] * len(classes)
            b += name[hits[first]].tolist()
            label[np.isin(label, classes)] = label[k]
    return np.array(a, np.int64), np.array(b, np.int64)


def _candidates_across(table: pa.Table, late: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size, bits = table.column("size").to_numpy(), _bits_of(table)
    return _meet(table.column("code").to_numpy(), late, label, lambda k, rows: _near(size, bits, np.full(len(rows), k), rows))


def linked(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the index of its class's first set, by links between all pairs that are similar enough."""
    labels, left = np.full(len(sets), -1), np.arange(len(sets))
    lengths = np.array([len(s) for s in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark = np.zeros(flat.max() + 1 if len(flat) else 1, bool)
    place = np.r_[0, np.cumsum(lengths)]
    own = [flat[place[k] : place[k + 1]] for k in range(len(sets))]
    while len(left):
        front = [left[0]]
        labels[left[0]] = left[0]
        gone = 0
        while front:
            k = front.pop()
            # Sets that have a class are taken out as soon as they are half of the rest.
            open_ = labels[left] < 0
            gone = len(left) - int(open_.sum())
            if 2 * gone >= len(left):
                flat = flat[np.repeat(open_, lengths[left])]
                left = left[open_]
                open_ = np.ones(len(left), bool)
            if not len(left):
                break
            mark[own[k]] = True
            common = np.add.reduceat(mark[flat], np.r_[0, np.cumsum(lengths[left])[:-1]], dtype=np.int64)
            mark[own[k]] = False
            near = left[open_ & (DEN * common >= NUM * (lengths[left] + lengths[k] - common))]
            labels[near] = labels[k]
            front += near.tolist()
        open_ = labels[left] < 0
        flat, left = flat[np.repeat(open_, lengths[left])], left[open_]
    return labels


def _sets(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(m.as_buffer(), "<u8") for m in table.column("members")]


def _exact(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Links of the sets in each group to the first of their class, by exact similarity."""
    group, name, sets = table.column(0).to_numpy(), table.column("code").to_numpy(), _sets(table)
    cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
    a, b = [], []
    for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        labels = linked(sets[low:high])
        own = np.flatnonzero(labels != np.arange(high - low))
        a.append(name[low + own])
        b.append(name[low + labels[own]])
    return np.concatenate(a), np.concatenate(b)


def _exact_across(table: pa.Table, late: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sets = _sets(table)
    lengths = np.array([len(s) for s in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    place = np.r_[0, np.cumsum(lengths)]
    mark = np.zeros(int(flat.max()) + 1, bool)

    def near(k: int, rows: np.ndarray) -> np.ndarray:
        fits = (DEN * np.minimum(lengths[rows], lengths[k]) >= NUM * np.maximum(lengths[rows], lengths[k]))
        out = np.zeros(len(rows), bool)
        if fits.any():
            own = flat[place[k] : place[k + 1]]
            mark[own] = True
            found = np.flatnonzero(fits)
            common = np.array([np.count_nonzero(mark[flat[place[r] : place[r + 1]]]) for r in rows[found].tolist()])
            out[found] = DEN * common >= NUM * (lengths[rows[found]] + lengths[k] - common)
            mark[own] = False
        return out

    return _meet(table.column("code").to_numpy(), late, label, near)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task body, texts to (code, members, w); a set once."""
    seen: set[int] = set()
    for batch in batches:
        for part in slices(batch, 0, BATCH_BYTES):
            names, sets = [], []
            for members in shingle_sets(part.column(0).to_pylist()):
                if (name := code(members)) not in seen:
                    seen.add(name)
                    names.append(name)
                    sets.append(members)
            if names:
                columns = [pa.array(names, pa.int64()), pa.array([len(s) + 256 for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["code", "w", "members"])


#: Sets under a key that one task compares by their parities, and shingles of sets that one task compares exactly.
KEY_SETS = 8192
GROUP_SHINGLES = 3_000_000


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, t, class, component_id), one row for each row of docs: t is xxhash64 of the text, class names its class.

    Texts of a similarity of at least 0.8 are linked; component_id is the smallest doc_id reachable, null if no text
    reachable has one. Texts without words are linked to each other, texts of fewer than five words to equal ones.
    """
    spark = docs.sparkSession
    rows, _ = stored(_named(docs), "named")
    least, least_path = stored(rows.groupBy("code").agg(F.min("doc_id").alias("least"), F.min("t").alias("t"), F.min("size").alias("size"), F.min("bits").alias("bits")), "sets")
    texts = docs.select(F.col("text").cast("binary").alias("text"))
    routed = texts.mapInArrow(_routed, "key long, salt int, code long").repartition("key", "salt").sortWithinPartitions("key", "salt", "code")
    shared, shared_path = stored(routed.mapInArrow(_shared, "key long, code long"), "shared")
    met = shared.join(least.select("code", "size", "bits"), "code").select("key", "code", F.lit(1).cast("long").alias("w"), "size", "bits")
    alike, alike_path = fingerprint_links(rows)
    links, link_path = stored(alike.union(linked_in_blocks(met, _candidates, _candidates_across, KEY_SETS)), "candidates")
    groups, groups_path = stored(connected_components(links).select(F.col("node").alias("code"), F.col("component").alias("key")), "groups")
    discard(spark, shared_path, link_path, alike_path)
    chosen, chosen_path = stored(least.join(groups, "code").select("t"), "chosen")
    hashed = docs.select(F.xxhash64("text").alias("t"), F.col("text").cast("binary").alias("text"))
    members = hashed.join(chosen, "t", "left_semi").select("text").mapInArrow(_members, "code long, w long, members binary")
    members, members_path = stored(members.join(groups, "code").select("key", "code", "w", "members"), "members")
    links, link_path = stored(linked_in_blocks(members, _exact, _exact_across, GROUP_SHINGLES, 1 << 12), "near")
    found, found_path = stored(connected_components(links), "classes")
    discard(spark, groups_path, chosen_path, members_path, link_path)
    named = found.join(least.withColumnRenamed("code", "node"), "node").groupBy("component").agg(F.min("least").alias("component_id"))
    of_code = found.join(named, "component").select(F.col("node").alias("code"), F.col("component").alias("class"), "component_id")
    table = least.join(of_code, "code", "left").select("code", F.coalesce("class", "code").alias("class"), F.coalesce("component_id", "least").alias("component_id"))
    table, _ = stored(table, "of-sets")  # so that a hot set's rows can be split over the tasks of the join
    discard(spark, least_path, found_path)
    return rows.join(table, "code").select("doc_id", "t", "class", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """Rows of docs with one document left of each group of near copies: the one of the smallest doc_id (see one_of_each)."""
    classes, _ = stored(near_copies(docs), "near-copies")
    return one_of_each(docs, classes)
