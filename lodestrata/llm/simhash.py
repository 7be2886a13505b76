"""SimHash near-duplicate groups through a Gray-order hierarchical index.

Fingerprints that occur are linked when they differ in at most ``distance`` bits. Candidates are routed by
pigeonhole: with one block more than the allowed distance, a pair agrees on some whole block of its bits. Within
a routed group the fingerprints are sorted by Gray rank; nodes over eight neighbours keep the bits that all below
them share, and a pair of nodes is dropped with all its pairs once the shared bits alone differ too often.

A group that many fingerprints share (a hot block value) is routed again by blocks of the bits not yet agreed on,
up to three times. After three times 44 of 64 bits are fixed at least, so a group has at most 2**20 fingerprints
whatever the table holds. Groups leave one link for each fingerprint to its local root, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.blocks import whole_groups
from lodestrata.llm.common import discard, stored
from lodestrata.llm.components import connected_components, one_of_each

FAN = 8
BLOCK_BYTES = 4 << 20


def _word_runs(data: bytes, size: int) -> Iterator[list[bytes]]:
    """Words of a text in runs that overlap by size - 1 words; long texts come in several runs."""
    if len(data) <= BLOCK_BYTES:
        yield data.lower().split()
        return
    carry: list[bytes] = []
    at = 0
    while at < len(data):
        end = min(len(data), at + BLOCK_BYTES)
        while end < len(data) and data[end] not in b" \t\n\v\f\r":
            end += 1
        carry += data[at:end].lower().split()
        at = end
        if len(carry) >= size:
            yield carry
            carry = carry[len(carry) - size + 1 :]
    if carry and len(carry) < size:
        yield carry


def fingerprint(data: bytes | None, size: int = 3, seed: int = 42) -> int:
    """64-bit SimHash over word shingles, repeats included; 0 for a text without words."""
    ones, total, first = np.zeros(64, np.int64), 0, True
    digest = xxhash.xxh64_intdigest
    for words in _word_runs(data or b"", size):
        if len(words) >= size:
            shifted = zip(*(words[k:] for k in range(size)))
            hashes = np.fromiter((digest(b" ".join(s), seed) for s in shifted), "<u8", len(words) - size + 1)
        elif words and first:
            hashes = np.array([digest(b" ".join(words), seed)], "<u8")
        else:
            continue
        first = False
        for k in range(0, len(hashes), 1 << 15):
            part = hashes[k : k + (1 << 15)]
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0]) if total else 0


def fingerprints(docs: DataFrame, size: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, t, fp): one row for each row of docs; t is xxhash64 of the text, fp the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), size, seed) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], ["doc_id", "t", "fp"])

    chosen = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("t"), F.col(text_col).cast("binary").alias("text"))
    return chosen.mapInArrow(run, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, t long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each 64-bit code in the reflected Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _unite(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the classes of a[i] and b[i]; labels[i] is the smallest member known of i's class."""
    while len(a):
        x, y = labels[a], labels[b]
        differ = x != y
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        if not len(a):
            return
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            jumped = labels[labels]
            if np.array_equal(jumped, labels):
                break
            labels[:] = jumped


def linked_classes(codes: np.ndarray, keys: np.ndarray, distance: int, frontier: int = 1 << 20) -> np.ndarray:
    """For codes in order of (key, Gray rank): the index of each one's class, by links within a key.

    The tree's upper nodes hold the bits shared by all codes below them and the range of their keys.
    Pairs of nodes are descended together and dropped when their shared bits differ in over ``distance`` places.
    """
    n = len(codes)
    labels = np.arange(n)
    if n < 2:
        return labels
    every = np.uint64(2**64 - 1)
    levels = [(codes, np.full(n, every), keys, keys)]
    while len(levels[-1][0]) > 1:
        pattern, shared, low, high = levels[-1]
        starts = np.arange(0, len(pattern), FAN)
        ones = np.bitwise_and.reduceat(pattern & shared, starts)
        zeros = np.bitwise_and.reduceat(~pattern & shared, starts)
        levels.append((ones, ones | zeros, low[starts], high[np.minimum(starts + FAN, len(pattern)) - 1]))
    grid = np.arange(FAN)
    stack = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, left, right = stack.pop()
        if level == 0:
            _unite(labels, left, right)
            continue
        if len(left) * FAN * FAN > frontier and len(left) > 1:
            half = len(left) // 2
            stack += [(level, left[half:], right[half:]), (level, left[:half], right[:half])]
            continue
        pattern, shared, low, high = levels[level - 1]
        a = np.broadcast_to((left[:, None] * FAN + grid)[:, :, None], (len(left), FAN, FAN)).ravel()
        b = np.broadcast_to((right[:, None] * FAN + grid)[:, None, :], (len(left), FAN, FAN)).ravel()
        keep = (a < len(pattern)) & (b < len(pattern)) & ((a < b) if level == 1 else (a <= b))
        a, b = a[keep], b[keep]
        keep = low[b] <= high[a]
        a, b = a[keep], b[keep]
        keep = np.bitwise_count((pattern[a] ^ pattern[b]) & shared[a] & shared[b]) <= distance
        if keep.any():
            stack.append((level - 1, a[keep], b[keep]))
    return labels


def _local_links(distance: int, held_rows: int = 1 << 18):
    """Task body: rows by key; puts the groups into Gray order and yields one link for each code to its class's root.

    Whole groups are taken together up to ``held_rows`` codes, so a task holds that many, or one larger group.
    """

    def links(key: np.ndarray, turn: np.ndarray, code: np.ndarray) -> pa.RecordBatch | None:
        code, turn = code.view(np.uint64), turn.astype(np.uint64)
        turned = (code << turn) | (code >> ((np.uint64(64) - turn) % np.uint64(64)))
        order = np.lexsort((gray_rank(turned), key))
        key, code = key[order], code[order]
        labels = linked_classes(code, key, distance)
        own = np.flatnonzero(labels != np.arange(len(labels)))
        if len(own):
            return pa.RecordBatch.from_arrays([pa.array(code[own].view(np.int64)), pa.array(code[labels[own]].view(np.int64))], ["a", "b"])
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, held_rows):
            if found := links(*(table.column(k).to_numpy() for k in range(3))):
                yield found

    return run


def _blocks(width: int, count: int) -> list[tuple[int, int]]:
    cuts = [width * k // count for k in range(count + 1)]
    return [(cuts[k], cuts[k + 1] - cuts[k]) for k in range(count)]


def _split(groups: DataFrame, distance: int, depth: int) -> DataFrame:
    """Route each row once for every block of the bits that its key doesn't fix yet.

    ``rest`` holds those bits, ``width`` how many they are, ``turn`` the rotation that brings the first block's bits to the top.
    """
    width = 64
    for _ in range(depth):
        width = width - width // (distance + 1)
    pieces = []
    for k, (low, size) in enumerate(_blocks(width, distance + 1)):
        value = F.expr(f"shiftrightunsigned(rest, {low}) & {(1 << size) - 1}L")
        lower = F.expr(f"rest & {(1 << low) - 1}L")
        upper = F.expr(f"shiftleft(shiftrightunsigned(rest, {low + size}), {low})") if low + size < 64 else F.lit(0).cast("long")
        turn = F.lit(64 - low - size if depth == 0 else 0).cast("long")
        pieces.append(F.struct(F.xxhash64("key", F.lit(k), value).alias("key"), turn.alias("turn"), lower.bitwiseOR(upper).alias("rest")))
    return groups.select("fp", F.explode(F.array(*pieces)).alias("p")).select("fp", "p.key", "p.turn", "p.rest")


def hamming_links(codes: DataFrame, distance: int = 2, group_rows: int = 4096, levels: int = 3) -> DataFrame:
    """Links (a, b) that connect the same classes as all pairs of distinct codes within ``distance`` bits.

    codes: one column fp of distinct longs. Groups of over ``group_rows`` codes are routed anew by bits still free,
    until they have been routed ``levels`` times.
    """
    start = codes.select("fp", F.lit(0).cast("long").alias("key"), F.col("fp").alias("rest"))
    ready, groups = None, start
    for depth in range(levels):
        routed = _split(groups, distance, depth)
        sizes = routed.groupBy("key").count()
        large = sizes.where(F.col("count") > group_rows).select("key")
        if depth == levels - 1 or not large.head(1):
            done, groups = routed, None
        else:
            done, groups = routed.join(large, "key", "left_anti"), routed.join(large, "key", "left_semi")
        done = done.select("key", "turn", "fp")
        ready = done if ready is None else ready.union(done)
        if groups is None:
            break
    return ready.repartition("key").sortWithinPartitions("key").mapInArrow(_local_links(distance), "a long, b long")


def _classes(docs: DataFrame, distance: int, size: int, seed: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, t, fp, class, component_id), one row for each row of docs; class is the smallest fingerprint reachable."""
    spark = docs.sparkSession
    rows, _ = stored(fingerprints(docs, size, seed, id_col, text_col), "fingerprints")
    least, least_path = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "codes")
    links, path = stored(hamming_links(least.select("fp"), distance), "near")
    found, found_path = stored(connected_components(links), "classes")
    discard(spark, path)
    named = found.join(least.withColumnRenamed("fp", "node"), "node").groupBy("component").agg(F.min("least").alias("component_id"))
    of_code = found.join(named, "component").select(F.col("node").alias("fp"), F.col("component").alias("class"), "component_id")
    table = least.join(of_code, "fp", "left").select("fp", F.coalesce("class", "fp").alias("class"), F.coalesce("component_id", "least").alias("component_id"))
    # Written out, so that a hot fingerprint's rows can be split over the tasks of the join.
    table, _ = stored(table, "of-codes")
    discard(spark, least_path, found_path)
    return rows.join(table, "fp")


def near_duplicates(docs: DataFrame, distance: int = 2, size: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of docs.

    Equal fingerprints, and fingerprints within ``distance`` bits, are linked; component_id is the smallest doc_id
    reachable. Null or wordless texts have fingerprint zero and are linked like any other. Rows with a null doc_id
    take part in links; their component_id is the smallest known id of the class, null if it has none. Repeated
    rows keep a row each. Extra columns are not read. An empty table gives an empty result.
    """
    found = _classes(docs, distance, size, seed, id_col, text_col)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, distance: int = 2, size: int = 3, seed: int = 42) -> DataFrame:
    """Rows of docs with one document left of each near-duplicate group: the one of the smallest doc_id (see one_of_each)."""
    return one_of_each(docs, _classes(docs, distance, size, seed))
