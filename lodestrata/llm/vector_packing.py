"""Sharding by vector bin packing: bytes, tokens and rows of the shards are balanced jointly.

The items to pack are groups of equal texts, each a vector of its share of all bytes, tokens and rows. An item goes to
the shard where its vector's dot product with what that shard still can take is highest.

Groups of over a 128th of the table in some dimension (3 * 128 at most) are packed first, on the driver. All other
groups are dealt by their hash to cells, and every cell packs its own groups, one by one, into the room that the large
groups left, of which it takes a share as large as its own share of the table. So each group is placed by the method,
no task or driver holds more than a block of them, and the cells' imbalances, an item each at most, cancel out.
A group larger than a shard fits nowhere whole and is packed in 64 pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import WORD, stored

#: Pieces of a group that outgrows a shard; its rows go to pieces by the hash of their number.
PIECES = 64
#: A group of over 1/HEAVY of the table in some dimension is packed before all others.
HEAVY = 128
#: Groups that a cell packs at once, and cells at most; a cell of more groups packs them block by block.
BLOCK = 1 << 15
CELLS = 8192
#: Rows that a task numbers are all rows divided by so many, times the shards.
LOTS = 8192
DIMENSIONS = ("size", "n_tokens", "n")


def pack(items: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Shard of each item (rows of shares), by the greatest dot product with the room left; room is used up in place.

    Items of over a 64th of a shard go first, the largest ahead; then the others as they come, so that items rich in
    bytes and items rich in rows meet all shards alike; the smallest tenth goes last and evens out. Of equally good
    shards the first is taken. An item goes among the shards with room for it in every dimension, if there are none
    among those with room for its bytes, whose law holds, else where that is most.
    """
    placed = np.zeros(len(items), np.int32)
    top = items.max(axis=1)
    phase = np.where(top * 64 * len(room) > 1, 0, np.where(top > np.quantile(top, 0.1), 1, 2))
    for item in np.lexsort((np.arange(len(items)), np.where(phase == 1, 0, -top), phase)).tolist():
        vector = items[item]
        left = room - vector >= -1e-12
        fits = left.all(axis=1)
        if not fits.any():
            fits = left[:, 0]
        best = int((np.where(fits, room @ vector, -np.inf) if fits.any() else room[:, 0]).argmax())
        placed[item] = best
        room[best] -= vector
    return placed


def _cell_packer(share: np.ndarray):
    """Task body: (cell, group, size, n_tokens, n), by cell and group, to (group, shard). share: of the room left, each shard's part by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room = np.zeros_like(share)
        now = None
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            groups = np.concatenate([g for g, _ in held])
            items = np.concatenate([v for _, v in held])
            room[:] += share * items.sum(axis=0)
            scale = np.maximum(items.sum(axis=0), 1)
            part = room / scale
            shards = pack(items / scale, part)
            room[:] = part * scale
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(groups), pa.array(shards)], ["group", "shard"])

        for batch in batches:
            cells, groups = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            vectors = np.stack([batch.column(k).to_numpy() for k in range(2, 5)], axis=1).astype(float)
            cuts = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)]
            for low, high in zip(cuts, cuts[1:]):
                if low == high:
                    continue
                if cells[low] != now:
                    if held:
                        yield flush()
                    room[:] = 0
                    now = cells[low]
                held.append((groups[low:high], vectors[low:high]))
                if sum(len(g) for g, _ in held) >= BLOCK:
                    yield flush()
        if held:
            yield flush()

    return run


def sharded(docs: DataFrame, shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, n_tokens), one row for each row of docs.

    law is 'bytes': the shards' sums of size are near equal, and those of words and rows as near as whole groups allow.
    slot counts a shard's rows from 0 without gaps. Equal texts share a shard unless they outgrow it. Null texts count
    one byte and no words and form a group with each other. Repeated rows keep a row each, rows without doc_id too.
    grown_shard is null under this law. Extra columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.size(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))).cast("long").alias("n_tokens"),
        F.xxhash64("text").alias("group"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows, _ = stored(rows, "sizes")  # written once, so a row keeps its number
    sums = [F.sum("size").alias("size"), F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n")]
    total = rows.agg(*sums, F.approx_count_distinct("group").alias("groups")).first()
    if not total["n"]:
        return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "n_tokens")
    groups, _ = stored(rows.groupBy("group").agg(*sums), "groups")
    large = F.lit(False)
    for name in DIMENSIONS:
        large = large | (F.col(name) * HEAVY > F.lit(total[name]))
    whole = np.array([max(total[name], 1) for name in DIMENSIONS], float)
    heavy = {r["group"]: np.array([r[name] for name in DIMENSIONS]) / whole for r in groups.where(large).orderBy("group").collect()}
    outgrown = [g for g, v in heavy.items() if v[0] * shards > 1]
    # Pieces of the groups that outgrow a shard, as they fall; an item is a whole group or one piece.
    piece = F.pmod(F.xxhash64("row"), F.lit(PIECES)).cast("int")
    split = rows.where(F.col("group").isin(outgrown)).groupBy("group", piece.alias("piece")).agg(*sums).orderBy("group", "piece").collect() if outgrown else []
    items = [(g, -1, v) for g, v in heavy.items() if g not in outgrown] + [(r["group"], r["piece"], np.array([r[name] for name in DIMENSIONS]) / whole) for r in split]
    room = np.full((shards, len(DIMENSIONS)), 1 / shards)
    placed = pack(np.array([v for *_, v in items]), room).tolist() if items else []
    left = np.maximum(room, 0)
    share = np.divide(left, left.sum(axis=0), out=np.full_like(left, 1 / shards), where=left.sum(axis=0) > 1e-12)
    fixed = spark.createDataFrame([(g, p, s) for (g, p, _), s in zip(items, placed)], "group long, piece int, heavy_shard int")

    cells = min(CELLS, max(1, total["groups"] // BLOCK))
    small = groups.where(~large).select(F.pmod("group", F.lit(cells)).alias("cell"), "group", *DIMENSIONS)
    small = small.repartition("cell").sortWithinPartitions("cell", "group")
    packed, _ = stored(small.mapInArrow(_cell_packer(share), "group long, shard int"), "packed")
    known = rows.withColumn("piece", F.when(F.col("group").isin(outgrown), piece).otherwise(-1) if outgrown else F.lit(-1))
    out = known.join(F.broadcast(fixed), ["group", "piece"], "left").join(packed, "group", "left")  # a packed group is under a 128th of the rows
    out = out.select("doc_id", "size", "text_crc32", "n_tokens", "row", F.coalesce("heavy_shard", "shard").alias("shard"))
    lots = max(1, min(LOTS, total["n"] // 50_000))
    out = out.withColumn("lot", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(lots)).cast("int"))
    out, _ = stored(out, "placed")
    before = Window.partitionBy("shard").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)  # at most LOTS rows a shard
    firsts = out.groupBy("shard", "lot").agg(F.count("*").alias("n")).select("shard", "lot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    number = F.row_number().over(Window.partitionBy("shard", "lot").orderBy("row")) - 1
    out = out.join(F.broadcast(firsts), ["shard", "lot"]).withColumn("slot", F.col("first") + number)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "n_tokens")
