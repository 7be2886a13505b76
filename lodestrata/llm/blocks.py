"""Comparisons within groups of any size, in tasks of a bounded size.

Rows of one key are to be linked wherever a pair of them is near enough. A key of up to ``limit`` weight is compared in
one task. A larger one is dealt to blocks, each compared in a task of its own; then one member of each class found so
far stands for it, and these are compared; whatever still isn't in the key's main class is at last held against all the
key's rows, block by block. So no pair between two classes is left out, and a group of copies, which is one class
after the first steps, costs no more than its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import discard, stored
from lodestrata.llm.components import connected_components

LINKS = "a long, b long"
Links = tuple[np.ndarray, np.ndarray]


def whole_groups(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Sorted batches as tables of some ``rows`` rows, or of one larger group; the first column's groups stay whole."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if size >= rows:
            same = batch.column(0).to_numpy() == held[-1].column(0)[-1].as_py()
            cut = batch.num_rows if same.all() else int(same.argmin())
            if cut:
                held.append(batch.slice(0, cut))
                size += cut
            if cut == batch.num_rows:
                continue
            yield pa.Table.from_batches(held).combine_chunks()
            held, size, batch = [], 0, batch.slice(cut)
        held.append(batch)
        size += batch.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _inside(compare: Callable[[pa.Table], Links], rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, rows):
            a, b = compare(table)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _across(compare: Callable[[pa.Table, np.ndarray, np.ndarray], Links]):
    """Task body: (place, code, w, payload..., late, label) of one meeting of a block with late rows after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 1):
            places = table.column(0).to_numpy()
            cuts = np.flatnonzero(np.r_[True, places[1:] != places[:-1], True])
            for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                part = table.slice(low, high - low)
                late, label = part.column("late").to_numpy(), part.column("label").to_numpy().copy()
                if not late.any() or late.all():
                    continue
                a, b = compare(part, late, label)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def linked_in_blocks(rows: DataFrame, inside, across, limit: int, task_rows: int = 1 << 15) -> DataFrame:
    """Links (a, b) of codes that connect what all near pairs under a key connect.

    rows: (key long, code long, w long, payload...), distinct; w is what a row weighs against ``limit``.
    inside(table) gets whole groups, sorted by the first column, and gives links of codes; across(table, late, label)
    gives links between the rows marked late and the others, where the labels differ.
    """
    spark = rows.sparkSession
    payload = rows.columns[1:]
    sizes, sizes_path = stored(rows.groupBy("key").agg(F.sum("w").alias("total")).where(F.col("total") > limit), "large-keys")
    dealt = lambda df: df.repartition("place").sortWithinPartitions("place").mapInArrow(_inside(inside, task_rows), LINKS)
    if not sizes.head(1):
        discard(spark, sizes_path)
        return dealt(rows.withColumnRenamed("key", "place"))
    blocks = lambda total: F.ceil(F.col(total) / limit).cast("int")
    block = lambda n, turn: F.pmod(F.xxhash64("code", "key", F.lit(turn)), n).cast("int")
    small = rows.join(sizes, "key", "left_anti").select(F.col("key").alias("place"), *payload)
    large, large_path = stored(rows.join(sizes, "key").withColumn("blocks", blocks("total")).withColumn("block", block(F.col("blocks"), 0)).drop("total"), "large-rows")
    first, first_path = stored(dealt(small.union(large.select(F.xxhash64("key", "block").alias("place"), *payload))), "links-inside")

    def labelled(links: DataFrame) -> tuple[DataFrame, str]:
        classes = connected_components(links).select(F.col("node").alias("code"), F.col("component").alias("label"))
        return stored(large.join(classes, "code", "left").withColumn("label", F.coalesce("label", "code")), "labelled")

    marked, marked_path = labelled(first)
    stands = marked.groupBy("key", "label").agg(F.min("code").alias("code"))
    stands, stands_path = stored(marked.join(stands, ["key", "label", "code"], "left_semi"), "stand-ins")
    totals = stands.groupBy("key").agg(F.sum("w").alias("total"))
    stands = stands.join(totals, "key").withColumn("part", block(blocks("total"), 1))
    second, second_path = stored(dealt(stands.select(F.xxhash64("key", F.lit(-1), "part").alias("place"), *payload)), "links-of-stand-ins")
    discard(spark, marked_path)
    links = first.union(second)
    marked, marked_path = labelled(links)
    weights = marked.groupBy("key", "label").agg(F.sum("w").alias("weight"))
    main = weights.groupBy("key").agg(F.max_by("label", F.struct("weight", "label")).alias("main"))
    late, late_path = stored(marked.join(main, "key").where("label <> main").drop("main"), "late")
    third = late.limit(0).select(F.col("code").alias("a"), F.col("code").alias("b"))
    if late.head(1):
        chunks = late.groupBy("key").agg(F.ceil(F.sum("w") / limit).cast("int").alias("chunks"))
        met = marked.join(chunks, "key").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        asks = late.join(chunks, "key").withColumn("chunk", block(F.col("chunks"), 2)).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        columns = [F.xxhash64("key", "block", "chunk").alias("place"), *payload]
        both = met.select(*columns, F.lit(False).alias("late"), "label").union(asks.select(*columns, F.lit(True).alias("late"), "label"))
        third, _ = stored(both.repartition("place").sortWithinPartitions("place").mapInArrow(_across(across), LINKS), "links-across")
    discard(spark, sizes_path, large_path, marked_path, stands_path, late_path)
    return links.union(third)
