"""Shared pieces of the training-data operators: small column helpers, and where intermediate tables go."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.storage import clear, discard, new_path, shared_dir, stored

__all__ = ["BLANK", "WORD", "ascii_lower", "clear", "discard", "let", "load", "new_path", "shared_dir", "slices", "small_enough", "stored"]

#: Java character class of the blanks that separate words in the contracts: space and \t \n \v \f \r.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(column):
    """Lower-case A-Z only, as the contracts ask; lower() would also fold other letters.

    In a text of ASCII alone lower() does the same, and much faster than translate().
    """
    plain = F.octet_length(column) == F.length(column)
    return F.when(plain, F.lower(column)).otherwise(F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df has at most that many rows; reads no more than one row beyond."""
    return df.limit(rows + 1).count() <= rows


def let(value, body):
    """body(value) with value computed once a row, wherever the optimizer moves the expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def slices(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of some ``size`` bytes of a text column; a longer text alone."""
    low, held = 0, 0
    for k, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if held and held + n > size:
            yield batch.slice(low, k - low)
            low, held = k, 0
        held += n
    if low < batch.num_rows:
        yield batch.slice(low)
