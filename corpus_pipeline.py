"""A training corpus from raw documents: five stages, each a Parquet table that the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import decontaminate, line_quality, near_copies, raking, token_files
from lodestrata.llm.common import discard, load, stored
from lodestrata.llm.registry import tokenizer_file
from lodestrata.session import ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-first rules keep, without the lines that fail."""
    return line_quality.cleaned(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (Jaccard similarity of five-word shingles of at least 0.8): that of the smallest doc_id.

    Candidates are found by SimHash fingerprints through their Gray-order index and, where those lie too far apart, by
    keys of parts of the shingle sets; all are checked exactly.
    """
    return near_copies.keep_one(ship(spark) and docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    return decontaminate.decontaminated(docs, load(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that sources, languages and topics meet their target shares of tokens."""
    return raking.sample(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the documents, and each document's place in them as read back."""
    return token_files.token_table(ship(spark) and docs, tokenizer_file())


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("token-ID / binary output", token_output),
]

#: SQL has neither the near copies' classes nor the tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the documents that all stages keep, from their token files.

    Each stage's table is written to the shared folder and read by the next one, after which it is removed. Documents
    without text, and those of fewer words than the rules ask for, go in the first stage. Rows without doc_id take part;
    of a group of near copies they stay only if no member has an id. Rows that repeat a doc_id count as copies of one
    document if their texts are near copies, else each is judged by its own text until near-dedup, where one of the rows
    with that id stays. Null languages and sources are classes of their own. Columns of any name pass through unread. An
    empty table gives no rows.
    """
    docs, path = load(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        done, new = stored(stage(spark, docs, sf_dir), name.replace(" ", "-").replace("/", ""))
        if path:
            discard(spark, path)
        docs, path = done, new
    return STAGES[-1][1](spark, docs, sf_dir)
