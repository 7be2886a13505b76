"""Queries over the training-data operators and, where SQL can say the same, that SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import decontaminate, html_render, line_quality, raking, sentence_spans, simhash, suffix_dedup, token_files, vector_packing, viterbi_counts
from lodestrata.llm.common import load
from lodestrata.llm.oracle import ORACLE
from lodestrata.session import ship

Query = Callable[[SparkSession, str], DataFrame]


def _with_package(query: Query) -> Query:
    """The query, run where executors can import this package."""
    return lambda spark, sf_dir: query(ship(spark), sf_dir)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.deduplicated(load(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sentence_spans.deduplicated(load(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_sentences", "n_removed", "removed_words", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_html_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_render.rendered(load(spark, sf_dir, "pages"))


def op5_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_packing.sharded(load(spark, sf_dir, "documents"))


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public tokenizer's file: in LODESTRATA_TOKENIZERS if that is set, else where its package says."""
    if folder := os.environ.get("LODESTRATA_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_table(load(spark, sf_dir, "documents"), tokenizer_file())


def op7_viterbi_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = viterbi_counts.read_vocabulary(tokenizer_file("piece_bpe_32k.model"))
    return viterbi_counts.counted(load(spark, sf_dir, "documents"), vocabulary)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    return decontaminate.contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")).select(columns)


def op9_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lost"]
    return line_quality.judged(load(spark, sf_dir, "documents").select("doc_id", "text")).select(columns)


def op10_raking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raking.mixed(load(spark, sf_dir, "documents"))
    rounded = {c: F.round(c, 6) for c in ("weight", "probability", "miss")}
    return rows.select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", "miss", "sampled").withColumns(rounded)


def queries() -> dict[str, Query]:
    found = (op1_simhash, op2_suffix_dedup, op3_sentence_spans, op4_html_render, op5_vector_packing, op6_token_files, op7_viterbi_counts, op8_decontamination, op9_line_quality, op10_raking)
    return {f.__name__: _with_package(f) for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
