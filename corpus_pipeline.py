"""A corpus pipeline of five operators: language ID, line dedup, near-duplicate removal, decontamination, BPE round trip."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from centime.llm import bpe, decontaminate, language, linededup, simhash
from centime.llm.common import checkpoint_dir, remove_folder, spread, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those rejected go: null texts, those without letters, and close calls.

    Rows are judged by their own text, so ids may repeat or be null. All columns stay. No rows give no rows.
    """
    return language.keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten rows or more share; every row stays, perhaps with an empty text, and all columns.

    Null texts stay null. n_chars follows the text. Repeated rows count each. No rows give no rows.
    """
    return linededup.without_frequent_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of exact and near copies: that of the least doc_id, null ids last. All columns stay.

    Links need a similarity of 0.8 of five-word shingle sets. Texts without words, null ones included, are one group. Of repeated
    rows one stays; different texts of one id are told apart. No rows give no rows.
    """
    return simhash.keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; rows with one go, told apart by id and text. All columns stay. Null texts stay."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row; a null text has no tokens. Repeated rows stay."""
    return bpe.round_trip(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("bpe_round_trip", bpe_round_trip)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``; what each stage keeps is written and read again.

    A stage's files are taken away once the next one has written its own; the last stage's stay for the caller to read.
    """
    docs, folder = spread(table(spark, sf_dir, "documents")), f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove_folder(spark, f"{folder}/{before}")
        before = name
    return docs


#: The stages learn models and compare fingerprints, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None
