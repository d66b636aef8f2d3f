"""From documents to packed training sequences, stage by stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from dockledger.llm import decontaminate, lines, packing, quality, simhash
from dockledger.llm.ranges import saved

# Rows that a task hands to Python at once. An executor's tasks hold such a batch in the JVM, outside its heap, and in
# their workers, on the way there and back.
BATCH_ROWS = 1_000


def _in_small_batches(spark: SparkSession) -> None:
    """At most BATCH_ROWS rows a batch from here on in the session; a smaller setting of the caller stays.

    What a stage returns is read later, so the setting is not taken back.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier predicts to be good."""
    _in_small_batches(spark)
    return quality.keep_good(docs, _table(spark, sf_dir, "labels"))


def new_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one holds; n_chars counts what is left."""
    _in_small_batches(spark)
    return lines.without_repeated_lines(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, similarity 0.8."""
    _in_small_batches(spark)
    return simhash.without_near_copies(docs, shingle=5, threshold=0.8)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    _in_small_batches(spark)
    return decontaminate.without_leaks(docs, _table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens.

    Workers keep fewer words and code smaller blocks than the operator alone would: the stages share their memory.
    """
    _in_small_batches(spark)
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(docs, tokenizer, cached_words=150_000, block_bytes=2 << 20)


STAGES = [
    ("quality_classifier", good_documents),
    ("line_dedup", new_lines),
    ("near_dedup", one_of_each),
    ("decontamination", clean_of_benchmarks),
    ("packing", packed),
]

# The classifier, the fingerprints and the tokenizer have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; what a stage keeps is a table for the next."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
