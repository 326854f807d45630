"""Corpus pipeline: STAGES turn ``documents`` into training data, each stage from what the one before kept.

All stages but the last return the columns of ``documents``. Each takes (spark, docs, sf_dir), works on whole
texts of all rows of docs, and puts up with null and empty texts, repeated rows and empty tables as the
operator that it calls says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import decontaminate, language_id, line_dedup, minhash_dedup, sentencepiece_sampling
from nearfield.llm.common import discard, materialise, table
from nearfield.llm.queries import tokenizer_path

#: Words of a shingle, and the similarity in percent, from which documents count as near copies.
SHINGLE, PERCENT = 5, 80
#: Rows of an Arrow batch.
BATCH_ROWS = 1000


def language_identification(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the model rejects: without letters, or like none of the languages it learned."""
    found = language_id.classify(docs, language_id.train(docs))
    return found.where("not rejected").select(*[F.col(f"`{c}`") for c in docs.columns])


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts later copies of repeated runs of lines; drops documents that lose all their words by it."""
    found = line_dedup.deduplicate_lines(docs)
    lost = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"\S")
    return found.where(~F.coalesce(lost, F.lit(False))).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return minhash_dedup.deduplicate(docs, SHINGLE, PERCENT)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages; drops documents of which they are more than half."""
    return decontaminate.remove_contamination(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of different segmentations of each document, checked by decoding them."""
    return sentencepiece_sampling.sample_documents(docs, tokenizer_path("piece_bpe_32k.model"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_identification", language_identification),
    ("line_deduplication", line_deduplication),
    ("near_deduplication", near_deduplication),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece_encoding", sentencepiece_encoding),
]

#: Language identification and sampling cannot be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet and read again.

    Whole texts go to Python workers, so the session's Arrow batches are set to at most ``BATCH_ROWS`` rows: both
    sides of each worker hold a batch or two.
    """
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(batch)) <= BATCH_ROWS:
        spark.conf.set(batch, BATCH_ROWS)
    docs, last = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        new: list[str] = []
        docs = materialise(stage(spark, docs, sf_dir), new)
        discard(spark, last)  # the stage before is no longer read
        last = new
    return STAGES[-1][1](spark, docs, sf_dir)
