"""Rows that arrive while an index serves searches.

Each micro-batch is appended to a table and becomes visible as a whole; a search sees a snapshot. Appends are
idempotent: a batch that is run again replaces its own folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def append_stream(stream: DataFrame, path: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None, rate: str | None = None) -> StreamingQuery:
    """Append batches of (id, embedding) under ``path``; ``prepare`` adds columns such as the list of a row.

    Without ``rate`` (a trigger interval) all that is there is taken in and the query ends.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = prepare(batch) if prepare else batch
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=rate) if rate else writer.trigger(availableNow=True)).start()


def snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows that have been appended so far."""
    return spark.read.schema(f"{schema}, batch int").parquet(path).drop("batch")


def partial(corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first nine tenths by id, to build from, and the rest, to insert."""
    n = corpus.count()
    first = n - n // 10
    if first >= n:
        return corpus, corpus.limit(0)
    last = corpus.select("id").orderBy("id").offset(first).limit(1).first()[0]
    return corpus.where(corpus["id"] < last), corpus.where(corpus["id"] >= last)
