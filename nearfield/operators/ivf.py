"""Inverted file: rows belong to the list of their best centre; a query scans its nprobe best lists.

The centres are few and live on the driver. A query's lists are picked before any filter, so a filter never
changes them. Rows keep their list as a column: a stored index is partitioned by it, and only probed lists are
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions.vectors import block_scores
from nearfield.operators.base import Index, filtered, upserted
from nearfield.operators.kmeans import assign, kmeans
from nearfield.operators.search import best_rows, probed_rows, query_blocks, scan, union, vectors_of
from nearfield.sources.scratch import written


def with_list(rows: DataFrame, centers: np.ndarray) -> DataFrame:
    """``rows`` with list_id, the best centre of their embedding; other columns are kept."""
    kept = rows.drop("list_id")
    shared = rows.sparkSession.sparkContext.broadcast(centers)
    packed = kept.select(F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("row"), "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = assign(vectors_of(batch["embedding"]), shared.value)[0] if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(labels, pa.int32())], names=["row", "list_id"])

    schema = packed.select("row", F.lit(0).cast("int").alias("list_id")).schema
    return packed.mapInArrow(run, schema).select("row.*", "list_id")


def probes(vectors: np.ndarray, centers: np.ndarray, nprobe: int) -> np.ndarray:
    """The nprobe best centres of each query, the lower first on ties."""
    nprobe = max(1, min(nprobe, len(centers)))
    scores = block_scores(vectors, centers)
    return np.argsort(-scores, axis=1, kind="stable")[:, :nprobe]


class IvfIndex(Index):
    name = "ivf"
    build_defaults = {"nlist": 1024, "train_size": None, "iters": 20}
    search_defaults = {"nprobe": 8}

    def _build(self, corpus: DataFrame) -> None:
        p = self.params
        self.centers = kmeans(corpus, p["nlist"], p["iters"], self.seed, p["train_size"])
        self.rows = written(with_list(corpus, self.centers))

    def _probed(self, queries: DataFrame, nprobe: int, k: int = 0):
        for block in query_blocks(queries, k):
            block.extra["probes"] = probes(block.vectors, self.centers, nprobe)
            yield block, sorted({int(x) for x in block.extra["probes"].ravel()})

    def _search(self, queries: DataFrame, k: int, where: Column | None, params: dict) -> DataFrame:
        parts = []
        for block, lists in self._probed(queries, params["nprobe"], k):
            rows = self.live(self.rows.where(F.col("list_id").isin(lists)) if len(lists) < len(self.centers) else self.rows)
            parts.append(scan(filtered(rows, where), ["id", "embedding", "list_id"], block, k, probed_rows("ip")))
        return best_rows(union(parts, self.spark.createDataFrame([], "qid long, id long, score double")), k)

    def distance_computations(self, queries: DataFrame, nprobe: int = 8) -> DataFrame:
        """qid and n: centres plus live rows of the probed lists."""
        sizes = self.live(self.rows).groupBy("list_id").count()
        parts = []
        for block, _ in self._probed(queries, nprobe):
            pairs = [(int(q), int(c)) for q, row in zip(block.qids, block.extra["probes"], strict=True) for c in row]
            parts.append(self.spark.createDataFrame(pairs, "qid long, list_id int"))
        asked = union(parts, self.spark.createDataFrame([], "qid long, list_id int"))
        return asked.join(sizes, "list_id", "left").groupBy("qid").agg((F.lit(len(self.centers)) + F.coalesce(F.sum("count"), F.lit(0))).alias("n"))

    def list_sizes(self) -> DataFrame:
        lists = self.spark.range(len(self.centers)).select(F.col("id").cast("int").alias("list_id"))
        return lists.join(self.live(self.rows).groupBy("list_id").count(), "list_id", "left").select("list_id", F.coalesce("count", F.lit(0)).alias("n"))

    def _update(self, rows: DataFrame) -> None:
        # Centres are not trained again; changed rows move to the list of their new best centre.
        changed = upserted(self.rows.join(rows.select("id"), "id", "left_semi"), rows)
        self.rows = self.rows.join(rows.select("id"), "id", "left_anti").unionByName(written(with_list(changed, self.centers)))

    def _insert(self, rows: DataFrame) -> None:
        self.rows = self.rows.unionByName(written(with_list(rows, self.centers)))

    def _compact(self, mode: str) -> None:
        self.rows, self.deleted = self.live(self.rows), None

    def stats(self) -> DataFrame:
        low, high, n = self.list_sizes().agg(F.min("n"), F.max("n"), F.sum("n")).first()
        return self._figures(rows=n, lists=len(self.centers), smallest_list=low, largest_list=high, index_bytes=self.centers.size * 4 + n * 4 + (len(self.centers) + 1) * 4)
