"""Flat index: every live row that passes the filter is scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.operators.base import Index, filtered, upserted
from nearfield.operators.search import exact_topk


class FlatIndex(Index):
    name = "flat"
    search_defaults = {"metric": "ip", "pad": False}

    def _build(self, corpus: DataFrame) -> None:
        self.rows = corpus

    def _search(self, queries: DataFrame, k: int, where: Column | None, params: dict) -> DataFrame:
        return exact_topk(queries, filtered(self.live(self.rows), where), k, params["metric"], params["pad"])

    def _update(self, rows: DataFrame) -> None:
        self.rows = upserted(self.rows, rows)

    def _insert(self, rows: DataFrame) -> None:
        self.rows = self.rows.unionByName(rows)

    def _compact(self, mode: str) -> None:
        self.rows, self.deleted = self.live(self.rows), None

    def stats(self) -> DataFrame:
        n, width = self.live(self.rows).agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
        return self._figures(rows=n, distance_computations=n, live_bytes=n * width * 4)
