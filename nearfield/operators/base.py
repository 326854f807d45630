"""What all indexes share: parameters, filters, tombstones, updates."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def resolve(defaults: dict, given: dict) -> dict:
    """Defaults overridden by what is given; unknown names are an error."""
    unknown = sorted(set(given) - set(defaults))
    if unknown:
        raise ValueError(f"unknown parameters: {', '.join(unknown)}; known: {', '.join(sorted(defaults))}")
    return defaults | given


class Index(ABC):
    """An index over a corpus (id, embedding and any attributes). Ids are explicit and never change."""

    name: str
    build_defaults: dict = {}
    search_defaults: dict = {}
    filters = deletes = True

    def __init__(self, spark: SparkSession, params: dict, seed: int):
        self.spark, self.params, self.seed = spark, params, seed
        self.deleted: DataFrame | None = None

    @classmethod
    def build(cls, corpus: DataFrame, seed: int = 42, **params) -> Index:
        index = cls(corpus.sparkSession, resolve(cls.build_defaults, params), seed)
        index._build(corpus.withColumn("id", F.col("id").cast("long")))
        return index

    @abstractmethod
    def _build(self, corpus: DataFrame) -> None: ...

    @abstractmethod
    def _search(self, queries: DataFrame, k: int, where: Column | None, params: dict) -> DataFrame: ...

    def search(self, queries: DataFrame, k: int = 10, where: Column | None = None, **params) -> DataFrame:
        """qid, rank, id and score of the best k live rows that pass ``where`` (a predicate on attributes)."""
        if where is not None and not self.filters:
            raise ValueError(f"{self.name} has no filtered search")
        return self._search(queries, k, where, resolve(self.search_defaults, params))

    def delete(self, ids: DataFrame) -> None:
        """Mark ids (a frame with id) as deleted; a second call adds to the first."""
        self._changeable()
        ids = ids.select(F.col("id").cast("long").alias("id"))
        self.deleted = (ids if self.deleted is None else self.deleted.union(ids)).distinct()

    def update(self, rows: DataFrame) -> None:
        """Replace the vectors of existing ids (id, embedding)."""
        self._changeable()
        self._update(rows.select(F.col("id").cast("long").alias("id"), "embedding"))

    def insert(self, rows: DataFrame) -> None:
        """Add rows with new ids (id, embedding and the corpus's attributes) to the built index; searches see them at once.

        Nothing is trained again. Ids that the index has already, deleted ones included, are an error.
        """
        rows = rows.withColumn("id", F.col("id").cast("long")).select(*[F.col(f"`{c}`") for c in self.columns])
        if rows.join(self.rows.select("id"), "id", "left_semi").limit(1).count():
            raise ValueError("an inserted id is in the index already")
        self._insert(rows)

    @property
    def columns(self) -> list[str]:
        return [c for c in self.rows.columns if c != "list_id"]

    def _insert(self, rows: DataFrame) -> None:
        raise ValueError(f"{self.name} takes no inserts")

    def compact(self, mode: str = "rebuild") -> None:
        """Drop deleted rows for good; ids stay."""
        self._changeable()
        self._compact(mode)

    def _changeable(self) -> None:
        if not self.deletes:
            raise ValueError(f"{self.name} has no deletes, updates or compaction")

    def _update(self, rows: DataFrame) -> None:
        raise NotImplementedError

    def _compact(self, mode: str) -> None:
        raise NotImplementedError

    def live(self, rows: DataFrame) -> DataFrame:
        return rows if self.deleted is None else rows.join(self.deleted, "id", "left_anti")

    @abstractmethod
    def stats(self) -> DataFrame:
        """name and value of size figures."""

    def _figures(self, **values) -> DataFrame:
        rows = [(k, float(v)) for k, v in values.items() if v is not None]
        return self.spark.createDataFrame(rows, "name string, value double")


def upserted(rows: DataFrame, new: DataFrame) -> DataFrame:
    """``rows`` with the embeddings of ``new`` (id, embedding) where it has the id; unknown ids are left out."""
    other = new.select("id", F.col("embedding").alias("_new"))
    return rows.join(other, "id", "left").withColumn("embedding", F.coalesce("_new", "embedding")).drop("_new")


def filtered(rows: DataFrame, where: Column | None) -> DataFrame:
    return rows if where is None else rows.where(where)
