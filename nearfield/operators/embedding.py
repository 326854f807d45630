"""Embedders for texts. A model is not part of this package; any function from texts to vectors fits in."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions.random import SplitMix64
from nearfield.functions.vectors import dot

Embedder = Callable[[list[str]], np.ndarray]


def hashing_embedder(dim: int, seed: int = 42) -> Embedder:
    """Unit vectors of signed hashed words: no model, but equal texts get equal vectors and like texts like ones."""
    import zlib

    salt = SplitMix64(seed).next_u64() & 0xFFFFFFFF

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, text in enumerate(texts):
            for word in (text or "").lower().split():
                h = zlib.crc32(word.encode("utf-8", "replace"), salt)
                out[i, (h >> 1) % dim] += 1 if h & 1 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return embed


def embedded(texts: DataFrame, embedder: Embedder, column: str = "text", batch: int = 32) -> DataFrame:
    """``texts`` with embedding, made in batches."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        rows = s.tolist()
        return pd.Series([v for i in range(0, len(rows), batch) for v in embedder(rows[i : i + batch]).tolist()])

    return texts.withColumn("embedding", run(F.col(column).cast("string")))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean cosine of the unit vectors that two frames (id, embedding) have for the same ids."""
    both = a.select("id", F.col("embedding").alias("x")).join(b.select("id", F.col("embedding").alias("y")), "id")
    return both.agg(F.avg(dot("x", "y")).alias("mean_cosine"), F.count("*").alias("rows"))
