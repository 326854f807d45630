"""Scalar (int8) and binary (sign) quantisation with exact rescoring.

Codes are expressions; they are scored as full vectors are, partition by partition against blocks of queries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.operators.search import QueryBlock, TopK, at_least, best_rows, query_blocks, rescore, scan, tiles, union, vectors_of


def scalar_codes(rows: DataFrame, scale: float = 127.0) -> DataFrame:
    """id and code: components in -1..1 as whole numbers in -127..127."""
    code = F.transform("embedding", lambda x: F.floor(F.greatest(F.least(x.cast("double"), F.lit(1.0)), F.lit(-1.0)) * scale + 0.5).cast("int"))
    return rows.select("id", code.alias("code"))


def sign_codes(rows: DataFrame) -> DataFrame:
    """id and code: 1 for components of at least 0, else -1."""
    return rows.select("id", F.transform("embedding", lambda x: F.when(x >= 0, 1).otherwise(-1)).alias("code"))


def quantized_search(queries: DataFrame, corpus: DataFrame, k: int, kind: str = "scalar", oversample: int = 4) -> DataFrame:
    """Best k by the dot product of codes for the first k * oversample, then by full vectors."""
    if kind not in ("scalar", "binary"):
        raise ValueError("kind is scalar or binary")
    code = scalar_codes if kind == "scalar" else sign_codes
    asked = code(queries.select(F.col("qid").alias("id"), "embedding")).select(F.col("id").alias("qid"), F.col("code").alias("embedding"))
    coded, n = code(corpus), k * oversample

    def score_rows(q: QueryBlock, batch: pa.RecordBatch, top: TopK) -> None:
        # Sums of products of whole numbers are exact in doubles.
        ids, codes = batch["id"].to_numpy(), vectors_of(batch["code"])
        for qs, rs in tiles(len(q.qids), len(ids)):
            scores = q.vectors[qs] @ codes[rs].T
            i, j = at_least(scores, top.floors(qs), top.k)
            top.add(np.arange(len(q.qids))[qs][i], ids[rs][j], scores[i, j])

    parts = [scan(coded, ["id", "code"], b, n, score_rows) for b in query_blocks(asked, n)]
    rough = best_rows(union(parts, corpus.sparkSession.createDataFrame([], "qid long, id long, score double")), n)
    return rescore(rough, queries, corpus, k)
