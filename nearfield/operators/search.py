"""Exact and restricted top-k search of a corpus for a set of queries.

The query set is broadcast in blocks of a bounded size; every corpus partition keeps the best k rows of each
query as it streams through, and one window over those partial results gives the answer. The corpus itself is
never shuffled. Rows meet queries in tiles of a bounded size, so what a task holds follows from the block and k,
not from the number of queries or rows. Ties go to the lower id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield.functions.vectors import block_scores, check_metric, score, sequential_score

#: Queries are broadcast in blocks of at most so many bytes, and a task's running result for a block has as many at most.
QUERY_BLOCK_BYTES = 8 << 20
#: A tile has at most so many queries and rows: its scores are one matrix product of 8 MB.
TILE_QUERIES, TILE_ROWS = 512, 2048
#: So many rows are scored exactly at a time.
EXACT_ROWS = 1 << 15
RESULT = "qid long, rank int, id long, score double"


def vectors_of(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as an (n, d) array of doubles."""
    n = len(column)
    if not n:
        return np.zeros((0, 0))
    flat = np.asarray(column.flatten(), np.float64)
    if column.null_count or len(flat) % n:
        raise ValueError("vectors must be present and of one length")
    return flat.reshape(n, -1)


@dataclass
class QueryBlock:
    qids: np.ndarray
    vectors: np.ndarray
    extra: dict = field(default_factory=dict)


def query_blocks(queries: DataFrame, k: int = 0, most_bytes: int = QUERY_BLOCK_BYTES) -> Iterator[QueryBlock]:
    """The queries (qid, embedding) in blocks that fit in a broadcast, and whose best k rows fit in a task."""
    rows = queries.select(F.col("qid").cast("long").alias("qid"), "embedding")
    count, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    n = max(1, -(-count * max(8 * width, 16 * k, 8) // most_bytes))
    for b in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == b)
        table = part.orderBy("qid").toArrow()
        if table.num_rows:
            yield QueryBlock(table["qid"].to_numpy(), vectors_of(table["embedding"].combine_chunks()))


class TopK:
    """The best k rows of each query so far: ids and scores (query, k), best first; free places score -inf."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)
        self.scores = np.full((queries, k), -np.inf)

    def floors(self, queries: np.ndarray | slice) -> np.ndarray:
        """The scores that rows must reach to enter; -inf where there is a free place."""
        return self.scores[queries, -1]

    def add(self, queries: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Rows of three equally long arrays; a query's rows need not stand together."""
        if not len(queries):
            return
        asked = np.unique(queries)
        q = np.concatenate([np.repeat(asked, self.k), queries])
        i, s = np.concatenate([self.ids[asked].ravel(), ids]), np.concatenate([self.scores[asked].ravel(), scores])
        by = np.lexsort((i, -s, q))
        q, i, s = q[by], i[by], s[by]
        first = np.searchsorted(q, asked)
        at = (first[:, None] + np.arange(self.k)).ravel()
        self.ids[asked], self.scores[asked] = i[at].reshape(-1, self.k), s[at].reshape(-1, self.k)

    def batch(self, qids: np.ndarray) -> pa.RecordBatch:
        full = self.scores > -np.inf
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, full.sum(1))), pa.array(self.ids[full]), pa.array(self.scores[full])], names=["qid", "id", "score"])


def tiles(queries: int, rows: int) -> Iterator[tuple[slice, slice]]:
    """Pairs of ranges of so many queries and rows, each of a bounded size."""
    for r in range(0, rows, TILE_ROWS):
        for q in range(0, queries, TILE_QUERIES):
            yield slice(q, q + TILE_QUERIES), slice(r, r + TILE_ROWS)


def at_least(scores: np.ndarray, floors: np.ndarray, k: int, slack: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Query and row of the entries of (query, row) that may be among a query's best k, given what it has already."""
    if scores.shape[1] > k and (floors == -np.inf).any():
        floors = np.maximum(floors, np.partition(scores, -k, axis=1)[:, -k])
    return np.nonzero(scores >= (floors - slack)[:, None])


def exact_scores(queries: np.ndarray, at: np.ndarray, rows: np.ndarray, to: np.ndarray, metric: str) -> np.ndarray:
    """``sequential_score`` of the pairs of places (at, to), a bounded number at a time."""
    parts = [sequential_score(queries[at[i : i + EXACT_ROWS]], rows[to[i : i + EXACT_ROWS]], metric) for i in range(0, len(at), EXACT_ROWS)]
    return np.concatenate([np.zeros(0), *parts])


def best_rows(scored: DataFrame, k: int, pad: bool = False, queries: DataFrame | None = None) -> DataFrame:
    """Ranks 1..k of (qid, id, score). With ``pad``, short results end in id -1 and a null score."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("id"))
    top = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "rank", "id", "score")
    if not pad:
        return top
    slots = queries.select(F.col("qid").cast("long").alias("qid")).distinct().select("qid", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
    return slots.join(top, ["qid", "rank"], "left").select("qid", "rank", F.coalesce("id", F.lit(-1).cast("long")).alias("id"), "score")


Batches = Iterator[pa.RecordBatch]


def scan(corpus: DataFrame, columns: list[str], block: QueryBlock, k: int, score_rows: Callable[[QueryBlock, pa.RecordBatch, TopK], None], cut: Callable[[Batches], Batches] | None = None) -> DataFrame:
    """Best k rows of each query and partition; ``score_rows`` scores one batch (``cut`` may cut them anew) into the running result."""
    shared = corpus.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        top = TopK(len(q.qids), k)
        for batch in cut(batches) if cut else batches:
            if batch.num_rows:
                score_rows(q, batch, top)
        yield top.batch(q.qids)

    return corpus.select(*columns).mapInArrow(run, "qid long, id long, score double")


def whole(batches: Batches, keys: list[str]) -> Batches:
    """The rows in batches that hold all of one key each; rows with equal ``keys`` (whole numbers) stand together."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        each = np.stack([batch[k].to_numpy() for k in keys], 1)
        ends = [*(np.flatnonzero((each[1:] != each[:-1]).any(1)) + 1).tolist(), len(each)]
        for a, b in zip([0, *ends], ends, strict=False):
            key = tuple(each[a].tolist())
            if held and key != last:
                yield _one(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield _one(held)


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def exact_rows(metric: str) -> Callable[[QueryBlock, pa.RecordBatch, TopK], None]:
    """Scores all queries against full vectors; what may reach the result is scored again exactly."""

    def score_rows(q: QueryBlock, batch: pa.RecordBatch, top: TopK) -> None:
        rows = vectors_of(batch["embedding"])
        keep(q, np.arange(len(q.qids)), batch["id"].to_numpy(), rows, np.arange(len(rows)), top, metric)

    return score_rows


def keep(q: QueryBlock, asking: np.ndarray, ids: np.ndarray, rows: np.ndarray, at: np.ndarray, top: TopK, metric: str, may: np.ndarray | None = None) -> None:
    """Takes the rows ``at`` these places into the result of the queries ``asking``; of them, only those that ``may`` (query, row)."""
    for qs, rs in tiles(len(asking), len(at)):
        some, part = asking[qs], at[rs]
        x, y = q.vectors[some], rows[part]
        # A matrix product and the sum from left to right differ by no more than this.
        slack = 4e-16 * (x.shape[1] + 8) * (np.sqrt((x * x).sum(1)) + np.sqrt((y * y).sum(1).max())) ** 2
        scores = block_scores(x, y, metric)
        if may is not None:
            scores[~may[qs, rs]] = -np.inf
        i, j = at_least(scores, top.floors(some), top.k, slack)
        if may is not None:
            i, j = i[ok := may[qs, rs][i, j]], j[ok]
        top.add(some[i], ids[part[j]], exact_scores(x, i, y, j, metric))


def probed_rows(metric: str) -> Callable[[QueryBlock, pa.RecordBatch, TopK], None]:
    """As ``exact_rows``, but a query sees only rows of its probed lists (``extra['probes']``: query, list)."""

    def score_rows(q: QueryBlock, batch: pa.RecordBatch, top: TopK) -> None:
        ids, rows, lists = batch["id"].to_numpy(), vectors_of(batch["embedding"]), batch["list_id"].to_numpy()
        for cell in np.unique(lists):
            keep(q, np.flatnonzero((q.extra["probes"] == cell).any(1)), ids, rows, np.flatnonzero(lists == cell), top, metric)

    return score_rows


def union(parts: list[DataFrame], empty: DataFrame) -> DataFrame:
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return empty if out is None else out


def exact_topk(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "ip", pad: bool = False) -> DataFrame:
    """qid, rank, id and score of the k best rows of ``corpus`` (id, embedding) for each query (qid, embedding).

    An empty corpus or query set gives no rows (or padding). Vectors must be present and of one length.
    """
    check_metric(metric)
    if k < 1:
        raise ValueError("k must be positive")
    spark = corpus.sparkSession
    rows = corpus.select(F.col("id").cast("long").alias("id"), "embedding")
    parts = [scan(rows, ["id", "embedding"], b, k, exact_rows(metric)) for b in query_blocks(queries, k)]
    scored = union(parts, spark.createDataFrame([], "qid long, id long, score double"))
    return best_rows(scored, k, pad, queries)


def rescore(candidates: DataFrame, queries: DataFrame, corpus: DataFrame, k: int, metric: str = "ip") -> DataFrame:
    """Full-vector scores of candidates (qid, id), best k. The candidates are few: k or so for each query."""
    q = queries.select(F.col("qid").cast("long").alias("qid"), F.col("embedding").alias("q"))
    rows = candidates.select("qid", "id").join(corpus.select(F.col("id").cast("long").alias("id"), F.col("embedding").alias("x")), "id").join(q, "qid")
    return best_rows(rows.select("qid", "id", score("q", "x", metric).alias("score")), k)
