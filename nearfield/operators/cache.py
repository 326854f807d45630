"""An embedding cache as queries: least-recently-used hits, rates, invalidation, request workloads."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield.sources.scratch import discard, written


class Lru:
    """Keys by last use; adding beyond the capacity drops the one used longest ago."""

    def __init__(self, capacity: int, keys: list[str] | None = None):
        self.capacity, self.keys = capacity, OrderedDict.fromkeys(keys or [])

    def ask(self, key: str) -> bool:
        hit = key in self.keys
        if hit:
            self.keys.move_to_end(key)
        elif self.capacity > 0:
            self.keys[key] = None
            if len(self.keys) > self.capacity:
                self.keys.popitem(last=False)
        return hit


#: Ids of one chunk, which a task serves at a time and holds as Python strings.
CHUNK = 1 << 17


def lru_hits(requests: DataFrame, capacity: int, chunk: int | None = None) -> DataFrame:
    """request_id, key and hit of each request (request_id, key), served in request order by one cache.

    Requests are served in chunks of ids side by side. Each chunk starts with what the cache then holds: the
    ``capacity`` keys used last before it. These come from a prefix scan over the chunks' own last uses, in
    log2(chunks) rounds of merging the lists of a chunk and of the one a power of two before it.
    """
    chunk = chunk or CHUNK
    rows = requests.select(F.col("request_id").cast("long").alias("request_id"), F.col("key").cast("string").alias("key"))
    rows = rows.withColumn("chunk", F.floor(F.col("request_id") / chunk).cast("long"))
    low, high = rows.agg(F.min("chunk"), F.max("chunk")).first()
    used = rows.groupBy("chunk", "key").agg(F.max("request_id").alias("last"))
    held, span, paths = _latest(used.withColumn("chunk", F.col("chunk") + 1), capacity), 1, []
    if low is not None and low < high:
        held = written(held, paths)
    while low is not None and span < high - low:
        old = list(paths)
        paths.clear()
        held = written(_latest(held.union(held.withColumn("chunk", F.col("chunk") + span)), capacity), paths)
        discard(requests.sparkSession, old)
        span *= 2
    # Attributes of its own: a column that both sides have in common is pruned from one of them where an aggregate follows.
    held = held.select(F.col("chunk").alias("held_chunk"), F.col("key").alias("held_key"), F.col("last").alias("held_last"))

    def serve(asked: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        cache = Lru(capacity, start.sort_values("held_last")["held_key"].tolist())
        asked = asked.sort_values("request_id")
        return pd.DataFrame({"request_id": asked["request_id"], "key": asked["key"], "hit": [cache.ask(k) for k in asked["key"]]})

    return rows.groupBy("chunk").cogroup(held.groupBy("held_chunk")).applyInPandas(serve, "request_id long, key string, hit boolean")


def _latest(used: DataFrame, capacity: int) -> DataFrame:
    """chunk, key and last of the keys used last, at most ``capacity`` for each chunk."""
    used = used.groupBy("chunk", "key").agg(F.max("last").alias("last"))
    order = F.row_number().over(Window.partitionBy("chunk").orderBy(F.desc("last")))
    return used.withColumn("r", order).where(F.col("r") <= capacity).select("chunk", "key", "last")


def hit_rate(hits: DataFrame) -> DataFrame:
    return hits.agg(F.count("*").alias("requests"), F.count_if("hit").alias("hits"), F.avg(F.col("hit").cast("double")).alias("hit_rate"))


def invalidated(requests: DataFrame, first: int) -> DataFrame:
    """From request ``first`` on keys have a new version, so no old entry is found."""
    version = F.when(F.col("request_id") >= first, F.lit("-2")).otherwise(F.lit(""))
    return requests.withColumn("key", F.concat(F.col("key").cast("string"), version))


def phases(hits: DataFrame, first: int) -> DataFrame:
    """Hit rates before and after an invalidation."""
    phase = F.when(F.col("request_id") < first, "before").otherwise("after").alias("phase")
    return hits.groupBy(phase).agg(F.count("*").alias("requests"), F.avg(F.col("hit").cast("double")).alias("hit_rate"))


#: A pool of texts is drawn from by its cumulative shares, which are broadcast; a larger pool is an error.
POOL = 4_000_000


def popularity(pool: DataFrame, exponent: float = 1.1, uniform: bool = False) -> DataFrame:
    """``pool`` (pool_id from 0, of at most ``POOL`` rows) with low and high: its share of the unit interval, by Zipf's law or evenly."""
    weight = F.lit(1.0) if uniform else F.pow(F.col("pool_id") + 1.0, F.lit(-exponent))
    order = Window.orderBy("pool_id")
    w = pool.withColumn("w", weight)
    n, total = w.agg(F.count("*"), F.sum("w")).first()
    if n > POOL:
        raise ValueError(f"a pool has at most {POOL} rows, not {n}")
    # The pool is the fixed list of texts of a workload, not the requests, so one ordered pass over it is enough.
    return w.withColumn("high", F.sum("w").over(order) / (total or 1.0)).withColumn("low", F.col("high") - F.col("w") / (total or 1.0)).drop("w")


def workload(pool: DataFrame, requests: int, exponent: float = 1.1, uniform: bool = False, seed: int = 0) -> DataFrame:
    """request_id and pool_id: requests drawn by popularity, with a hash of the request id as the draw.

    Each draw is looked up in the sorted shares by bisection.
    """
    spark = pool.sparkSession
    table = popularity(pool, exponent, uniform).select("pool_id", "high").orderBy("pool_id").toArrow()
    shared = spark.sparkContext.broadcast((table["pool_id"].to_numpy(), table["high"].to_numpy()))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, high = shared.value
        for batch in batches:
            at = np.searchsorted(high, batch["u"].to_numpy(), "right")
            inside = at < len(ids)
            yield pa.RecordBatch.from_arrays([batch["request_id"].filter(pa.array(inside)), pa.array(ids[at[inside]], pa.int64())], names=["request_id", "pool_id"])

    u = ((F.col("request_id") + seed) * 7919 + 104729) % 1_000_003 / 1_000_003.0
    draws = spark.range(requests).select(F.col("id").alias("request_id")).withColumn("u", u)
    return draws.mapInArrow(draw, "request_id long, pool_id long")


def replay(requests: DataFrame, capacity: int | None, hit_ms: Column, miss_ms: Column) -> DataFrame:
    """Each request's hit and cost; without a capacity nothing is ever cached."""
    hits = lru_hits(requests, capacity) if capacity else requests.withColumn("hit", F.lit(False))
    return hits.withColumn("ms", F.when(F.col("hit"), hit_ms).otherwise(miss_ms))
