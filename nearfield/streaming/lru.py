"""A least-recently-used cache over a stream of requests, with its entries as state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from nearfield.operators.cache import Lru


def lru_stream(requests: DataFrame, capacity: int, caches: int = 1) -> DataFrame:
    """request_id, key and hit for a stream of (request_id, key).

    Requests of a micro-batch are served in id order. Several caches each serve the keys that hash to them, with
    an equal part of the capacity, so they run side by side; one cache is the plain one.
    """
    each = capacity // caches

    def serve(_: Any, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cache = Lru(each, list(state.get[0]) if state.exists else [])
        rows = pd.concat(list(batches)).sort_values("request_id")
        hits = [cache.ask(k) for k in rows["key"]]
        state.update((list(cache.keys),))
        yield pd.DataFrame({"request_id": rows["request_id"], "key": rows["key"], "hit": hits})

    keyed = requests.select(F.col("request_id").cast("long").alias("request_id"), F.col("key").cast("string").alias("key"))
    keyed = keyed.withColumn("cache", F.pmod(F.xxhash64("key"), F.lit(caches)))
    return keyed.groupBy("cache").applyInPandasWithState(serve, "request_id long, key string, hit boolean", "keys array<string>", "append", GroupStateTimeout.NoTimeout)
