"""Recall, latency and run summaries as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def recall_at_k(results: DataFrame, truth: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """qid and recall: how many of the first k results are among the first k of the truth, divided by k.

    Padding never counts. k divides even where the truth has fewer rows. ``by`` names further key columns.
    """
    keys = [*(by or []), "qid"]
    got = results.where((F.col("rank") <= k) & (F.col("id") >= 0)).select(*keys, "id").distinct()
    want = truth.where(F.col("rank") <= k).select(*keys, "id").distinct().withColumn("hit", F.lit(1))
    asked = results.select(*keys).union(truth.select(*keys)).distinct()
    hits = got.join(want, [*keys, "id"]).groupBy(*keys).agg(F.count("*").alias("n"))
    return asked.join(hits, keys, "left").select(*keys, (F.coalesce("n", F.lit(0)) / k).alias("recall"))


def mean_recall(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    return recall_at_k(results, truth, k).agg(F.avg("recall").alias("recall"))


def latency(rows: DataFrame, value: Column, by: list[str]) -> DataFrame:
    """Percentiles with linear interpolation, mean and rate of values in milliseconds."""
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))
    got = rows.groupBy(*by).agg(p.alias("p"), F.avg(value).alias("mean_ms"), (1000 * F.count(value) / F.sum(value)).alias("qps"))
    return got.select(*by, F.col("p")[0].alias("p50_ms"), F.col("p")[1].alias("p90_ms"), F.col("p")[2].alias("p99_ms"), "mean_ms", "qps")


def mean_if_whole(value: Column) -> Column:
    """The mean of a counter, null where any row lacks it."""
    return F.when(F.count(value) == F.count("*"), F.avg(value))


def deleted_returned(results: DataFrame, deleted: DataFrame) -> DataFrame:
    """How many returned ids are deleted ones."""
    return results.join(deleted.select("id").distinct(), "id", "left_semi").agg(F.count("*").alias("deleted_returned"))


def compared(before: DataFrame, after: DataFrame) -> DataFrame:
    """Whether two results are the same: all_equal, share of queries with equal id lists, mean overlap."""
    listed = [r.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "id")))["id"].alias(n)) for r, n in ((before, "a"), (after, "b"))]
    both = listed[0].join(listed[1], "qid", "full")
    none = F.array().cast("array<long>")
    a, b = F.coalesce("a", none), F.coalesce("b", none)
    overlap = F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b))
    return both.agg(F.bool_and(a == b).alias("all_equal"), F.avg((a == b).cast("double")).alias("equal_share"), F.avg(overlap).alias("mean_overlap"))


def truth_key(search_params: Column) -> Column:
    """Which truth a run is held against: that of its deletes, else of its update, else of its filter.

    Deletes together with an update or a filter are an error.
    """
    deleted, updated = F.try_element_at(search_params, F.lit("deleted")), F.try_element_at(search_params, F.lit("updated"))
    kept = F.coalesce(F.try_element_at(search_params, F.lit("filter")), F.lit("none"))
    several = (deleted.isNotNull().cast("int") + updated.isNotNull().cast("int") + (kept != "none").cast("int")) > 1
    return F.when(several, F.raise_error(F.lit("a run has one of deleted, updated and filter"))).otherwise(F.coalesce(deleted, updated, kept))


def run_summary(runs: DataFrame, truths: DataFrame, k: int = 10) -> DataFrame:
    """One row for each search setting of run documents (as read by ``sources.runs``).

    ``truths``: truth (name), qid (position of the query), rank, id.
    """
    per = runs.select("run_id", "language", "index", "n", "build_params", "build_s", "peak_rss_mb", "index_bytes", F.posexplode("searches").alias("setting", "s"))
    per = per.withColumn("truth", truth_key(F.col("s.search_params")))
    key = ["run_id", "setting"]
    ids = per.select(*key, "truth", F.posexplode("s.ids").alias("qid", "l")).select(*key, "truth", "qid", F.posexplode("l").alias("r", "id"))
    got = ids.where(F.col("r") < k).select(*key, "truth", "qid", "id")
    hits = got.join(truths.where(F.col("rank") <= k).select("truth", "qid", "id"), ["truth", "qid", "id"]).groupBy(*key).agg(F.count("*").alias("hits"))
    asked = per.select(*key, F.size("s.ids").alias("queries"))
    recall = asked.join(hits, key, "left").select(*key, (F.coalesce("hits", F.lit(0)) / (F.col("queries") * k)).alias("recall"))
    times = latency(per.select(*key, F.explode("s.latency_ms").alias("ms")), F.col("ms"), key).drop("qps")
    flat = per.select(*key, "language", "index", "n", "build_params", F.col("s.search_params").alias("search_params"), "truth", F.col("s.qps").alias("qps"), "build_s", "peak_rss_mb", "index_bytes", F.col("s.distance_computations").alias("distance_computations"))
    return flat.join(recall, key).join(times, key)


def median_run(repeats: DataFrame, case: list[str], value: str = "p50_ms") -> DataFrame:
    """Of the repeats of each case the one in the middle by mean value, with the spread of all."""
    means = repeats.groupBy(*case, "repeat").agg(F.avg(value).alias("mean"))
    order = Window.partitionBy(*case).orderBy("mean", "repeat")
    whole = Window.partitionBy(*case)
    n = F.count("*").over(whole)
    ranked = means.select(*case, "repeat", "mean", (F.row_number().over(order) - 1).alias("r"), n.alias("n"), F.min("mean").over(whole).alias("low"), F.max("mean").over(whole).alias("high"))
    return ranked.where(F.col("r") == F.floor(F.col("n") / 2)).select(*case, "repeat", "mean", "low", "high")


def median_by(rows: DataFrame, line: list[str], x: str, values: list[str]) -> DataFrame:
    """Medians for each line and x: the points of a plot."""
    return rows.groupBy(*line, x).agg(*[F.median(v).alias(v) for v in values])


def before_after(rows: DataFrame, case: list[str], values: list[str]) -> DataFrame:
    """One row a case with each value before and after (column stage) side by side."""
    sides = [F.max(F.when(F.col("stage") == s, F.col(v))).alias(f"{v}_{s}") for v in values for s in ("before", "after")]
    return rows.groupBy(*case).agg(*sides)


def cache_times(replayed: DataFrame) -> DataFrame:
    """Hit rate, and median times of hits and of misses, of (hit, ms)."""
    half = lambda hit: F.percentile(F.when(F.col("hit") == hit, F.col("ms")), 0.5)
    return replayed.agg(F.avg(F.col("hit").cast("double")).alias("hit_rate"), half(True).alias("p50_hit_ms"), half(False).alias("p50_miss_ms"))
