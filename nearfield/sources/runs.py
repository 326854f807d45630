"""Run documents: one JSON document for each benchmark run; checks, tables and reports of them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "run_id string, language string, index string, n long, dim int, k int, seed long, build_params map<string,string>, "
    "build_s double, peak_rss_mb double, index_bytes long, "
    "searches array<struct<search_params:map<string,string>,ids:array<array<long>>,scores:array<array<double>>,"
    "latency_ms:array<double>,qps:double,distance_computations:double,extra:map<string,string>>>"
)
_REQUIRED = ["run_id", "language", "index", "n", "dim", "k", "searches"]


def write_runs(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").json(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


def document(**fields) -> str:
    """One run as JSON."""
    return json.dumps(fields, sort_keys=True)


def problems(runs: DataFrame) -> DataFrame:
    """run_id and problem: what is missing or does not fit together; no rows if all is well."""
    found = [F.when(F.col(c).isNull(), F.lit(f"{c} is missing")) for c in _REQUIRED]
    found.append(F.when(F.exists("searches", lambda s: F.size(s["ids"]) != F.size(s["latency_ms"])), F.lit("a search has not one latency for each query")))
    found.append(F.when(F.exists("searches", lambda s: F.exists(s["ids"], lambda x: F.size(x) != F.col("k"))), F.lit("an id list has not k entries")))
    found.append(F.when(F.exists("searches", lambda s: F.exists(s["latency_ms"], lambda x: x < 0)), F.lit("a latency is negative")))
    listed = F.filter(F.array(*found), lambda x: x.isNotNull())
    return runs.select("run_id", F.explode(listed).alias("problem"))


#: Names under which runs of a mode keep figures, in ``extra`` or, for the last ones, among the search parameters.
MODE_FIGURES = ("clients", "cpu_pct", "errors", "insert_rate", "inserted_rows", "delete_s", "update_s", "compact_s", "hit_rate", "p50_hit_ms", "p50_miss_ms")
MODE_SETTINGS = ("phase", "deleted", "updated", "compacted", "backend", "capacity", "workload", "invalidate_at")


def mode_columns(runs: DataFrame) -> DataFrame:
    """run_id, setting (number of the search) and the figures and settings of load, change and cache runs; null where absent."""
    per = runs.select("run_id", F.posexplode("searches").alias("setting", "s"))
    figures = [F.try_element_at("s.extra", F.lit(c)).cast("double").alias(c) for c in MODE_FIGURES]
    return per.select("run_id", "setting", *figures, *[F.try_element_at("s.search_params", F.lit(c)).alias(c) for c in MODE_SETTINGS])


def results_table(summary: DataFrame) -> DataFrame:
    """Summaries in report order: index, then best recall, then least latency."""
    return summary.orderBy(F.asc("index"), F.desc("recall"), F.asc("p50_ms"))


def write_csv(summary: DataFrame, path: str) -> None:
    flat = summary.withColumns({c: F.to_json(c) for c, t in summary.dtypes if t.startswith(("map", "struct", "array"))})
    results_table(flat).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def markdown(summary: DataFrame, columns: list[str], most: int = 100_000) -> str:
    """A report table. Reports have a row for each run; more than ``most`` are an error."""
    rows = results_table(summary).select(*columns).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report table has at most {most} rows")
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(_shown(x) for x in r) + " |" for r in rows])


def _shown(x: object) -> str:
    if x is None:
        return ""
    if isinstance(x, dict):
        return ", ".join(f"{k}={x[k]}" for k in sorted(x))
    return f"{x:.4f}" if isinstance(x, float) else str(x)
