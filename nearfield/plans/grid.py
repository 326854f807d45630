"""Benchmark cases: every combination of indexes, build parameters, search settings and modes that makes sense."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession

FILTERED = ("flat", "ivf", "hnsw")
CHANGED = ("flat", "ivf", "hnsw")


def combinations(values: dict[str, list]) -> list[dict]:
    """All choices of one value for each name."""
    return [dict(zip(values, choice, strict=True)) for choice in product(*values.values())]


def cases(grid: dict[str, dict[str, dict[str, list]]]) -> list[tuple[str, dict, dict]]:
    """(index, build parameters, search parameters) of a grid {index: {build: ..., search: ...}}."""
    return [(index, b, s) for index, g in grid.items() for b in combinations(g.get("build", {})) for s in combinations(g.get("search", {}))]


def check_flags(index: str, *, filter: str | None = None, delete: str | None = None, update: str | None = None, compact: bool = False, load: bool = False) -> None:
    """Combinations that have no meaning are an error."""
    if filter not in (None, "none") and index not in FILTERED:
        raise ValueError(f"{index} has no filtered search")
    if delete and update:
        raise ValueError("delete and update are not combined")
    if (delete or update or compact) and index not in CHANGED:
        raise ValueError(f"{index} has no deletes, updates or compaction")
    if compact and not (delete or update):
        raise ValueError("compact follows a delete or an update")
    if load and (delete or update):
        raise ValueError("a load run has no deletes or updates")


def case_table(spark: SparkSession, grid: dict) -> DataFrame:
    rows = [(i, index, {k: str(v) for k, v in b.items()}, {k: str(v) for k, v in s.items()}) for i, (index, b, s) in enumerate(cases(grid))]
    return spark.createDataFrame(rows, "case_id long, index string, build_params map<string,string>, search_params map<string,string>")


def _value(text: str) -> object:
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


def parameters(pairs: list[str], known: dict) -> dict:
    """``known`` overridden by KEY=VALUE texts, of which one may hold several with commas between."""
    out = dict(known)
    for pair in (p for text in pairs for p in text.split(",") if p):
        key, _, value = pair.partition("=")
        if not value:
            raise ValueError(f"{pair!r} is not KEY=VALUE")
        if key not in known:
            raise ValueError(f"unknown parameter {key!r}; known: {', '.join(sorted(known))}")
        out[key] = _value(value)
    return out


# The runs of each mode.
LOAD_CLIENTS, LOAD_INSERT = (1, 4, 16), (4, 100)
CHANGES = ("del10", "del30", "del50"), ("upd10",)
CACHE_CAPACITIES, CACHE_UNIFORM, CACHE_INVALIDATED_AT = (500, 2000, 5000), 2000, 25_000
MODES = "mode string, index string, clients int, insert_rate int, deleted string, updated string, compacted boolean, backend string, capacity int, workload string, invalidate_at int"


def mode_table(spark: SparkSession, indexes: list[str], backends: list[str], requests: int = 50_000) -> DataFrame:
    """Cases beside plain searches: load (closed loop, and one run with inserts), change, cache and backup."""
    none = dict.fromkeys(c.split()[0] for c in MODES.split(", "))
    cases = []
    for index in indexes:
        for clients, rate in [*((c, 0) for c in LOAD_CLIENTS), LOAD_INSERT]:
            cases.append(none | {"mode": "load", "index": index, "clients": clients, "insert_rate": rate})
        if index in CHANGED:
            cases += [none | {"mode": "change", "index": index, "deleted": d, "compacted": c} for d in CHANGES[0] for c in (False, True)]
            cases += [none | {"mode": "change", "index": index, "updated": u, "compacted": False} for u in CHANGES[1]]
            cases.append(none | {"mode": "backup", "index": index})
    for backend in backends:
        runs = [(c, "zipf") for c in ((0,) if backend == "none" else CACHE_CAPACITIES)] + [(0 if backend == "none" else CACHE_UNIFORM, "uniform")]
        cases += [none | {"mode": "cache", "backend": backend, "capacity": c, "workload": w} for c, w in runs]
    if "lru" in backends and CACHE_INVALIDATED_AT < requests:
        cases.append(none | {"mode": "cache", "backend": "lru", "capacity": CACHE_UNIFORM, "workload": "zipf", "invalidate_at": CACHE_INVALIDATED_AT})
    return spark.createDataFrame([tuple(c.values()) for c in cases], MODES)
