import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from nearfield.operators import cache, changes, metrics
from nearfield.plans import grid
from nearfield.plans.queries import QUERIES, SQL
from nearfield.sources import npy, runs
from nearfield.streaming.inserts import append_stream, partial, snapshot
from nearfield.streaming.lru import lru_stream


def plain_lru(keys, capacity):
    held, hits = [], []
    for k in keys:
        hits.append(k in held)
        held = [k, *[x for x in held if x != k]][:capacity]
    return hits


@pytest.mark.parametrize("chunk", [7, 64, 1 << 20])
def test_lru(spark, chunk):
    keys = [str(x) for x in np.random.default_rng(2).zipf(1.5, 300) % 40]
    requests = spark.createDataFrame(list(enumerate(keys)), "request_id long, key string")
    got = [r["hit"] for r in cache.lru_hits(requests, 10, chunk).orderBy("request_id").collect()]
    assert got == plain_lru(keys, 10)


def test_lru_stream(spark, tmp_path):
    keys = [str(x) for x in np.random.default_rng(3).zipf(1.5, 200) % 30]
    for i in range(4):
        spark.createDataFrame(list(enumerate(keys))[50 * i : 50 * i + 50], "request_id long, key string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("request_id long, key string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = lru_stream(stream, 8).writeStream.format("memory").queryName("lru").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["request_id"]: r["hit"] for r in spark.table("lru").collect()}
    assert [got[i] for i in range(200)] == plain_lru(keys, 8)


def test_inserts(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(100)], "id long, embedding array<double>")
    first, rest = partial(rows)
    assert (first.count(), rest.count()) == (90, 10)
    first.write.parquet(str(tmp_path / "t/batch=-1"))
    rest.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    append_stream(stream, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination(120)
    assert sorted(r["id"] for r in snapshot(spark, str(tmp_path / "t"), "id long, embedding array<double>").collect()) == list(range(100))


def test_npy(spark, tmp_path):
    x = np.arange(24, dtype="<f4").reshape(6, 4)
    np.save(tmp_path / "v.npy", x)
    np.save(tmp_path / "m.npy", np.array([True, False, True]))
    got = npy.read_npy(spark, str(tmp_path / "v.npy"), limit=5).orderBy("id").collect()
    assert [r["embedding"] for r in got] == x[:5].tolist()
    assert [r["value"] for r in npy.read_npy(spark, str(tmp_path / "m.npy"), "boolean", matrix=False).orderBy("id").collect()] == [True, False, True]
    raw = (tmp_path / "v.npy").read_bytes()
    for bad in (b"nothing", raw[:-4], raw.replace(b"False", b"True "), raw.replace(b"<f4", b"<c8")):
        with pytest.raises(ValueError):
            npy.parse(bad)


def test_runs(spark, tmp_path):
    doc = dict(
        run_id="r1", language="spark", index="flat", n=100, dim=2, k=2, seed=42, build_params={}, build_s=0.5, peak_rss_mb=1.0, index_bytes=0,
        searches=[dict(search_params={"filter": "none"}, ids=[[1, 2], [3, -1]], scores=[[1.0, 0.5], [0.2, None]], latency_ms=[1.0, 3.0], qps=500.0, distance_computations=100.0, extra={})],
    )
    (tmp_path / "a.json").write_text(runs.document(**doc))
    (tmp_path / "b.json").write_text(runs.document(**doc | {"run_id": "r2", "k": 3}))
    read = runs.read_runs(spark, str(tmp_path))
    assert {r["run_id"] for r in runs.problems(read).collect()} == {"r2"}
    truth = spark.createDataFrame([("none", 0, 1, 1), ("none", 0, 2, 9), ("none", 1, 1, 3), ("none", 1, 2, 4)], "truth string, qid int, rank int, id long")
    row = metrics.run_summary(read.where("run_id = 'r1'"), truth, 2)
    assert (row.first()["recall"], row.first()["p50_ms"], row.first()["mean_ms"]) == (0.5, 2.0, 2.0)
    assert "flat" in runs.markdown(row, ["index", "recall"])
    runs.write_csv(row, str(tmp_path / "csv"))
    two = spark.createDataFrame([({"deleted": "del10", "updated": "upd10"},)], "p map<string,string>")
    with pytest.raises(Exception, match="one of"):
        two.select(metrics.truth_key(F.col("p"))).collect()


def test_repeats(spark):
    rows = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([5, 1, 3])], "case string, repeat int, p50_ms double")
    got = metrics.median_run(rows, ["case"]).first()
    assert (got["repeat"], got["low"], got["high"]) == (2, 1.0, 5.0)


def test_change_sets(spark):
    rows = spark.range(1000).select("id", F.array(F.col("id").cast("double") + 1, F.lit(1.0)).alias("embedding"))
    small, large = ({r["id"] for r in changes.delete_set(rows, f).collect()} for f in (0.1, 0.5))
    assert len(small) == 100 and len(large) == 500 and small < large
    places = sorted(r["place"] for r in changes.ranked(rows).collect())
    assert places == list(range(1000))
    sample = changes.renumbered(rows, 0.2).orderBy("id").collect()
    assert [r["id"] for r in sample] == list(range(200)) and [r["source_id"] for r in sample] == sorted(r["source_id"] for r in sample)
    with pytest.raises(ValueError):
        changes.named_filter("top7", F.col("id"), {})


def test_grid():
    assert len(grid.cases({"ivf": {"build": {"nlist": [8, 16]}, "search": {"nprobe": [1, 2, 4]}}, "flat": {}})) == 7
    grid.check_flags("hnsw", delete="del10", compact=True)
    for bad in (dict(filter="top1"), dict(delete="del10"), dict(compact=True)):
        with pytest.raises(ValueError):
            grid.check_flags("pq", **bad)
    with pytest.raises(ValueError):
        grid.check_flags("flat", delete="del10", update="upd10")


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf_dir, name):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    got = QUERIES[name](spark, sf_dir)
    said = c.sql(SQL[name])
    assert sorted(said.columns) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, said.project(", ".join(f'"{x}"' for x in got.columns)).fetchall()))


def test_entry(spark):
    assert set(SQL) <= set(QUERIES) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["qid", "rank", "id", "score"]


def test_parameters():
    known = {"a": 1, "b": "x"}
    assert grid.parameters(["a=2,b=2.5", "b=on"], known) == {"a": 2, "b": "on"} and known["a"] == 1
    for bad in ("a", "a=", "c=1"):
        with pytest.raises(ValueError):
            grid.parameters([bad], known)


def test_counts_above_lru(spark):
    requests = spark.createDataFrame([(i, str(i % 5)) for i in range(100)], "request_id long, key string")
    for chunk in (7, 1000):
        hits = cache.lru_hits(requests, 5, chunk)
        assert (hits.count(), hits.where("hit").count(), cache.hit_rate(hits).first()["hits"]) == (100, 95, 95)


def test_load():
    from nearfield.plans.load import closed_loop

    def ask(x):
        if x == 3:
            raise RuntimeError
        return x * 2

    got = closed_loop(ask, [1, 2, 3, 4], 3, 0.05)
    assert got["answers"] == [2, 4, None, 8] and got["errors"] > 0 and got["queries_done"] == len(got["latency_ms"]) > 0
    with pytest.raises(ValueError):
        closed_loop(ask, [], 1, 1)


def test_embedding(spark):
    from nearfield.operators.embedding import agreement, embedded, hashing_embedder

    texts = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, None)], "id long, text string")
    got = embedded(texts, hashing_embedder(32)).cache()
    rows = {r["id"]: r["embedding"] for r in got.collect()}
    assert rows[1] == rows[2] and set(rows[3]) == {0.0}
    assert agreement(got, got.where("id < 3")).first().asDict() == {"mean_cosine": pytest.approx(1.0), "rows": 2}


def test_graph_frames(spark):
    from nearfield.operators.graph import NODES, distances_from_entry, without_way_in

    links = [[[1]], [[2]], [[0]], [[1]]]
    nodes = spark.createDataFrame([(0, 10 * i, [0.0], 0, x, i == 0) for i, x in enumerate(links)], NODES)
    assert [r["id"] for r in without_way_in(nodes).collect()] == [30]
    assert {r["id"]: r["steps"] for r in distances_from_entry(nodes).collect()} == {0: 0, 10: 1, 20: 2}


def test_report_frames(spark):
    rows = spark.createDataFrame([("x", "before", 1.0), ("x", "after", 2.0)], "case string, stage string, p50 double")
    assert metrics.before_after(rows, ["case"], ["p50"]).first().asDict() == {"case": "x", "p50_before": 1.0, "p50_after": 2.0}
    times = spark.createDataFrame([(True, 1.0), (True, 3.0), (False, 9.0)], "hit boolean, ms double")
    assert metrics.cache_times(times).first()["p50_hit_ms"] == 2.0
    assert metrics.median_by(rows, ["case"], "stage", ["p50"]).count() == 2


def test_lists_are_trained_on_all_rows(spark, tmp_path, monkeypatch):
    """Centres are those of every row, also where there are more than an index trains on by default."""
    from nearfield.operators import kmeans

    x = np.random.default_rng(6).normal(size=(500, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    rows.write.parquet(str(tmp_path / "embeddings.parquet"))
    monkeypatch.setattr(kmeans, "ROWS_A_CENTER", 2)
    got = {(r["list_id"], r["dim"]): r["value"] for r in QUERIES["kmeans_centers"](spark, str(tmp_path)).collect()}
    want = kmeans.local(x[np.arange(500) % 10 != 0], 16)
    assert np.allclose([[got[i, j] for j in range(64)] for i in range(16)], want, atol=1e-5)


def test_lru_serves_bounded_chunks(spark, monkeypatch):
    """Without a chunk given, no task holds more requests than the module's bound."""
    keys, kept = [str(x) for x in np.random.default_rng(7).zipf(1.5, 300) % 40], []
    requests = spark.createDataFrame(list(enumerate(keys)), "request_id long, key string")
    plain = cache.written
    monkeypatch.setattr(cache, "written", lambda df, paths: kept.append(df.select("chunk").distinct().count()) or plain(df, paths))
    monkeypatch.setattr(cache, "CHUNK", 50)
    assert [r["hit"] for r in cache.lru_hits(requests, 10).orderBy("request_id").collect()] == plain_lru(keys, 10)
    assert kept and max(kept) >= 6
