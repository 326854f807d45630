import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.operators import changes, kmeans, metrics
from nearfield.operators.flat import FlatIndex
from nearfield.operators.graph import edges, reached
from nearfield.operators.hnsw import HnswIndex, build
from nearfield.operators.ivf import IvfIndex
from nearfield.operators.pq import IvfPqIndex, PqIndex
from nearfield.operators.search import exact_topk
from nearfield.operators.vamana import DiskAnnIndex, build as build_vamana
from nearfield.sources.store import load, packed_tombstones, save, unpacked_tombstones
from nearfield.sources.tables import vectors


@pytest.fixture(scope="module")
def data(spark, sf_dir):
    q, c = changes.split(vectors(spark, sf_dir))
    c = c.withColumn("embedding", F.col("embedding").cast("array<double>")).cache()
    return q.cache(), c


def ids(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r["qid"], r["rank"])):
        out.setdefault(r["qid"], []).append(r["id"])
    return out


def brute(data, keep=lambda r: True, k=10):
    q, c = data
    rows = [r for r in c.collect() if keep(r)]
    x, i = np.array([r["embedding"] for r in rows]), np.array([r["id"] for r in rows])
    return {r["qid"]: i[np.lexsort((i, -(x @ np.array(r["embedding"], float))))[:k]].tolist() for r in q.collect()}


def recall(found, want):
    return np.mean([len(set(found[q]) & set(want[q])) / 10 for q in want])


def test_flat(spark, data):
    q, c = data
    index = FlatIndex.build(c)
    assert ids(index.search(q)) == brute(data)
    assert ids(index.search(q, where=F.col("views") >= 9000)) == brute(data, lambda r: r["views"] >= 9000)
    short = index.search(q, where=F.col("id") < 3, pad=True).where("qid = 0").orderBy("rank").collect()
    assert len(short) == 10 and short[-1]["id"] == -1 and short[-1]["score"] is None
    gone = changes.delete_set(c, 0.1)
    index.delete(gone)
    index.delete(changes.delete_set(c, 0.3, salt=4))
    dead = {r["id"] for r in gone.union(changes.delete_set(c, 0.3, salt=4)).collect()}
    want = brute(data, lambda r: r["id"] not in dead)
    assert ids(index.search(q)) == want
    index.compact()
    assert ids(index.search(q)) == want
    assert metrics.deleted_returned(index.search(q), gone).first()[0] == 0
    with pytest.raises(ValueError):
        index.search(q, ef=3)


def test_ties_and_empty(spark):
    c = spark.createDataFrame([(i, [1.0, 0.0]) for i in (5, 3, 9, 1)], "id long, embedding array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "qid long, embedding array<double>")
    assert ids(exact_topk(q, c, 3)) == {0: [1, 3, 5]}
    assert exact_topk(q, c.limit(0), 3).count() == 0 and exact_topk(q.limit(0), c, 3).count() == 0


def test_kmeans(spark, data):
    _, c = data
    x = np.array([r["embedding"] for r in c.orderBy("id").collect()])
    centers = kmeans.kmeans(c, 16)
    assert np.allclose(np.linalg.norm(centers, axis=1), 1)
    assert np.allclose(centers, kmeans.local(x, 16), atol=1e-9) and np.allclose(centers, kmeans.kmeans(c.repartition(7), 16), atol=1e-9)
    same = np.repeat(np.eye(4)[:2], 10, axis=0)
    assert len(np.unique(kmeans.assign(same, kmeans.local(same, 3))[0])) >= 2  # repeated points: empty clusters are refilled
    with pytest.raises(ValueError):
        kmeans.kmeans(c, 10_000)


def test_ivf(spark, data, tmp_path):
    q, c = data
    index, want = IvfIndex.build(c, nlist=16), brute(data)
    index.rows = index.rows.cache()
    found = [recall(ids(index.search(q, nprobe=n)), want) for n in (1, 4, 16)]
    assert found == sorted(found) and found[-1] == 1.0 and found[0] < 1.0
    assert sum(r["n"] for r in index.list_sizes().collect()) == c.count()
    assert {r["n"] for r in index.distance_computations(q, 16).collect()} == {16 + c.count()}
    new = changes.update_set(c)
    index.update(new)
    some = new.limit(5).collect()
    asked = spark.createDataFrame([(r["id"], r["embedding"]) for r in some], "qid long, embedding array<double>")
    assert all(v[0] == k for k, v in ids(index.search(asked, 1)).items())  # a changed row finds itself
    index.delete(changes.delete_set(c, 0.3))
    save(index, str(tmp_path / "i"))
    again = load(spark, str(tmp_path / "i"), "ivf", 64, nlist=16)
    assert metrics.compared(index.search(q, nprobe=4), again.search(q, nprobe=4)).first().asDict() == {"all_equal": True, "equal_share": 1.0, "mean_overlap": 1.0}
    for bad in ({"name": "flat", "dim": 64}, {"name": "ivf", "dim": 32}, {"name": "ivf", "dim": 64, "nlist": 8}):
        with pytest.raises(ValueError):
            load(spark, str(tmp_path / "i"), **bad)


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_pq(spark, data, metric):
    q, c = data
    want = brute(data)
    index = PqIndex.build(c, m=8, metric=metric, iters=5)
    index.codes = index.codes.cache()
    found = [recall(ids(index.search(q, rerank=n)), want) for n in (0, 50, c.count())]
    assert found == sorted(found) and found[0] > 0.3 and found[-1] == 1.0
    listed = IvfPqIndex.build(c, nlist=8, m=8, metric=metric, iters=5)
    assert recall(ids(listed.search(q, nprobe=8, rerank=c.count())), want) == 1.0
    with pytest.raises(ValueError):
        index.search(q, where=F.col("views") > 0)
    with pytest.raises(ValueError):
        index.delete(c.limit(1))
    for bad in ({"m": 7}, {"m": 8, "nbits": 4}, {"m": 8, "metric": "cosine"}):
        with pytest.raises(ValueError):
            PqIndex.build(c, **bad)


def test_hnsw(spark, data, tmp_path):
    q, c = data
    want, n = brute(data), c.count()
    index = HnswIndex.build(c, m=8, ef_construct=40)
    index.nodes = index.nodes.cache()
    found = [recall(ids(index.search(q, ef=e)), want) for e in (16, 64, n)]
    assert found == sorted(found) and found[1] > 0.9 and found[-1] == 1.0
    assert edges(index.nodes).groupBy("layer", "id").count().agg(F.max(F.when(F.col("layer") == 0, F.col("count")))).first()[0] <= 16
    half = brute(data, lambda r: r["views"] >= 5000)
    assert recall(ids(index.search(q, where=F.col("views") >= 5000, ef=n)), half) == 1.0
    save(index, str(tmp_path / "h"))
    again = load(spark, str(tmp_path / "h"), "hnsw", 64)
    assert ids(again.search(q, ef=32)) == ids(index.search(q, ef=32))
    gone = {r["id"] for r in changes.delete_set(c, 0.3).collect()}
    left = brute(data, lambda r: r["id"] not in gone)
    for mode in ("repair", "rebuild"):
        index = load(spark, str(tmp_path / "h"), "hnsw", 64)
        index.delete(changes.delete_set(c, 0.3))
        assert not gone & {i for v in ids(index.search(q)).values() for i in v}
        index.compact(mode)
        assert recall(ids(index.search(q, ef=n)), left) == 1.0


def test_built_once(spark, data):
    """What a build worked out is written: searches read it, and hold no step of a build."""
    q, c = data
    indexes = [IvfIndex.build(c, nlist=8), PqIndex.build(c, m=8, iters=2), IvfPqIndex.build(c, nlist=8, m=8, iters=2), HnswIndex.build(c, m=8, ef_construct=20), DiskAnnIndex.build(c, r=8, l_build=20, pq_m=8)]
    for index in indexes:
        for name in ("nodes", "codes", "rows" if index.name == "ivf" else "codes"):
            if hasattr(index, name):
                plan = getattr(index, name)._jdf.queryExecution().optimizedPlan().toString()
                assert "Relation" in plan and "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("kind", ["flat", "ivf", "pq", "ivf_pq", "hnsw"])
def test_insert(spark, data, kind, tmp_path):
    """Inserted rows are found by searches and survive saving; known ids are refused."""
    q, c = data
    build = {"flat": FlatIndex.build, "ivf": lambda r: IvfIndex.build(r, nlist=8), "pq": lambda r: PqIndex.build(r, m=8, iters=3), "ivf_pq": lambda r: IvfPqIndex.build(r, nlist=8, m=8, iters=3), "hnsw": lambda r: HnswIndex.build(r, m=8, ef_construct=40, shards=2)}
    wide = {"flat": {}, "ivf": {"nprobe": 8}, "pq": {"rerank": 500}, "ivf_pq": {"nprobe": 8, "rerank": 500}, "hnsw": {"ef": 500}}
    odd = c.where("id % 3 = 1")
    index = build[kind](c.where("id % 3 <> 1"))
    index.insert(odd)
    assert ids(index.search(q, **wide[kind])) == brute(data)
    with pytest.raises(ValueError):
        index.insert(odd.limit(1))
    save(index, str(tmp_path / kind))
    assert ids(load(spark, str(tmp_path / kind), kind, 64).search(q, **wide[kind])) == brute(data)


def test_no_insert(data):
    with pytest.raises(ValueError):
        DiskAnnIndex.build(data[1], r=8, l_build=20, pq_m=8).insert(data[1].limit(1))


def test_graphs_reach_all():
    x = np.random.default_rng(1).normal(size=(300, 8))
    x = np.concatenate([x, x[:40]]) / np.linalg.norm(np.concatenate([x, x[:40]]), axis=1, keepdims=True)
    g = build(x, 4, 20, 42)
    assert len(reached(g.at(0), g.entry)) == len(x)
    assert all(len(near) <= (8 if layer == 0 else 4) for layers in g.links for layer, near in enumerate(layers))
    assert g.links == build(x, 4, 20, 42).links
    links, start = build_vamana(x, 16, 40, 1.2, 42)
    assert max(map(len, links)) <= 16 and len(reached(links.__getitem__, start)) == len(x)


def test_diskann(spark, data):
    q, c = data
    index = DiskAnnIndex.build(c, r=16, l_build=40, pq_m=8)
    want, n = brute(data), c.count()
    index.nodes, index.pq.codes = index.nodes.cache(), index.pq.codes.cache()
    found = [recall(ids(index.search(q, l=s, rerank=s)), want) for s in (20, 100, n)]
    assert found == sorted(found) and found[1] > 0.8 and found[-1] == 1.0
    reads = index.disk_reads(q, l=100).collect()
    assert all(r["disk_reads"] > 0 and r["disk_bytes_read"] == 4096 * r["disk_reads"] for r in reads)


def test_tombstones(spark):
    gone = [0, 1, 7, 8, 32767, 32768, 100_000]
    rows = spark.createDataFrame([(i,) for i in gone], "id long")
    assert sorted(r["id"] for r in unpacked_tombstones(packed_tombstones(rows)).collect()) == gone


def test_scan_is_bounded(spark, monkeypatch):
    """No matrix product is larger than a tile, whatever the number of queries and rows; ties and scales change nothing."""
    from nearfield.operators import search

    x = np.random.default_rng(5).normal(size=(5000, 8)).round(1) * 1e3
    x[4000:4400] = x[7]
    seen, plain = [], search.block_scores
    monkeypatch.setattr(search, "block_scores", lambda a, b, metric="ip": seen.append((len(a), len(b))) or plain(a, b, metric))
    for metric in ("ip", "l2"):
        q = search.QueryBlock(np.arange(1500), x[:1500])
        top = search.TopK(1500, 10)
        search.keep(q, np.arange(1500), np.arange(5000), x, np.arange(5000), top, metric)
        for i in (0, 7, 611, 1499):
            s = search.sequential_score(np.broadcast_to(x[i], x.shape), x, metric)
            best = np.lexsort((np.arange(5000), -s))[:10]
            assert top.ids[i].tolist() == best.tolist() and top.scores[i].tolist() == s[best].tolist()
    assert max(a * b for a, b in seen) <= search.TILE_QUERIES * search.TILE_ROWS


@pytest.mark.parametrize("kind", [PqIndex, IvfPqIndex])
def test_pq_candidates_are_bounded(spark, data, kind, monkeypatch):
    """Rescoring holds k rows of a query and no list of candidates; segments only add candidates, and their layout changes nothing."""
    from nearfield.operators import pq, search

    q, c = data
    more, wide = ({"nlist": 4}, {"nprobe": 4}) if kind is IvfPqIndex else ({}, {})
    index = kind.build(c, m=8, iters=3, **more)
    asked = []
    monkeypatch.setattr(pq, "scan", lambda rows, columns, block, k, *a: asked.append(k) or search.scan(rows, columns, block, k, *a))
    want, one = brute(data), recall(ids(index.search(q, rerank=40, **wide)), brute(data))
    assert ids(index.search(q, rerank=c.count(), **wide)) == want and set(asked) == {10}
    monkeypatch.setattr(pq, "SEGMENT_ROWS", 100)
    found = ids(index.search(q, rerank=40, **wide))
    assert recall(found, want) >= one and recall(found, want) > 0.9
    index.codes = index.codes.repartition(7)
    assert ids(index.search(q, rerank=40, **wide)) == found
    plain = index.search(q, **wide).collect()  # by codes alone
    assert len(plain) == 10 * q.count() and recall(ids(index.search(q, **wide)), want) > 0.3


def test_graph_shards_are_bounded(spark, data, monkeypatch):
    """Shards have a bounded number of rows, a search gives k rows a query and task, and a wide one is exact in each."""
    from nearfield.operators import graph

    q, c = data
    monkeypatch.setattr(graph, "SHARD_ROWS", 50)
    monkeypatch.setattr(graph, "tasks", lambda rows: 3)
    n, want = c.count(), brute(data)
    half = brute(data, lambda r: r["views"] >= 5000)
    index = HnswIndex.build(c, m=8, ef_construct=40)
    assert index.nodes.select("shard").distinct().count() == 9
    assert recall(ids(index.search(q, ef=20)), want) > 0.95 and ids(index.search(q, ef=n)) == want
    assert ids(index.search(q, where=F.col("views") >= 5000, ef=n)) == half
    assert index._walks(q, 10, None, 20).count() <= 3 * 11 * q.count()
    assert {r["n"] >= n for r in index.distance_computations(q, ef=n).collect()} == {True}
    disk = DiskAnnIndex.build(c, r=16, l_build=40, pq_m=8)
    assert ids(disk.search(q, l=n, rerank=n)) == want and recall(ids(disk.search(q, l=n, rerank=20)), want) > 0.9
    assert {r["disk_reads"] for r in disk.disk_reads(q, l=n).collect()} == {n}
    assert {r["disk_reads"] >= 9 * 10 for r in disk.disk_reads(q, l=10).collect()} == {True}


def test_all_nodes_are_tied_in():
    """Tight clusters far apart, which neighbour lists alone do not connect."""
    from nearfield.operators.graph import tie_in

    x = np.random.default_rng(3).normal(size=(400, 16)) * 1e-3 + np.repeat(np.random.default_rng(4).normal(size=(4, 16)), 100, axis=0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links, start = build_vamana(x, 8, 20, 1.2, 42)
    assert len(reached(links.__getitem__, start)) == 400 and max(map(len, links)) <= 8
    near = [[int(u) for u in np.argsort(-(x @ x[v]))[1:5]] for v in range(400)]
    tie_in(x, near, 0, 4, range(400))
    assert len(reached(near.__getitem__, 0)) == 400 and max(map(len, near)) <= 4
    g = build(x, 4, 20, 42)
    assert len(reached(g.at(0), g.entry)) == 400


def test_repair_walks_once_a_pass(monkeypatch):
    """A graph is walked once in each pass of its repair, not once for each node."""
    from nearfield.operators import hnsw

    calls, plain = [], hnsw.reached
    monkeypatch.setattr(hnsw, "reached", lambda *a: calls.append(1) or plain(*a))
    build(np.random.default_rng(1).normal(size=(200, 8)), 4, 20, 42)
    assert len(calls) <= hnsw.REPAIR_PASSES
