"""Layered small-world graph (Malkov and Yashunin, 2018), one graph for each shard.

Rows are inserted in id order with seeded levels; afterwards nodes that no walk from the entry point can find
get an edge that is never pruned. Deleted nodes are walked but never returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions.random import SplitMix64
from nearfield.functions.vectors import block_scores
from nearfield.operators.base import Index, filtered, upserted
from nearfield.operators.graph import NODES, Walk, best_first, built, dealt, graph_figures, per_shard, reached, shard_count, tie_in
from nearfield.operators.search import TILE_QUERIES, TILE_ROWS, QueryBlock, TopK, best_rows, exact_scores, keep, query_blocks, union
from nearfield.sources.scratch import written

REPAIR_PASSES = 3


class Graph:
    """The graph of one shard; nodes are places in id order."""

    def __init__(self, vectors: np.ndarray, m: int, ef_construct: int):
        self.vectors, self.m, self.ef = vectors, m, ef_construct
        self.links: list[list[list[int]]] = [[] for _ in vectors]
        self.entry = -1
        self.kept: set[tuple[int, int]] = set()  # edges of the repair

    def cap(self, layer: int) -> int:
        return self.m if layer else 2 * self.m

    def at(self, layer: int):
        return lambda v: self.links[v][layer]

    def select(self, scored: list[tuple[float, int]], count: int, always: tuple[int, ...] = ()) -> list[int]:
        """The nearest nodes, each nearer to the target than to any that was taken before it."""
        taken = list(always)
        for s, v in sorted(scored, key=lambda x: (-x[0], x[1])):
            if len(taken) >= count:
                break
            if v not in taken and (not taken or not (self.vectors[taken] @ self.vectors[v] > s).any()):
                taken.append(v)
        return taken

    def scored(self, v: int, nodes: list[int]) -> list[tuple[float, int]]:
        return list(zip((self.vectors[nodes] @ self.vectors[v]).tolist(), nodes, strict=True)) if nodes else []

    def connect(self, u: int, v: int, layer: int) -> None:
        """Add u -> v; a list over its cap is selected anew, but for edges of the repair."""
        links = self.links[u][layer]
        if v not in links:
            links.append(v)
        if len(links) > self.cap(layer):
            always = tuple(x for x in links if layer == 0 and (u, x) in self.kept)
            self.links[u][layer] = self.select(self.scored(u, links), self.cap(layer), always)

    def descend(self, walk: Walk, start: int, top: int, bottom: int) -> int:
        """The node that greedy steps from ``start`` end in, over layers top down to above bottom."""
        best, score = start, walk.score([start])[0]
        for layer in range(top, bottom, -1):
            moved = True
            while moved:
                moved, near = False, self.links[best][layer]
                for s, v in zip(walk.score(near) if near else [], near, strict=True):
                    if s > score:
                        best, score, moved = v, s, True
        return best

    def insert(self, v: int, level: int) -> None:
        self.links[v] = [[] for _ in range(level + 1)]
        if self.entry < 0:
            self.entry = v
            return
        top, walk = len(self.links[self.entry]) - 1, Walk(self.vectors, self.vectors[v])
        starts = [self.descend(walk, self.entry, top, level)] if top > level else [self.entry]
        for layer in range(min(level, top), -1, -1):
            found = best_first(walk, starts, self.ef, self.at(layer))
            found = [x for x in found if x[1] != v]
            for u in self.select(found, self.m):
                self.links[v][layer].append(u)
                self.connect(u, v, layer)
            starts = [u for _, u in found] or starts
        if level > top:
            self.entry = v

    def within(self, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places in ``starts``, and the nodes that walks from there which drop nothing come to.

        From nodes that lead to the entry and can be reached from it, these are what the entry leads to.
        """
        into: list[list[int]] = [[] for _ in self.links]
        for v, layers in enumerate(self.links):
            for u in layers[0]:
                into[u].append(v)
        ahead = reached(self.at(0), self.entry)
        tied = ahead & reached(into.__getitem__, self.entry)
        by = np.array([self.entry if v in tied else v for v in starts.tolist()], np.int64)
        for v in np.unique(by).tolist():
            yield np.flatnonzero(by == v), np.array(sorted(ahead if v == self.entry else reached(self.at(0), v)))

    def repair(self, nodes: list[int]) -> None:
        """Give every node a way in: first those without in-edges, then those no walk from the entry reaches."""
        for _ in range(REPAIR_PASSES):
            into = {u for v in nodes for u in self.links[v][0]}
            for v in nodes:
                if v not in into and v != self.entry:
                    near = self.scored(v, self.links[v][0]) or best_first(Walk(self.vectors, self.vectors[v]), [self.entry], self.ef, self.at(0))
                    near = [x for x in near if x[1] != v]
                    if near:
                        self.protect(max(near, key=lambda x: (x[0], -x[1]))[1], v)
            within = reached(self.at(0), self.entry) if nodes else set()
            lost = [v for v in nodes if v not in within]
            for v in lost:
                near = [u for _, u in best_first(Walk(self.vectors, self.vectors[v]), [self.entry], self.ef, self.at(0))]
                self.protect(next((u for u in near if len(self.links[u][0]) < self.cap(0)), near[0]), v)
            if not lost:
                break
        if nodes:
            tie_in(self.vectors, [layers[0] if layers else [] for layers in self.links], self.entry, self.cap(0), nodes)

    def protect(self, u: int, v: int) -> None:
        self.kept.add((u, v))
        self.connect(u, v, 0)

    def detach(self, nodes: set[int]) -> None:
        """Drop all edges from and to these nodes."""
        for v, layers in enumerate(self.links):
            self.links[v] = [[] if v in nodes else [u for u in near if u not in nodes] for near in layers]


def build(vectors: np.ndarray, m: int, ef_construct: int, seed: int) -> Graph:
    random = SplitMix64(seed)
    levels = [random.level(m) for _ in vectors]
    graph = Graph(vectors, m, ef_construct)
    for v, level in enumerate(levels):
        graph.insert(v, level)
    graph.repair(list(range(len(vectors))))
    return graph


def loaded(pdf: pd.DataFrame, m: int, ef_construct: int) -> Graph:
    """The graph that rows of one shard, in id order, hold."""
    graph = Graph(np.stack(pdf["embedding"].to_numpy()).astype(np.float64), m, ef_construct)
    graph.links = [[list(map(int, near)) for near in layers] for layers in pdf["links"]]
    graph.entry = int(np.flatnonzero(pdf["entry"].to_numpy())[0])
    return graph


class HnswIndex(Index):
    name = "hnsw"
    build_defaults = {"m": 16, "ef_construct": 100, "shards": None}
    search_defaults = {"ef": 64}

    def _build(self, corpus: DataFrame) -> None:
        m, ef, seed = self.params["m"], self.params["ef_construct"], self.seed
        if m < 2:
            raise ValueError("m must be at least 2")
        self.rows = corpus

        def run(ids: np.ndarray, vectors: np.ndarray):
            g = build(vectors, m, ef, seed)
            return [len(x) - 1 for x in g.links], g.links, g.entry

        self.params["shards"] = shard_count(corpus, self.params["shards"])
        self.nodes = built(dealt(corpus, self.params["shards"]), run)

    def _walks(self, queries: DataFrame, k: int, where: Column | None, ef: int) -> DataFrame:
        """qid, id, score and n (scored nodes) of each shard's result; id is -1 in a row that only counts."""
        m, efc = self.params["m"], self.params["ef_construct"]
        ok = self.live(filtered(self.rows, where)) if where is not None else self.live(self.rows)
        whole = where is None and self.deleted is None
        nodes = self.nodes if whole else self.nodes.join(ok.select("id", F.lit(True).alias("ok")), "id", "left")
        nodes = nodes.withColumn("ok", F.lit(True) if whole else F.coalesce("ok", F.lit(False)))

        def search(pdf: pd.DataFrame, q: QueryBlock, top: TopK) -> np.ndarray:
            g, ids, allowed = loaded(pdf, m, efc), pdf["id"].to_numpy(), pdf["ok"].to_numpy(bool)
            counts, wide, starts = np.zeros(len(q.qids), np.int64), max(ef, k) >= len(pdf), []
            step = min(TILE_QUERIES, max(1, TILE_QUERIES * TILE_ROWS // len(pdf)))
            for a in range(0, len(q.qids), step):
                x = q.vectors[a : a + step]
                ats, found = [], []
                for i, s in enumerate(block_scores(x, g.vectors), a):
                    walk = Walk(g.vectors, q.vectors[i], s)
                    start = g.descend(walk, g.entry, len(g.links[g.entry]) - 1, 0)
                    if wide:
                        starts.append(start)
                    else:
                        best = best_first(walk, [start], max(ef, k), g.at(0), None if allowed.all() else allowed)[:k]
                        ats += [i] * len(best)
                        found += [v for _, v in best]
                    counts[i] = walk.count
                at, v = np.array(ats, np.int64), np.array(found, np.int64)
                top.add(at, ids[v], exact_scores(q.vectors, at, g.vectors, v, "ip"))
            if wide:
                for asking, nodes in g.within(np.array(starts)):
                    keep(q, asking, ids, g.vectors, nodes[allowed[nodes]], top, "ip")
                    counts[asking] += len(nodes)
            return counts

        parts = [per_shard(nodes, b, ["shard", "id", "embedding", "links", "entry", "ok"], k, search) for b in query_blocks(queries, k)]
        return union(parts, self.spark.createDataFrame([], "qid long, id long, score double, n long"))

    def _search(self, queries: DataFrame, k: int, where: Column | None, params: dict) -> DataFrame:
        return best_rows(self._walks(queries, k, where, params["ef"]).where("id >= 0").select("qid", "id", "score"), k)

    def distance_computations(self, queries: DataFrame, k: int = 10, ef: int = 64) -> DataFrame:
        return self._walks(queries, k, None, ef).where("id = -1").groupBy("qid").agg(F.sum("n").alias("n"))

    def _changed(self, rows: DataFrame, change) -> DataFrame:
        """Nodes after ``change(graph, pdf)`` ran on each shard's graph."""
        m, efc = self.params["m"], self.params["ef_construct"]

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("id").reset_index(drop=True)
            g = loaded(pdf, m, efc)
            keep = change(g, pdf)
            out = pd.DataFrame({"shard": pdf["shard"], "id": pdf["id"], "embedding": list(g.vectors), "level": [len(x) - 1 for x in g.links], "links": g.links, "entry": [v == g.entry for v in range(len(pdf))]})
            if keep is None:
                return out
            place = np.cumsum(keep) - 1
            out["links"] = [[[int(place[u]) for u in near] for near in layers] for layers in g.links]
            return out[keep]

        return written(rows.groupBy("shard").applyInPandas(run, NODES))

    def _insert(self, rows: DataFrame) -> None:
        """New rows join the graph of their shard in id order, after the rows that are there."""
        self.rows = self.rows.unionByName(rows)
        blank = F.array().cast("array<array<int>>")
        new = dealt(rows, self.params["shards"]).select("shard", "id", "embedding", F.lit(-1).alias("level"), blank.alias("links"), F.lit(False).alias("entry"))
        m, efc, seed = self.params["m"], self.params["ef_construct"], self.seed

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("id").reset_index(drop=True)
            old, fresh = pdf[pdf["level"] >= 0], pdf[pdf["level"] < 0]
            # Links are places by id; rows that come between others move these.
            place = dict(enumerate(old.index.tolist()))
            g = Graph(np.stack(pdf["embedding"].to_numpy()).astype(np.float64), m, efc)
            for v, layers in zip(old.index, old["links"], strict=True):
                g.links[v] = [[place[int(u)] for u in near] for near in layers]
            entry = old.index[old["entry"].to_numpy(bool)]
            g.entry = int(entry[0]) if len(entry) else -1
            random = SplitMix64(seed)
            levels = [random.level(m) for _ in range(len(pdf))][len(old) :]  # those that a build would have drawn next
            for v, level in zip(fresh.index.tolist(), levels, strict=True):
                g.insert(v, level)
            g.repair(list(range(len(pdf))))
            return pd.DataFrame({"shard": pdf["shard"], "id": pdf["id"], "embedding": list(g.vectors), "level": [len(x) - 1 for x in g.links], "links": g.links, "entry": [v == g.entry for v in range(len(pdf))]})

        self.nodes = written(self.nodes.unionByName(new).groupBy("shard").applyInPandas(run, NODES))

    def _update(self, rows: DataFrame) -> None:
        self.rows = upserted(self.rows, rows)
        new = self.nodes.join(rows.select("id", F.col("embedding").cast("array<double>").alias("new")), "id", "left")

        def change(g: Graph, pdf: pd.DataFrame) -> None:
            moved = [v for v in range(len(pdf)) if pdf["new"].iloc[v] is not None]
            levels = {v: len(g.links[v]) - 1 for v in moved}
            for v in moved:
                g.vectors[v] = pdf["new"].iloc[v]
            g.detach(set(moved))
            rest = [v for v in range(len(pdf)) if v not in levels]
            if g.entry in levels:
                g.entry = max(rest, key=lambda v: (len(g.links[v]), -v)) if rest else -1
            for v in moved:
                g.insert(v, levels[v])
            g.repair(list(range(len(pdf))))

        self.nodes = self._changed(new, change)

    def _compact(self, mode: str) -> None:
        if mode not in ("rebuild", "repair"):
            raise ValueError("mode is rebuild or repair")
        if self.deleted is None:
            return
        live = self.live(self.rows)
        if mode == "rebuild":
            self.deleted = None
            self._build(live)
            return
        nodes = self.nodes.join(self.deleted.withColumn("dead", F.lit(True)), "id", "left").withColumn("dead", F.coalesce("dead", F.lit(False)))

        def change(g: Graph, pdf: pd.DataFrame) -> np.ndarray:
            dead = set(np.flatnonzero(pdf["dead"].to_numpy(bool)).tolist())
            alive = [v for v in range(len(pdf)) if v not in dead]
            for v in alive:
                for layer, near in enumerate(g.links[v]):
                    if dead.intersection(near):
                        # What lay behind the dead neighbours takes their place.
                        behind = {w for u in near if u in dead and layer < len(g.links[u]) for w in g.links[u][layer]}
                        pool = sorted(({*near} | behind) - dead - {v})
                        g.links[v][layer] = g.select(g.scored(v, pool), g.cap(layer))
            for v in dead:
                g.links[v] = [[] for _ in g.links[v]]
            if alive:
                g.entry = max(alive, key=lambda v: (len(g.links[v]), -v))
                g.repair(alive)
            return ~pdf["dead"].to_numpy(bool)

        self.nodes, self.rows, self.deleted = self._changed(nodes, change), live, None

    def stats(self) -> DataFrame:
        total = graph_figures(self.nodes).agg(F.sum("edges"), F.sum(F.when(F.col("layer") == 0, F.col("nodes"))), F.max("layer")).first()
        return self._figures(rows=total[1], edges=total[0], top_layer=total[2], index_bytes=4 * (total[0] or 0))
