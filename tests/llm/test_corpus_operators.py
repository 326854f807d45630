"""Operators over the whole corpus, and the pipeline, against brute force on small tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from nearfield.llm import line_dedup, minhash_dedup
from nearfield.llm.common import materialise
from nearfield.llm.queries import OP8_SQL, oracle_sql


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def plain_components(texts, k=4, percent=80):
    sets, root = {i: shingles(t, k) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in texts:
        for j in texts:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in texts}, {i: len(s) for i, s in sets.items()}


def near_copies(seed=5, n=90):
    """A base that is no row, near and far copies of it, copies of copies, a chain, exact copies and odd texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    base, texts = [word() for _ in range(120)], {}
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = word()
        texts[1000 + i] = " ".join(w)
    chain = [word() for _ in range(100)]
    for i in range(8):
        texts[500 - i] = " ".join(chain)
        chain = chain[4:] + [word() for _ in range(4)]
    texts |= {1: "", 2: None, 3: "a b c", 4: "A  b\nc", 5: "a b c d", 6: texts[1000].upper(), 7: "x " * 3000, 8: "x " * 4000}
    return texts


@pytest.mark.parametrize(("size", "percent"), [(4, 80), (5, 80)])
def test_components(spark, size, percent):
    texts = near_copies()
    docs = spark.createDataFrame([(i, t, 1, "c", [1], b"x") for i, t in texts.items()], "doc_id long, text string, n int, bucket string, bands array<int>, sig binary")
    want, sizes = plain_components(texts, size, percent)
    got = {r["doc_id"]: r for r in minhash_dedup.components(docs, size, percent).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_shingles"] for i, r in got.items()} == sizes
    kept = minhash_dedup.deduplicate(docs, size, percent)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(want.values())


@pytest.mark.parametrize("percent", [80, 60])
def test_prefix_pairs(spark, percent):
    """The prefix filter finds every pair at the threshold, of sizes near and far, and tables are dropped after use."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=3))
    bases = [[word() for _ in range(n)] for n in (40, 60)]
    texts = {}
    for i in range(120):
        w = list(bases[i % 2])[rng.randint(0, 6) :]
        for _ in range(rng.randint(0, 6)):
            if rng.random() < 0.5:
                del w[rng.randrange(len(w))]
            else:
                w[rng.randrange(len(w))] = rng.choice(["same", word()])
        texts[i] = " ".join(w)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    members = spark.createDataFrame([(i, i, i % 3 > 0) for i in texts], "rep long, comp long, minor boolean")
    paths = []
    got = minhash_dedup._prefix_pairs(members, docs, 4, percent, paths).distinct().collect()
    sets = {i: shingles(t, 4) for i, t in texts.items()}
    want = {(i, j) for i in texts for j in texts if i < j and (i % 3 or j % 3) and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])}
    found = {(min(r["x"], r["rep"]), max(r["x"], r["rep"])) for r in got}
    assert want <= found and len(want) > 100 and len(found) < 0.8 * 120 * 119 / 2
    assert len(paths) == 3


def rows_of_joins(spark, after):
    """Most rows that a join has made in the executions after that one, and the last execution."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store, most, last = spark._jsparkSession.sharedState().statusStore(), 0, after
    each = lambda s: (s.apply(i) for i in range(s.size()))
    for run in each(store.executionsList()):
        last = max(last, run.executionId())
        if run.executionId() > after:
            values = store.executionMetrics(run.executionId())
            joins = [n for n in each(store.planGraph(run.executionId()).allNodes()) if "Join" in n.name()]
            rows = [values.get(m.accumulatorId()) for n in joins for m in each(n.metrics()) if m.name() == "number of output rows"]
            most = max([most, *(int(v.get().replace(",", "")) for v in rows if v.isDefined())])
    return most, last


def test_prefix_pairs_of_one_text(spark):
    """The shingles of a text that all members copy are not joined, however many copies there are; no pair is lost."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    base, texts = [word() for _ in range(150)], {}
    for i in range(160):
        w = list(base)
        for at in rng.sample(range(150), rng.choice([2, 3, 6])):
            w[at] = word()
        texts[i] = " ".join(w)
    sets = {i: shingles(t, 4) for i, t in texts.items()}
    for n in (80, 160):
        docs = spark.createDataFrame([(i, texts[i]) for i in range(n)], "doc_id long, text string")
        members = materialise(spark.createDataFrame([(i, i, True) for i in range(n)], "rep long, comp long, minor boolean"))
        before, paths = rows_of_joins(spark, -1)[1], []
        pairs = minhash_dedup._prefix_pairs(members, docs, 4, 80, paths)
        assert 0 < rows_of_joins(spark, before)[0] <= 3 * n  # the sets have 147 shingles each
        found = {(min(r["x"], r["rep"]), max(r["x"], r["rep"])) for r in pairs.collect()}
        want = {(i, j) for i in range(n) for j in range(i + 1, n) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
        assert want and want <= found


def test_frequent_shingles(spark, monkeypatch):
    """Frequent shingles are bounded in number, and lie in the order of (held, s)."""
    held = spark.createDataFrame([(i, 20 + i) for i in range(100)], "s long, held long")
    of = lambda: dict(zip(*(x.tolist() for x in minhash_dedup._frequent(held)), strict=True))
    assert of() == {s: s - 12 for s in range(12, 100)}  # all of 32 and more
    monkeypatch.setattr(minhash_dedup, "FREQUENT_MOST", 80)
    assert of() == {s: s - 44 for s in range(44, 100)}  # 64 and more
    monkeypatch.setattr(minhash_dedup, "FREQUENT_MOST", 20)
    assert of() == {}  # those of 64 and more are too many


def test_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "LARGE", 3)
    texts = near_copies(seed=6)
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.components(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == plain_components(texts)[0]


def test_repeated_and_missing_ids(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, None), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["component_id"] for r in minhash_dedup.components(docs).collect()) == [1, 1, 1, 2, 2]
    assert sorted(r["doc_id"] for r in minhash_dedup.deduplicate(docs).collect()) == [1, 2]
    assert minhash_dedup.components(docs.limit(0)).count() == 0 and minhash_dedup.deduplicate(docs.limit(0)).count() == 0


def test_least_matches():
    """Few pairs at the threshold are dropped, and none whose bytes all match."""
    from math import comb

    for n in (32, 96, 160):
        m, t = minhash_dedup.least_matches(n), 0.8 + 0.2 / 256
        assert sum(comb(n, i) * t**i * (1 - t) ** (n - i) for i in range(m)) < 1e-4 and m < n


def test_connected_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(25)] + [(7, 7)]
    root = {x: x for e in edges for x in e}
    for _ in range(len(root)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = minhash_dedup.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert {r["node"]: r["comp"] for r in got} == {n: root[n] for n in nodes} and len(got) == len(nodes)


def plain_lines(docs, least):
    """Deletes each line in a run of lines with enough words that starts at an earlier place too."""
    lines = {d: [(i, x, len(x.split())) for i, x in enumerate((t or "").split("\n")) if x.split()] for d, t in docs.items()}
    gone, seen = {d: set() for d in docs}, {}
    for d in sorted(docs):
        for s in range(len(lines[d])):
            run, words = [], 0
            for e in range(s, len(lines[d])):
                run.append(lines[d][e][1])
                words += lines[d][e][2]
                if words >= least:
                    first = seen.setdefault(tuple(run), (d, s))
                    if first != (d, s):
                        gone[d].update(x[0] for x in lines[d][s : e + 1])
    return {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in docs.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup(spark, seed):
    rng = random.Random(seed)
    line = lambda: " ".join(rng.choices("abc", k=rng.choice([0, 1, 1, 2, 3, 7])))
    pool = [line() for _ in range(6)]
    docs = {d: "\n".join(rng.choice(pool) if rng.random() < 0.9 else line() + str(rng.random()) for _ in range(rng.randint(1, 40))) for d in range(1, 16)}
    docs |= {20: docs[3], 21: docs[3], 22: None, 23: "", 24: "\n\n", 25: "a a\n" * 50, 26: "one line of quite a few words " * 2000, 27: "one line of quite a few words " * 2000}
    rows = spark.createDataFrame([(d, t, len(t or ""), 1, 2, 3) for d, t in docs.items()], "doc_id long, text string, n_chars long, d int, h int, seg int")
    got = line_dedup.deduplicate_lines(rows, 9)
    assert got.columns == [*rows.columns, "n_lines", "n_removed"]
    found = {r["doc_id"]: r for r in got.collect()}
    want = plain_lines(docs, 9)
    assert {d: r["text"] for d, r in found.items()} == want
    for d, r in found.items():
        assert r["n_lines"] - r["n_removed"] == (0 if want[d] is None else len(want[d].split("\n")) if want[d] or r["n_lines"] > r["n_removed"] else 0)


def test_line_dedup_odd_rows(spark):
    text = "\n".join(f"line {i} of this text" for i in range(20))
    rows = spark.createDataFrame([(None, text), (3, text), (3, text), (4, text)], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["n_removed"]) for r in line_dedup.deduplicate_lines(rows).collect()))
    assert got == [(0, 0), (3, 20), (3, 20), (4, 20)]  # equal rows are one document, and a missing id is the first
    assert line_dedup.deduplicate_lines(rows.limit(0)).count() == 0


def test_pipeline(spark, sf_dir):
    """Each stage on what the one before kept, against brute force."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(materialise(stage(spark, steps[-1], sf_dir)))
    tables = [{r["doc_id"]: r for r in s.collect()} for s in steps]
    for before, after, step in zip(tables, tables[1:], steps[1:-1], strict=False):
        assert step.columns == docs.columns and set(after) <= set(before)
        assert all(r["n_chars"] == len(r["text"]) for r in after.values())
    first, named, lined, near, clean, pieces = tables
    assert set(named) == set(first)  # all test documents are in known languages
    want = plain_lines({d: r["text"] for d, r in named.items()}, line_dedup.MIN_WORDS)
    assert {d: r["text"] for d, r in lined.items()} == {d: t for d, t in want.items() if t == named[d]["text"] or t.split()}
    components, _ = plain_components({d: r["text"] for d, r in lined.items()}, corpus_pipeline.SHINGLE, corpus_pipeline.PERCENT)
    assert set(near) == {d for d, c in components.items() if d == c}
    from tests.llm.test_text_operators import plain_hits, plain_words

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for d, r in near.items():
        hit, _ = plain_hits(r["text"], items)
        if 2 * hit > len(plain_words(r["text"])):
            assert d not in clean
        elif not hit:
            assert clean[d]["text"] == r["text"]
        else:
            assert len(plain_words(clean[d]["text"])) == len(plain_words(r["text"])) - hit
    assert set(pieces) == set(clean) and all(r["decoded"] for r in pieces.values())


def test_pipeline_odd_rows(spark, sf_dir, tmp_path):
    """Every stage puts up with nulls, empty and very long texts, repeated rows, clashing columns and an empty table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    english = docs.where("lang = 'en'").orderBy("doc_id").limit(3).collect()
    long = "\n".join(f"{english[0]['text']} {i}" for i in range(400))
    russian = "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью. " * 4
    extra = [(None, english[1]["text"] + " without an id"), (-1, None), (-2, ""), (-3, " \n\t"), (-4, long), (-5, russian), (-6, "½ ① Ⅷ"), (-7, english[2]["text"]), (-7, english[2]["text"]), (-8, long)]
    odd = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in extra], docs.schema).unionByName(docs)
    clashing = odd.select("*", *[F.lit(1).alias(c) for c in ("rejected", "row", "n_lines", "gone", "component_id", "bands", "starts", "items", "ids", "score", "d", "h")])
    steps = [clashing]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(materialise(stage(spark, steps[-1], sf_dir)))
        assert name == "sentencepiece_encoding" or steps[-1].columns == clashing.columns
        assert stage(spark, clashing.limit(0), sf_dir).count() == 0
    ids = [{r["doc_id"] for r in s.select("doc_id").collect()} for s in steps]
    assert ids[0] - ids[1] == {-1, -2, -3, -5, -6}  # without letters, or in a language that was not learned
    assert -4 not in ids[2] and {-8, None} <= ids[2]  # a later copy has lost all its lines
    assert steps[3].where("doc_id = -7").count() <= 1 and ids[4] == ids[5]


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, sf_dir, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = __spark_entry__.queries()[name](spark, sf_dir)
    said = c.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(said.columns) == sorted(got.columns)
    rows = sorted(map(str, said.project(", ".join(got.columns)).fetchall()))
    assert sorted(str(tuple(r)) for r in got.collect()) == rows


def test_registered():
    names = [q for q in __spark_entry__.queries() if re.match(r"op\d+_", q)]
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in names) == list(range(1, 11)) and OP8_SQL
    assert [n for n, _ in corpus_pipeline.STAGES] and F
