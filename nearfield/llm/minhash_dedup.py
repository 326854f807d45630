"""Near-duplicate documents: MinHash bands, sequential Bayesian verification, exact confirmation.

1. Texts of equal shingle sets form a class; only its least doc_id, the representative, goes on.
2. Signatures are cut into bands; representatives that agree in a band share a bucket.
3. Each bucket has a hub, its member that shares the most buckets with others, and a pivot, picked by a hash of
   bucket and document; each member is compared with the hubs and pivots of its buckets. A large group of near
   copies thus costs each member a few pairs, never all pairs, and the text that they are copies of, or the
   different pivots, tie the group together.
4. A pair is compared batch by batch of its signatures and dropped once the posterior probability of reaching
   the threshold is under ``MISS``. What survives is confirmed on the full shingle sets.
5. Connected components follow from the confirmed links. In buckets that still hold several components, the
   pairs across components that were not compared yet are verified in the same way, so no link is lost. In large
   buckets these pairs are found by a prefix filter: both sets hold a shingle that is among the rarest of each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import discard, materialise, slices, tidy
from nearfield.llm.hashing import kmers, mix, odd

SHINGLE = 4
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 80
BANDS, ROWS = 32, 5
BATCH = 32
#: Chosen probability of dropping a pair that reaches the threshold, for each look at its signatures.
MISS = 1e-6
#: Ids that may be broadcast to select rows; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: In buckets of more members pairs are found by rare shingles instead of made from the bucket.
LARGE = 24
#: How much larger sets of the next class of sizes are.
CLASS = 1.05
#: Shingles of at least so many sets count as frequent, and so many of them at most are sent to the workers.
FREQUENT, FREQUENT_MOST = 32, 1 << 17
# The bytes between words.
BLANKS = bytes([0x20, *range(0x09, 0x0E)])

_U = np.uint64
_SKETCH = "doc_id long, n_shingles long, ka long, kb long, bands array<long>, sig binary"


def shingle_sets(texts: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of all texts, how many each text has, and which of them are its first of their value."""
    hashes, count = kmers(texts, size, BLANKS, lower=True)
    own = hashes + mix(np.repeat(np.arange(len(count), dtype=_U), count) + _U(1))
    order = np.sort(own)
    repeated = np.unique(order[1:][order[1:] == order[:-1]])
    first = np.ones(len(own), bool)
    if len(repeated):
        at = np.flatnonzero(np.isin(own, repeated))
        by = at[np.argsort(own[at], kind="stable")]
        first[by[1:][own[by][1:] == own[by][:-1]]] = False
    return hashes, count, first


def sketch(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Size, a 128-bit key of the shingle set, band keys and 8-bit signature of each row."""
    n_hashes = BANDS * ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers, keys = odd(n_hashes, 23), odd(BANDS * ROWS, 29).reshape(BANDS, ROWS)
        for batch in batches:
            for part in slices(batch):
                hashes, count, first = shingle_sets(part["text"].to_pylist(), size)
                rows = np.flatnonzero(count)
                starts = (np.cumsum(count) - count)[rows]
                n, key = np.zeros(len(count), np.int64), np.zeros((2, len(count)), _U)
                least = np.zeros((len(rows), n_hashes), np.uint32)
                if len(rows):
                    n[rows] = np.add.reduceat(first.astype(np.int64), starts)
                    for i in range(2):
                        key[i, rows] = np.add.reduceat(mix(hashes + _U(101 + i)) * first.astype(_U), starts)
                    for j, c in enumerate(multipliers):
                        x = hashes * c
                        x ^= x >> _U(31)
                        x *= c
                        least[:, j] = np.minimum.reduceat((x >> _U(32)).astype(np.uint32), starts)
                bands = np.zeros((len(rows), BANDS), _U)
                for r in range(ROWS):
                    bands += mix(least.reshape(-1, BANDS, ROWS)[:, :, r].astype(_U) + keys[None, :, r]) * keys[None, :, r]
                bands = mix(bands)
                sig = (mix(least.astype(_U)) >> _U(56)).astype(np.uint8)
                offsets = np.concatenate(([0], np.cumsum(np.where(count > 0, BANDS, 0)))).astype(np.int32)
                sigs: list = [None] * len(count)
                for k, i in enumerate(rows.tolist()):
                    sigs[i] = sig[k].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array(n), pa.array(key[0].view(np.int64)), pa.array(key[1].view(np.int64)),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands.ravel().view(np.int64))), pa.array(sigs, pa.binary())],
                    names=["doc_id", "n_shingles", "ka", "kb", "bands", "sig"],
                )

    return docs.mapInArrow(tidy(run), _SKETCH)


def least_matches(n: int, percent: int = PERCENT, miss: float = MISS) -> int:
    """The fewest matches among n signature bytes with which a pair may still reach the threshold.

    With a uniform prior, the similarity s after m matches of n is Beta(m + 1, n - m + 1), and the probability
    that it reaches t is that of at most m successes in n + 1 trials of probability t. Bytes agree by chance
    once in 256 times, which is added to the threshold.
    """
    t = percent / 100
    t += (1 - t) / 256
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if total >= miss:
            return m
    return n + 1


def _survivors(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that pass all looks at their signatures, with the number of matches."""
    looks = [(n, least_matches(n, percent)) for n in range(BATCH, BANDS * ROWS + 1, BATCH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            alive, matches = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for n, least in looks:
                matches[alive] += (a[alive, n - BATCH : n] == b[alive, n - BATCH : n]).sum(1)
                alive = alive[matches[alive] >= least]
            kept = batch.select(["a", "b"]).take(pa.array(alive))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(matches[alive])], names=["a", "b", "m"])

    sig = reps.select("rep", "sig")
    rows = pairs.join(sig.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), "a")
    rows = rows.join(sig.select(F.col("rep").alias("b"), F.col("sig").alias("sb")), "b").select("a", "b", "sa", "sb")
    return rows.mapInArrow(tidy(run), "a long, b long, m long")


def select_rows(rows: DataFrame, ids: DataFrame, how: str, n_ids: int) -> DataFrame:
    """Semi or anti join on doc_id; few ids are broadcast, many are shuffled."""
    return rows.join(F.broadcast(ids) if n_ids <= BROADCAST_IDS else ids, "doc_id", how)


def _confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int, paths: list[str]) -> DataFrame:
    """Pairs (a, b) whose full shingle sets reach the threshold; both are read from their whole texts."""
    ids = materialise(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), paths)
    texts = select_rows(docs, ids, "left_semi", ids.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "ta"):
                sides = []
                for c in ("ta", "tb"):
                    hashes, count, first = shingle_sets(part[c].to_pylist(), size)
                    ends = np.cumsum(count)
                    sides.append([np.sort(hashes[e - n : e][first[e - n : e]]) for e, n in zip(ends, count, strict=True)])
                keep = []
                for x, y in zip(*sides, strict=True):
                    at = np.searchsorted(y, x)
                    both = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(x) and len(y) else 0
                    keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    rows = pairs.select("a", "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    rows = rows.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    return rows.mapInArrow(tidy(run), "a long, b long").distinct()


def connected_components(edges: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """node and comp (the least node it is connected with) of all nodes of edges (a, b).

    Alternates the large-star and small-star steps until the edges are stars; every step is a grouped minimum
    and a join, and each round is written before the next one reads it.
    """
    spark = edges.sparkSession
    old: list[str] = []
    edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), old)
    mark = None
    while True:
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        lows = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(lows, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lows, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new: list[str] = []
        edges = materialise(small.union(lows.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), new)
        row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(spark, old)
        old = new
        if tuple(row) == mark:
            break
        mark = tuple(row)
    if paths is not None:
        paths += old  # the caller drops the table once the result is written
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(roots)


def _renamed(labels: DataFrame | None, links: DataFrame, paths: list[str]) -> DataFrame:
    """Labels after components a and b of ``links`` are joined."""
    comps = connected_components(links, paths)
    if labels is None:
        return materialise(comps, paths)
    by = comps.select(F.col("node").alias("comp"), F.col("comp").alias("new"))
    moved = labels.join(by, "comp", "left").select("node", F.coalesce("new", "comp").alias("comp"))
    fresh = comps.join(labels, "node", "left_anti")
    return materialise(moved.union(fresh), paths)


def _labelled(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``pairs`` with the components ca and cb of both ends."""
    if labels is None:
        return pairs.withColumns({"ca": F.col("a"), "cb": F.col("b")})
    for end in ("a", "b"):
        named = labels.select(F.col("node").alias(end), F.col("comp").alias(f"c{end}"))
        pairs = pairs.join(named, end, "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
    return pairs


def components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (least doc_id reachable by links) of each row.

    Texts that are null or without words have no shingles and no links: their component is their own id. Rows
    with equal texts are linked; rows of one doc_id but different texts are taken as linked through it. Rows
    without a doc_id take part only by their equal texts. Extra columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    paths: list[str] = []
    rows = materialise(sketch(docs, size), paths)
    reps = rows.where("n_shingles > 0").groupBy("ka", "kb").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("bands", "sig"), "doc_id").alias("s"))
    reps = materialise(reps.where("rep is not null").select("ka", "kb", "rep", "s.bands", "s.sig"), paths)

    members = reps.select("rep", F.posexplode("bands").alias("band", "h")).select("rep", F.xxhash64("band", "h").alias("bucket"))
    order = F.struct(F.xxhash64("bucket", "rep").alias("o"), F.col("rep"))
    buckets = materialise(members.groupBy("bucket").agg(F.min(order)["rep"].alias("pivot"), F.count("*").alias("n")).where("n > 1"), paths)
    shared = materialise(members.join(buckets, "bucket"), paths)
    company = shared.groupBy("rep").agg(F.sum("n").alias("company"))
    hubs = shared.join(company, "rep").groupBy("bucket").agg(F.max_by("rep", F.struct("company", -F.col("rep"))).alias("hub"))
    shared = materialise(shared.join(hubs, "bucket"), paths)

    met = shared.select("rep", F.explode(F.array("pivot", "hub")).alias("other")).where("rep <> other")
    pairs = met.select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct()
    alike = materialise(_survivors(pairs, reps, percent), paths)
    # Most links are found by confirming each document's likeliest pair; only ends in different components go on.
    best = alike.groupBy("b").agg(F.max_by("a", F.struct("m", -F.col("a"))).alias("a"))
    labels = _renamed(None, materialise(_confirmed(best, docs, size, percent, paths), paths), paths)
    rest = _labelled(alike, labels).where("ca <> cb").join(best, ["a", "b"], "left_anti")
    labels = _linked(rest, docs, labels, size, percent, paths)

    labels = _across(shared, alike, reps, docs, labels, size, percent, paths)

    named = reps.select("ka", "kb", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("ka", "kb", F.coalesce("comp", "rep").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", "ka", "kb").join(named, ["ka", "kb"], "left")
    out = materialise(out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))
    discard(docs.sparkSession, paths)
    return out


def _across(shared: DataFrame, alike: DataFrame, reps: DataFrame, docs: DataFrame, labels: DataFrame, size: int, percent: int, paths: list[str]) -> DataFrame:
    """Labels after the pairs across components that share a bucket, but were not compared yet, are verified.

    Of a bucket's components all but the largest are paired with the rest of the bucket. Of large buckets only
    pairs are made that share one of the rarest shingles of each.
    """
    if not shared.where("n > 2").limit(1).count():
        return labels
    where = shared.where("n > 2").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    sizes = where.groupBy("bucket", "comp").agg(F.count("*").alias("k"))
    top = sizes.groupBy("bucket").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.count("*").alias("comps")).where("comps > 1")
    # Pivot and hub have met all others.
    left = materialise(where.where("rep <> pivot and rep <> hub").join(top, "bucket").select("bucket", "rep", "comp", "main", "n"), paths)
    other = (F.col("cx") != F.col("comp")) & ((F.col("comp") == F.col("main")) | (F.col("x") < F.col("rep")))

    few = left.where(F.col("n") <= LARGE)
    minor = few.where("comp <> main").select("bucket", F.col("rep").alias("x"), F.col("comp").alias("cx"))
    pairs = minor.join(few, "bucket").where(other).select("x", "rep")

    many = left.where(F.col("n") > LARGE).groupBy("rep", "comp").agg(F.bool_or(F.col("comp") != F.col("main")).alias("minor"))
    many = materialise(many, paths)
    if many.limit(1).count():
        pairs = pairs.union(_prefix_pairs(many, docs, size, percent, paths))
    pairs = pairs.select(F.least("x", "rep").alias("a"), F.greatest("x", "rep").alias("b")).distinct()
    found = materialise(_survivors(pairs.join(alike, ["a", "b"], "left_anti"), reps, percent), paths)
    return _linked(_labelled(found, labels), docs, labels, size, percent, paths)


def _counted(each: DataFrame) -> DataFrame:
    """s and held (the number of sets that have it) of the shingles of more than one set; batches are summed first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*map(pa.array, np.unique(np.asarray(batch["l"].flatten()), return_counts=True))], names=["s", "n"])

    return each.select("l").mapInArrow(tidy(run), "s long, n long").groupBy("s").agg(F.sum("n").alias("held")).where("held > 1")


def _frequent(held: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of (s, held), sorted, and the place of each in the order of (held, s).

    All from a power of two on, the least with which they are no more than ``FREQUENT_MOST``.
    """
    often = held.where(F.col("held") >= FREQUENT)
    least, total = None, 0
    for level, n in sorted(often.groupBy(F.floor(F.log2("held")).cast("int")).count().collect(), reverse=True):
        total += n
        if total > FREQUENT_MOST:
            break
        least = 1 << level
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    got = often.where(F.col("held") >= least).toArrow()
    s, n = (got[c].to_numpy() for c in ("s", "held"))
    place = np.empty(len(s), np.int64)
    place[np.lexsort((s, n))] = np.arange(len(s))
    by = np.argsort(s)
    return s[by], place[by]


def _parted(each: DataFrame, often: np.ndarray, place: np.ndarray, percent: int) -> DataFrame:
    """``each`` with its other shingles, the number of its frequent ones, and those of them that a prefix may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = np.asarray(batch["l"].flatten()), batch["l"].offsets.to_numpy()
            size = np.diff(offsets).astype(np.int64)
            row = np.repeat(np.arange(len(size)), size)
            at = np.minimum(np.searchsorted(often, flat), max(0, len(often) - 1))
            is_often = often[at] == flat if len(often) else np.zeros(len(flat), bool)
            n_often = np.bincount(row[is_often], minlength=len(size))
            # No fewer than the places in which a set must share a shingle with sets of the smallest class.
            smallest = -(-percent * size // 100)
            most = size - (percent * (size + smallest / CLASS**2) / (100 + percent)).astype(np.int64) + 2
            r, s = row[is_often], flat[is_often]
            by = np.lexsort((place[at[is_often]], r))
            r, s = r[by], s[by]
            need = np.arange(len(r)) - (np.cumsum(n_often) - n_often)[r] < (most - size + n_often)[r]
            lists = []
            for of, values in ((row[~is_often], flat[~is_often]), (r[need], s[need])):
                ends = np.cumsum(np.bincount(of, minlength=len(size)))
                lists.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(values)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["t"], batch["size"], lists[0], pa.array(n_often.astype(np.int64)), lists[1]], names=["doc_id", "t", "size", "others", "n_often", "often"])

    return each.mapInArrow(tidy(run), "doc_id long, t long, size long, others array<long>, n_often long, often array<long>")


def _prefix_pairs(members: DataFrame, docs: DataFrame, size: int, percent: int, paths: list[str]) -> DataFrame:
    """Pairs (x, rep) of ``members`` (rep, comp, minor) that may reach the threshold, of different components, one minor.

    A set's shingles are put in one order, rarest first. Two sets that reach the threshold share a shingle among
    the first ones of each, so many that what is left would not do; how many that is follows from both sizes, so
    sets are dealt to classes of about equal size, and the larger set of a pair looks into the classes of smaller
    ones. Copies of one text that are no links of each other differ from it by more than that, in shingles that
    few others have, so the shingles of the text itself, which all have, are not looked at. They come last in the
    order, so workers that know them put them there, and only the other shingles are joined with their counts.
    """
    ids = members.select(F.col("rep").alias("doc_id")).distinct()
    ids = materialise(ids, paths)
    texts = select_rows(docs, ids, "left_semi", ids.count()).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                hashes, count, first = shingle_sets(part["text"].to_pylist(), size)
                rows = np.flatnonzero(count)
                starts = (np.cumsum(count) - count)[rows]
                n, key = np.zeros(len(count), np.int64), np.zeros(len(count), _U)
                if len(rows):
                    n[rows] = np.add.reduceat(first.astype(np.int64), starts)
                    key[rows] = np.add.reduceat(mix(hashes + _U(101)) * first.astype(_U), starts)
                offsets = pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
                sets = pa.ListArray.from_arrays(offsets, pa.array(hashes[first].view(np.int64)))
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(key.view(np.int64)), pa.array(n), sets], names=["doc_id", "t", "size", "l"])

    each = materialise(texts.mapInArrow(tidy(run), "doc_id long, t long, size long, l array<long>").where("size > 0"), paths)
    own: list[str] = []
    held = materialise(_counted(each), own)
    parted = materialise(_parted(each, *_frequent(held), percent), own)
    others = parted.select("doc_id", "t", F.explode("others").alias("s")).join(held, "s")
    others = others.groupBy("doc_id", "t").agg(F.array_sort(F.collect_list(F.struct("held", "s")))["s"].alias("l"))
    sets = parted.drop("others").join(others, ["doc_id", "t"], "left").withColumn("l", F.coalesce("l", F.array().cast("array<long>")))
    # A set's shingles that no other has come first; they take places, but find nobody.
    sets = sets.withColumn("own", F.col("size") - F.size("l") - F.col("n_often")).where(100 * (F.col("size") - F.col("own")) >= percent * F.col("size"))
    sets = sets.withColumn("l", F.concat("l", "often")).drop("often", "n_often")
    sets = materialise(sets.withColumn("rep", F.col("doc_id")).join(members, "rep"), paths)
    discard(docs.sparkSession, own)

    of = lambda n: F.floor(F.log(n.cast("double")) / math.log(CLASS)).cast("int")
    low = lambda c: F.greatest(F.floor(F.pow(F.lit(CLASS), c) - 1e-6), F.lit(1)).cast("long")
    # Places in which a set must share a shingle with sets of a class: all but as many as the overlap needs, and one.
    places = lambda c: F.col("size") - F.ceil(percent * (F.col("size") + low(c)) / (100 + percent)) + 1

    def listed(rows: DataFrame, names: list[str]) -> DataFrame:
        n = F.greatest(F.lit(0), F.least(places(F.col("c")) - F.col("own"), F.size("l"))).cast("int")
        rows = rows.select("c", "doc_id", "comp", "minor", "size", "own", F.posexplode(F.slice("l", F.lit(1), n)).alias("p", "s"))
        left = F.col("size") - F.col("own") - F.col("p")  # shingles from this one on
        return rows.select("s", "c", *[F.col(c).alias(n) for c, n in zip(["doc_id", "comp", "minor", "size"], names, strict=False)], left.alias(names[4]))

    index = listed(sets.withColumn("c", of(F.col("size"))), ["rep", "comp", "minor", "size", "left"])
    smallest = F.ceil(percent * F.col("size") / 100)
    probe = listed(sets.withColumn("c", F.explode(F.sequence(of(smallest), of(F.col("size"))))), ["x", "cx", "mx", "sx", "lx"])
    larger = (F.col("sx") > F.col("size")) | ((F.col("sx") == F.col("size")) & (F.col("x") > F.col("rep")))
    enough = (100 + percent) * F.least("lx", "left") >= percent * (F.col("sx") + F.col("size"))
    return probe.join(index, ["s", "c"]).where((F.col("cx") != F.col("comp")) & (F.col("mx") | F.col("minor")) & larger & enough).select("x", "rep")


def _linked(pairs: DataFrame, docs: DataFrame, labels: DataFrame, size: int, percent: int, paths: list[str]) -> DataFrame:
    """Labels after the pairs (a, b, ca, cb) that are confirmed have joined their components."""
    pairs = materialise(pairs.select("a", "b", "ca", "cb"), paths)
    if not pairs.limit(1).count():
        return labels
    found = _confirmed(pairs, docs, size, percent, paths).join(pairs, ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    links = materialise(found.distinct(), paths)
    return _renamed(labels, links, paths) if links.limit(1).count() else labels


def deduplicate(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of each component, that of its least doc_id; all columns are kept.

    Rows without words stay, as they are linked with nothing, but of rows with one doc_id only one stays. Rows
    without a doc_id stay only if no row has an equal text and an id.
    """
    found = components(docs, size, percent)
    gone = materialise(found.where("component_id is not null and not (doc_id <=> component_id)").select("doc_id").where("doc_id is not null").distinct())
    kept = select_rows(docs, gone, "left_anti", gone.count())
    total, ids = found.where("doc_id is not null").agg(F.count("*"), F.countDistinct("doc_id")).first()
    if found.where("doc_id is null").limit(1).count():
        kept = kept.where("doc_id is not null")
    return kept.dropDuplicates(["doc_id"]) if total != ids else kept
