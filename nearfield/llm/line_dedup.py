"""Repeated runs of lines, found in a suffix array over line ids and deleted but for their first copy.

Lines without words are passed over. A run is deleted where it has at least ``MIN_WORDS`` words and the same
run of lines stands at an earlier place (by doc_id, then line). Equivalently, a line goes exactly if it lies in
a shortest such run that starts, or ends, at some line; so runs need to be compared to that depth only.

1. Lines that occur once break every repeated run, so what is left of a document are segments of lines that
   occur again; segments of fewer words than a run needs are dropped.
2. Prefix doubling: a suffix's rank by its first 2**(k+1) lines is the order of the pair of ranks, by 2**k
   lines, of it and of the suffix 2**k lines on. Different pairs are sorted by range partitions, and their
   places in that order are the new ranks. Rounds end when no run is longer, which is after
   log2(MIN_WORDS) rounds at most, as each line has a word.
3. Suffixes that share the n lines of a shortest run form an interval of the suffix array with a longest common
   prefix of n lines or more. The interval is named by n and the ranks of the run's first and last 2**k lines.
   Its least place stays; the runs of all its other suffixes are deleted, and together they are the maximal runs.

Only DataFrame functions are used. All lists are of one document's lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield.llm.common import discard, materialise, partitions_for

MIN_WORDS = 50
#: Keys that hold more rows than one part in so many of a shuffle partition's even share are joined by broadcast.
HOT_PARTS = 4
_FIRST_ID = -(1 << 63)  # stands for a null doc_id, which comes first


def _lines(docs: DataFrame) -> DataFrame:
    """d and h (the document), i (line number), id (two 64-bit hashes) and w (words) of each line with words."""
    rows = docs.select("d", "h", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    words = F.size(F.regexp_extract_all("line", F.lit(r"\S+"), F.lit(0)))
    rows = rows.select("d", "h", "i", F.xxhash64("line").alias("x"), F.xxhash64(F.lit(1), "line").alias("y"), words.alias("w"))
    return rows.where("w > 0")


def _joined(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of ``table``, which has a row for each key, and n, how many of ``rows`` have it.

    A line may stand in a third of all documents. There are at most ``HOT_PARTS`` such keys for each shuffle
    partition, so their rows of the table are broadcast; the rest is joined by a shuffle.
    """
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    most = max(1, total // (HOT_PARTS * partitions_for(rows.sparkSession)))
    hot, cold = table.where(F.col("n") > most).drop("n"), table.where(F.col("n") <= most).drop("n")
    if not hot.limit(1).count():
        return rows.join(cold, keys)
    others = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return rows.join(F.broadcast(hot), keys).unionByName(others)


def _segments(lines: DataFrame, min_words: int, paths: list[str]) -> DataFrame:
    """Runs of repeated lines with enough words: line numbers, ids and words as lists."""
    numbered = lines.withColumn("j", F.row_number().over(Window.partitionBy("d", "h").orderBy("i")))
    many = materialise(lines.groupBy("x", "y").agg(F.count("*").alias("n")).where("n > 1"), paths)
    left = _joined(materialise(numbered, paths), many, ["x", "y"])
    left = left.withColumn("seg", F.col("j") - F.row_number().over(Window.partitionBy("d", "h").orderBy("j")))
    left = left.withColumn("sum", F.sum("w").over(Window.partitionBy("d", "h", "seg").orderBy("j")))
    segs = left.groupBy("d", "h", "seg").agg(F.array_sort(F.collect_list(F.struct("j", "i", "w", "sum", "x", "y"))).alias("l"))
    return segs.where(F.element_at("l", -1)["sum"] >= min_words)


def _shortest_runs(l: Column, min_words: int) -> Column:
    """s (first line) and n (lines) of the shortest runs with enough words that start, or end, at each line."""

    def starting(x: Column, i: Column) -> Column:
        short = F.filter(F.slice(l, i + 1, min_words), lambda y: y["sum"] - x["sum"] + x["w"] < min_words)
        return F.when(F.element_at(l, -1)["sum"] - x["sum"] + x["w"] >= min_words, F.struct(i.alias("s"), (F.size(short) + 1).alias("n")))

    def ending(x: Column, i: Column) -> Column:
        first = F.greatest(i - min_words + 1, F.lit(0))
        short = F.filter(F.slice(l, first + 1, i - first + 1), lambda y: x["sum"] - y["sum"] + y["w"] < min_words)
        n = F.size(short) + 1
        return F.when(x["sum"] >= min_words, F.struct((i - n + 1).alias("s"), n.alias("n")))

    both = F.concat(F.transform(l, starting), F.transform(l, ending))
    return F.array_distinct(F.filter(both, lambda x: x.isNotNull()))


def _ranked(keys: DataFrame, columns: list[str], paths: list[str]) -> DataFrame:
    """Different keys with their rank, which rises in the order of the keys (with gaps), and n, how often they occur.

    Range partitions that are sorted within hold the whole order, so row numbers that rise over partitions are
    ranks. They are written, so that a later read gets the same ones.
    """
    order = keys.groupBy(*columns).agg(F.count("*").alias("n")).repartitionByRange(*columns).sortWithinPartitions(*columns)
    return materialise(order.withColumn("rank", F.monotonically_increasing_id()), paths)


def _doubled(state: DataFrame, step: int, paths: list[str]) -> DataFrame:
    """``state`` with ranks by twice as many lines; past the end of a segment the second rank is -1."""
    pairs = F.transform("ranks", lambda r, i: F.struct(r.alias("a"), F.coalesce(F.get("ranks", i + step), F.lit(-1)).alias("b")))
    rows = materialise(state.select("d", "h", "seg", F.posexplode(pairs).alias("p", "r")).select("d", "h", "seg", "p", "r.a", "r.b"), paths)
    ranks = _ranked(rows, ["a", "b"], paths)
    new = _joined(rows, ranks, ["a", "b"]).groupBy("d", "h", "seg").agg(F.array_sort(F.collect_list(F.struct("p", "rank")))["rank"].alias("ranks"))
    return state.drop("ranks").join(new, ["d", "h", "seg"])


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Runs to delete: d, h (the document), lines (numbers of the run's lines), copies and the first copy's place.

    ``docs`` has d, h and text, with different (d, h) in each row.
    """
    old: list[str] = []
    segs = materialise(_segments(_lines(docs), min_words, old), old)
    flat = materialise(segs.select("d", "h", "seg", F.posexplode("l").alias("p", "e")).select("d", "h", "seg", "p", "e.x", "e.y"), old)
    flat = _joined(flat, _ranked(flat, ["x", "y"], old), ["x", "y"])
    first = flat.groupBy("d", "h", "seg").agg(F.array_sort(F.collect_list(F.struct("p", "rank")))["rank"].alias("ranks"))
    state = segs.select("d", "h", "seg", F.col("l.i").alias("at"), _shortest_runs(F.col("l"), min_words).alias("runs"))
    state = materialise(state.join(first, ["d", "h", "seg"]), old)
    longest = state.agg(F.max(F.array_max(F.transform("runs", lambda r: r["n"])))).first()[0] or 0

    found, step = None, 1
    while step <= longest:
        here = state.select("d", "h", "at", "ranks", F.explode(F.filter("runs", _between(step))).alias("r"))
        here = here.select(
            "d", "h", F.slice("at", F.col("r.s") + 1, F.col("r.n")).alias("lines"), F.col("r.n").alias("n"),
            F.get("ranks", F.col("r.s")).alias("a"), F.get("ranks", F.col("r.s") + F.col("r.n") - step).alias("b"),
        )
        found = here if found is None else found.unionByName(here)
        if 2 * step <= longest:
            state = materialise(_doubled(state.where(F.exists("runs", _at_least(2 * step))), step, old), old)
        step *= 2
    if found is None:
        return docs.sparkSession.createDataFrame([], "d long, h long, lines array<int>, copies long")
    found = materialise(found, old)
    place = F.struct("d", "h", F.element_at("lines", 1).alias("i"))
    intervals = found.groupBy("n", "a", "b").agg(F.min(place).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    intervals = materialise(intervals.select(F.col("n").alias("lcp"), "a", "b", "first", "copies", F.col("copies").alias("n")), old)
    later = _joined(found.withColumnRenamed("n", "lcp"), intervals, ["lcp", "a", "b"]).where(place != F.col("first"))
    later = materialise(later.select("d", "h", "lines", "copies"))
    discard(docs.sparkSession, old)
    return later


def _between(step: int):
    return lambda r: (r["n"] >= step) & (r["n"] < 2 * step)


def _at_least(n: int):
    return lambda r: r["n"] >= n


def deduplicate_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of ``docs`` with later copies of repeated runs cut from text, and n_lines and n_removed.

    Lines are parts between line feeds; n_lines counts all, n_removed those deleted. Null texts stay null, with
    0 lines; an empty text has one. A null doc_id comes before all others. Rows that are equal in doc_id and
    text count as one document. Columns named n_lines or n_removed are replaced.
    """
    kept = docs.drop("n_lines", "n_removed")
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST_ID)).alias("d"), F.xxhash64(F.col("text").cast("string")).alias("h")]
    runs = repeated_runs(docs.select(*key, F.col("text").cast("string").alias("text")).where("text is not null").dropDuplicates(["d", "h"]), min_words)
    gone = runs.select("d", "h", F.explode("lines").alias("i")).groupBy("d", "h").agg(F.collect_set("i").alias("gone"))
    rows = kept.select(F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("row"), *key, F.col("text").cast("string").alias("text"))
    rows = rows.join(gone, ["d", "h"], "left")
    lines = F.split("text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    rows = rows.select(
        "row", text.alias("new"), F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
    )
    rows = rows.select("row.*", "new", "n_lines", "n_removed").withColumn("text", F.col("new").cast(docs.schema["text"].dataType))
    if "n_chars" in kept.columns:
        n = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
        rows = rows.withColumn("n_chars", n.cast(docs.schema["n_chars"].dataType))
    return rows.select(*[F.col(f"`{c}`") for c in kept.columns], "n_lines", "n_removed")
