"""Change sets and splits, by arithmetic on ids, so that any engine can repeat them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield.functions.vectors import normalize

# Multiplier, offset and modulus of the permutation that orders ids.
MULTIPLIER, OFFSET, MODULUS = 7919, 104729, 1_000_003


def mixed(id_column: Column, salt: int = 0) -> Column:
    return (id_column * MULTIPLIER + OFFSET * (salt + 1)) % MODULUS


def split(rows: DataFrame, every: int = 10) -> tuple[DataFrame, DataFrame]:
    """Queries (ids divisible by ``every``) and corpus (the rest); no row is in both."""
    held = F.col("id") % every == 0
    return rows.where(held).withColumnRenamed("id", "qid"), rows.where(~held)


def ranked(rows: DataFrame, salt: int = 0) -> DataFrame:
    """id and place (from 0) in the permuted order. Ids are ranked within ranges of the order, which are then
    stacked by their sizes, so no task sees all ids."""
    keyed = rows.select("id", mixed(F.col("id"), salt).alias("o")).withColumn("b", F.floor(F.col("o") * 256 / MODULUS).cast("int"))
    sizes = keyed.groupBy("b").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("b", before.alias("s"))  # at most 256 rows
    within = F.row_number().over(Window.partitionBy("b").orderBy("o", "id")) - 1
    return keyed.withColumn("r", within).join(F.broadcast(starts), "b").select("id", (F.col("r") + F.col("s")).cast("long").alias("place"))


def delete_set(rows: DataFrame, fraction: float, salt: int = 0) -> DataFrame:
    """Ids of the first ``fraction`` of the permuted rows: sets of one salt are nested."""
    n = rows.count()
    return ranked(rows, salt).where(F.col("place") < int(fraction * n)).select("id")


def update_set(rows: DataFrame, fraction: float = 0.1, salt: int = 1) -> DataFrame:
    """id and new embedding, normalize(0.6 * old + 0.8 * other), where other is the next row in permuted order."""
    n = rows.count()
    order = ranked(rows, salt)
    chosen = order.where(F.col("place") < int(fraction * n))
    other = order.select(F.col("id").alias("other_id"), F.col("place").alias("p"))
    pairs = chosen.join(other, F.col("p") == (F.col("place") + 1) % n)
    vectors = rows.select("id", F.col("embedding").alias("old")), rows.select(F.col("id").alias("other_id"), F.col("embedding").alias("new"))
    both = pairs.join(vectors[0], "id").join(vectors[1], "other_id")
    blend = F.zip_with("old", "new", lambda a, b: a.cast("double") * 0.6 + b.cast("double") * 0.8)
    return both.select("id", blend.alias("e")).select("id", normalize("e").alias("embedding"))


def renumbered(rows: DataFrame, fraction: float, salt: int = 2) -> DataFrame:
    """A sample in id order, numbered anew from 0, with the id it had (source_id)."""
    n = rows.count()
    picked = ranked(rows, salt).where(F.col("place") < int(fraction * n)).select("id")
    sample = rows.join(picked, "id", "left_semi")
    low, high = sample.agg(F.min("id"), F.max("id")).first()
    if low is None:
        return sample.withColumn("source_id", F.col("id"))
    width = max(1, -(-(high - low + 1) // 256))
    cell = F.floor((F.col("id") - low) / width).cast("int")
    sizes = sample.groupBy(cell.alias("b")).count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = sample.withColumn("b", cell).withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy("id")) - 1)
    numbered = numbered.join(F.broadcast(sizes.select("b", before.alias("s"))), "b").withColumn("source_id", F.col("id"))
    return numbered.withColumn("id", (F.col("r") + F.col("s")).cast("long")).drop("b", "r", "s")


def thresholds(rows: DataFrame, value: Column, shares: dict[str, float]) -> dict[str, float]:
    """For each name the value that a share of rows reaches, interpolated linearly."""
    names = list(shares)
    got = rows.agg(F.percentile(value, F.array(*[F.lit(1 - shares[n]) for n in names]))).first()[0]
    return dict(zip(names, got or [None] * len(names), strict=True))


#: Named filters: share of rows that pass. ``none`` passes all.
SHARES = {"top50": 0.5, "top10": 0.1, "top1": 0.01, "top01": 0.001}


def named_filter(name: str, value: Column, limits: dict[str, float]) -> Column | None:
    if name == "none":
        return None
    if name not in limits:
        raise ValueError(f"unknown filter {name!r}: none, {', '.join(limits)}")
    return value >= F.lit(limits[name])
