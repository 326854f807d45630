"""Saved indexes: a folder of Parquet tables and a manifest that must fit when they are read again."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.operators.base import Index
from nearfield.operators.flat import FlatIndex
from nearfield.operators.hnsw import HnswIndex
from nearfield.operators.ivf import IvfIndex
from nearfield.operators.pq import IvfPqIndex, PqIndex

KINDS = {c.name: c for c in (FlatIndex, IvfIndex, HnswIndex, PqIndex, IvfPqIndex)}


def save(index: Index, path: str) -> None:
    """Write an index; kinds that have no saved form are an error."""
    if index.name not in KINDS:
        raise ValueError(f"{index.name} cannot be saved; {', '.join(KINDS)} can")
    spark = index.spark
    rows = index.rows
    width = rows.select(F.size("embedding")).first()
    rows.write.mode("overwrite").partitionBy(*(["list_id"] if index.name == "ivf" else [])).parquet(f"{path}/rows")
    if index.name in ("pq", "ivf_pq"):
        words = [(j, i, c.tolist()) for j, book in enumerate(index.books) for i, c in enumerate(book)]
        spark.createDataFrame(words, "part int, word int, v array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/books")
        index.codes.write.mode("overwrite").parquet(f"{path}/codes")
    if hasattr(index, "centers"):
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(index.centers)], "list_id int, center array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centers")
    if index.name == "hnsw":
        index.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    deleted = index.deleted if index.deleted is not None else spark.createDataFrame([], "id long")
    deleted.write.mode("overwrite").parquet(f"{path}/deleted")
    manifest = {"index": index.name, "dim": width[0] if width else 0, "params": index.params, "seed": index.seed}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load(spark: SparkSession, path: str, name: str, dim: int, **params) -> Index:
    """Read an index without building it; another kind, width or other parameters are an error."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    for what, want in (("index", name), ("dim", dim)):
        if manifest[what] != want:
            raise ValueError(f"saved {what} is {manifest[what]!r}, not {want!r}")
    other = {k: v for k, v in params.items() if manifest["params"].get(k) != v}
    if other:
        raise ValueError(f"saved with other parameters: {other}")
    index = KINDS[name](spark, manifest["params"], manifest["seed"])
    index.rows = spark.read.parquet(f"{path}/rows")
    if name == "ivf":
        index.rows = index.rows.withColumn("list_id", F.col("list_id").cast("int"))
    if name in ("ivf", "ivf_pq"):
        index.centers = np.array([r["center"] for r in spark.read.parquet(f"{path}/centers").orderBy("list_id").collect()])
    if name in ("pq", "ivf_pq"):
        words = spark.read.parquet(f"{path}/books").orderBy("part", "word").collect()
        index.books = np.array([r["v"] for r in words]).reshape(words[-1]["part"] + 1, words[-1]["word"] + 1, -1)
        index.codes = spark.read.parquet(f"{path}/codes")
    if name == "hnsw":
        index.nodes = spark.read.parquet(f"{path}/nodes")
    deleted = spark.read.parquet(f"{path}/deleted")
    index.deleted = deleted if deleted.limit(1).count() else None
    return index


def packed_tombstones(deleted: DataFrame) -> DataFrame:
    """bucket and bitmap of deleted ids: one bit an id, lowest first."""
    bucket = F.bitmap_bucket_number(F.col("id") + 1)
    return deleted.groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("id") + 1)).alias("bits"))


def unpacked_tombstones(packed: DataFrame) -> DataFrame:
    """Ids that ``packed_tombstones`` packed."""
    each = packed.select("bucket", F.posexplode(F.split(F.hex("bits"), "(?<=\\G..)")).alias("byte", "h")).where("h <> '00' and h <> ''")
    value = F.conv("h", 16, 10).cast("int")
    set_bits = F.array(*[F.when(value.bitwiseAND(F.lit(1 << b)) != 0, F.lit(b)) for b in range(8)])
    bits = each.select("bucket", "byte", F.explode(F.filter(set_bits, lambda b: b.isNotNull())).alias("bit"))
    per = 8 * 4096
    return bits.select(((F.col("bucket") - 1) * per + F.col("byte") * 8 + F.col("bit")).cast("long").alias("id"))
