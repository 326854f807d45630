"""Tables that are written between steps, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder in ``spark.checkpoint.dir``. Only a local session without that setting gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        sc = spark.sparkContext
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="nearfield-")
        spark.conf.set("spark.checkpoint.dir", base)
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/nearfield-{uuid.uuid4().hex}"


def written(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Write a frame and read it again, which cuts its lineage.

    The path is appended to ``keep``, so that the caller can drop it with ``discard``.
    """
    path = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    if keep is not None:
        keep.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that are no longer read."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    paths.clear()
