"""Reading the test tables as corpora, preparing vectors, checking data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield.functions.vectors import dot, norm, normalize


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, embedding, label and views (an arithmetic stand-in for a popularity count) of ``embeddings``."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.col("vec_id").alias("id"), "embedding", "label", ((F.col("vec_id") * 7919) % 10007).alias("views"))


def prepared(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """Vectors scaled to unit length, once; later code never scales again."""
    return rows.withColumn(column, normalize(column))


def full_sort(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """qid, rank and id by plain expressions: every row scored and sorted. For a few queries, to check other searches."""
    pairs = corpus.select("id", "embedding").crossJoin(F.broadcast(queries.select("qid", F.col("embedding").alias("q"))))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("id"))
    scored = pairs.select("qid", "id", dot("q", "embedding").alias("score")).withColumn("rank", F.row_number().over(order))
    return scored.where(F.col("rank") <= k).select("qid", "rank", "id")


def verified(corpus: DataFrame, queries: DataFrame, truth: DataFrame | None = None, k: int = 10, sorted_queries: int = 5) -> DataFrame:
    """check and ok: the properties that searches rely on.

    The truth of ``sorted_queries`` queries is held against a full sort.
    """

    def one(rows: DataFrame, name: str, ok: Column) -> DataFrame:
        return rows.agg(F.coalesce(ok, F.lit(True)).alias("ok")).select(F.lit(name).alias("check"), "ok")

    width = F.min(F.size("embedding")) == F.max(F.size("embedding"))
    unit = F.max(F.abs(norm("embedding") - 1)) < 1e-5
    checks = [
        one(corpus, "corpus has rows", F.count("*") > 0),
        one(queries, "queries has rows", F.count("*") > 0),
        one(corpus, "corpus ids are unique", F.count("*") == F.countDistinct("id")),
        one(corpus, "corpus vectors have one length", width),
        one(queries, "query vectors have one length", width),
        one(corpus, "corpus vectors are unit vectors", unit),
        one(queries, "query vectors are unit vectors", unit),
        one(corpus.join(queries.select(F.col("qid").alias("id")), "id", "left_semi"), "no query is in the corpus", F.count("*") == 0),
    ]
    if truth is not None:
        per = truth.groupBy("qid").agg(F.count("*").alias("n"), F.countDistinct("id").alias("d"))
        checks.append(one(per, "truth has k rows a query", F.min("n") == k))
        checks.append(one(per, "truth ids are unique in a query", F.bool_and(F.col("n") == F.col("d"))))
        few = queries.orderBy("qid").limit(sorted_queries)
        wanted = full_sort(few, corpus, k).withColumn("sorted", F.lit(True))
        both = wanted.join(truth.join(few.select("qid"), "qid", "left_semi").select("qid", "rank", "id", F.lit(True).alias("given")), ["qid", "rank", "id"], "full")
        checks.append(one(both, "truth is a full sort", F.bool_and(F.col("sorted").isNotNull() & F.col("given").isNotNull())))
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out
