import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions.random import SplitMix64
from nearfield.functions.text import cache_key, normalized
from nearfield.functions.vectors import block_scores, dot, norm, normalize, score, sequential_score, squared_l2


def test_splitmix():
    # First outputs of the public generator for two seeds.
    assert SplitMix64(42).next_u64() == 13679457532755275413
    assert SplitMix64(0).next_u64() == 16294208416658607535
    g = SplitMix64(7)
    assert all(0 <= g.next_f64() < 1 for _ in range(100)) and len(set(g.distinct_below(50, 50))) == 50
    with pytest.raises(ValueError):
        g.distinct_below(2, 3)


def test_vectors(spark):
    a, b = [1.0, 2.0, -3.0], [0.5, -1.0, 4.0]
    row = spark.createDataFrame([(a, b)], "a array<float>, b array<float>").select(dot("a", "b").alias("d"), squared_l2("a", "b").alias("l"), norm("a").alias("n"), normalize("a").alias("u"), score("a", "b", "l2").alias("s")).first()
    x, y = np.array([a]), np.array([b])
    assert row["d"] == sequential_score(x, y)[0] == -13.5 and row["s"] == -row["l"] == sequential_score(x, y, "l2")[0]
    assert abs(block_scores(x, y, "l2")[0, 0] + row["l"]) < 1e-9 and abs(np.linalg.norm(row["u"]) - 1) < 1e-12
    with pytest.raises(ValueError):
        score("a", "b", "cosine")


def test_text(spark):
    import hashlib

    row = spark.createDataFrame([("  Hello \n\t World ",)], "t string").select(normalized(F.col("t")).alias("n"), cache_key(F.col("t"), "m", "v1").alias("k")).first()
    assert row["n"] == "hello world" and row["k"] == hashlib.sha256(b"hello world|m|v1").hexdigest()


def test_rounded_keeps_signs(spark):
    from nearfield.functions.vectors import rounded

    given = [-1e-7, -0.0, 0.0, 1e-7, -0.0000015, 0.0000015, 0.1234565, -7.0, None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, x double")
    got = [r["y"] for r in rows.select("i", rounded("x", 6).alias("y")).orderBy("i").collect()]
    assert str(got) == "[-0.0, -0.0, 0.0, 0.0, -2e-06, 2e-06, 0.123457, -7.0, None]"
