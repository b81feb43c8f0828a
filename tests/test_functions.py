import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from basketspark.functions import by_group_size, entropy, exact_quantiles, number_rows, rnd, scan, with_blocks


def test_rnd_is_half_up(spark):
    row = spark.sql("select 0.125D a, 2.675D b, -1.005D c").select(rnd("a", 2), rnd("b", 2), rnd("c", 1)).first()
    assert tuple(row) == (0.13, 2.68, -1.0)


def test_entropy_known_values(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("a", 1), ("b", 7)], "k string, m int")
    got = {r["k"]: r["e"] for r in entropy(df, ["k"], "m", "e").collect()}
    assert got == {"a": 1.5, "b": 0.0}
    assert str(got["b"]) == "0.0"


@pytest.mark.parametrize("blocked", [False, True])
@pytest.mark.parametrize("exclusive", [False, True])
def test_scan_equals_cumulative(spark, blocked, exclusive):
    rnd_ = random.Random(3)
    rows = [(rnd_.choice("xxxy"), i, rnd_.randint(-5, 5)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, o int, v int").repartition(7)
    src = with_blocks(df, ["g"], ["o"]) if blocked else df
    if blocked:
        # many blocks, although the test data would fit one
        src = src.withColumn("_blk", F.col("_blk") * 1000 + (F.col("o") / 17).cast("int"))
    out = scan(src, ["g"], ["o"], {"s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v")}, exclusive=exclusive)
    got = out.select("g", "o", "s", "lo", "hi").toPandas().sort_values(["g", "o"], ignore_index=True)
    want = pd.DataFrame(rows, columns=["g", "o", "v"]).sort_values(["g", "o"], ignore_index=True)
    by = want.groupby("g")["v"]
    want["s"], want["lo"], want["hi"] = by.cumsum(), by.cummin(), by.cummax()
    if exclusive:
        want[["s", "lo", "hi"]] = want.groupby("g")[["s", "lo", "hi"]].shift(1)
        want["s"] = want["s"].fillna(0)
    for c in ("s", "lo", "hi"):
        assert np.array_equal(got[c].astype(float), want[c].astype(float), equal_nan=True)


def test_by_group_size_takes_both_routes(spark):
    rows = [("hot", i, 1) for i in range(300)] + [(f"g{i % 20}", i, 1) for i in range(100)]
    df = spark.createDataFrame(rows, "g string, o int, v int")
    step = lambda d: scan(d, ["g"], ["o"], {"s": ("sum", "v")})
    got = by_group_size(df, ["g"], ["o"], step, max_group_rows=50)
    assert got.columns == ["g", "o", "v", "s"]
    want = step(df)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_number_rows_is_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(9)
    got = number_rows(df, ["k"], "n").orderBy("k").collect()
    assert [r["n"] for r in got] == list(range(1000))


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 400), "x": np.round(rng.exponential(10, 400), 1)})
    pdf.loc[pdf.index % 3 == 0, "x"] = 4.0
    df = spark.createDataFrame(pdf).repartition(6)
    qs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = exact_quantiles(df, "x", qs, ["g"], [f"q{i}" for i in range(6)]).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        assert np.allclose(got.loc[g].to_numpy(dtype=float), np.quantile(part["x"], qs))
    one = exact_quantiles(df, "x", [0.5]).first()[0]
    assert one == pytest.approx(pdf["x"].median())
