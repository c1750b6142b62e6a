"""The skew-safe scan equals a plain window, also with one hot group."""

import pandas as pd
from pyspark.sql import functions as F

from parlance.operators.ordered import first_by, grouped_scan, row_number_within


def _skewed(spark):
    # group 0 holds a third of the rows
    return spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 17 + 1).alias("g"),
        (F.rand(7) * 1000).cast("int").alias("v"), F.col("id"))


def test_rank_and_running_max_equal_window(spark):
    df = _skewed(spark)
    got = grouped_scan(df, ["g"], ["v", "id"], {"rn": ("count", None), "mx": ("max", "id"), "s": ("sum", "v")},
                       n_partitions=6).toPandas().sort_values("id").reset_index(drop=True)
    pdf = df.toPandas().sort_values(["g", "v", "id"])
    pdf["rn"] = pdf.groupby("g").cumcount() + 1
    pdf["mx"] = pdf.groupby("g")["id"].cummax()
    pdf["s"] = pdf.groupby("g")["v"].cumsum()
    exp = pdf.sort_values("id").reset_index(drop=True)
    pd.testing.assert_series_equal(got["rn"], exp["rn"], check_dtype=False, check_names=False)
    pd.testing.assert_series_equal(got["mx"], exp["mx"], check_dtype=False, check_names=False)
    pd.testing.assert_series_equal(got["s"], exp["s"], check_dtype=False, check_names=False)


def test_global_position(spark):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("k"))
    got = row_number_within(df, [], ["k"], out="pos", n_partitions=5).toPandas()
    assert (got.sort_values("k")["pos"].tolist()) == list(range(1, 501))


def test_first_by_keeps_earliest(spark):
    df = spark.createDataFrame([("x", 3, "c"), ("x", 1, "a"), ("y", 2, "b")], "k string, o int, v string")
    got = {r.k: (r.o, r.v) for r in first_by(df, ["k"], "o").collect()}
    assert got == {"x": (1, "a"), "y": (2, "b")}


def test_cut_key_is_the_row_at_the_position(spark):
    import random

    from parlance.operators import splits

    rng = random.Random(1)
    rows = [(rng.choice([None, 0, 1, 1, 1, 2]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g int, i int").repartition(5)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for at in (1, 2, 1499, 2999, 3000):
        assert tuple(splits.cut_key(df, ["g", "i"], at, few=50)) == ordered[at - 1]
    same = spark.createDataFrame([(7,)] * 200, "k int")
    assert tuple(splits.cut_key(same, ["k"], 100, few=10)) == (7,)
    got = splits.head_split(df, ["g", "i"], 0.9)
    assert got.where("split = 'train'").count() == 2700
    assert "Exchange rangepartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    assert splits.head_split(df.limit(0), ["g", "i"]).count() == 0
