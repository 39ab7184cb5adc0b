import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import ordering
from millrace.operators.ordering import row_index, trailing
from millrace.operators.quantiles import exact_quantiles
from millrace.operators.windows import change_over, mean_over, std_over, step_over


def table(spark, n=400, hot=False):
    rng = random.Random(5)
    rows = [(i, "hot" if hot and i % 3 == 0 else f"k{rng.randint(0, 5)}", rng.randint(0, 20), rng.uniform(-5, 5)) for i in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "id int, key string, tie int, x double")


@pytest.mark.parametrize("size", [3, 7, 50, 10_000])
def test_trailing_equals_single_task(spark, size):
    df = table(spark)
    made = {"m": mean_over("x", 5), "s": std_over("x", 5), "d": step_over("x")}
    got = trailing(df, made, 4, ["tie", "id"], rows_per_range=size).toPandas().sort_values(["tie", "id"])
    want = got["x"].reset_index(drop=True)
    assert np.allclose(got["m"].to_numpy(), want.rolling(5, min_periods=1).mean())
    assert np.allclose(got["s"].to_numpy(float), want.rolling(5, min_periods=1).std(), equal_nan=True)
    assert np.allclose(got["d"].to_numpy(float), want.diff(), equal_nan=True)
    assert len(got) == 400


def test_hot_group_is_split(spark):
    df = table(spark, 300, hot=True)
    got = trailing(df, {"m": mean_over("x", 6)}, 5, ["id"], ["key"], rows_per_range=10).toPandas().sort_values(["key", "id"])
    want = got.groupby("key")["x"].rolling(6, min_periods=1).mean().to_numpy()
    assert np.allclose(got["m"].to_numpy(), want)


def test_index_is_dense(spark):
    df = table(spark)
    for size in (3, 40, 10_000):
        got = row_index(df, ["tie", "id"], "at", size).toPandas().sort_values(["tie", "id"])
        assert got["at"].tolist() == list(range(400))


def test_nulls_sort_first(spark):
    df = spark.createDataFrame([(1, None), (2, 3.0), (3, None), (4, 1.0)], "id int, x double")
    got = row_index(df, ["x", "id"], "at", 1).orderBy("id").toPandas()
    assert got["at"].tolist() == [0, 3, 1, 2]


def test_change_and_single_value(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 4.0), (3, 6.0)], "id int, x double")
    got = trailing(df, {"c": change_over("x"), "s": std_over("x", 5)}, 4, ["id"]).orderBy("id").collect()
    assert [r["c"] for r in got] == [None, None, 0.5]
    assert got[0]["s"] is None


def test_quantiles_by_narrowing(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(0, 1, 3000), np.full(1500, 0.25), rng.exponential(50, 500)])
    df = spark.createDataFrame(pd.DataFrame({"x": values, "c": np.full(5000, 2.0)}))
    probs = [0.0, 0.1, 0.25, 0.5, 0.6, 0.9, 0.999, 1.0]
    got = exact_quantiles(df, {"x": F.col("x"), "c": F.col("c")}, probs, small=20)
    assert np.allclose(got["x"], np.quantile(values, probs))
    assert got["c"] == [2.0] * len(probs)
    assert exact_quantiles(df.where("x is null"), {"x": F.col("x")}, [0.5])["x"] == [None]


def test_more_ranges_than_one_task_sums(spark, monkeypatch):
    """More ranges than one task sums, of three rows: sizes are summed in blocks, and ranges need the tails of several others."""
    monkeypatch.setattr(ordering, "RANGES_PER_BLOCK", 16)
    n = 300
    df = spark.range(n).select((F.col("id") * 7919 % n).alias("id"), (F.col("id") % 17).cast("double").alias("x"))
    placed = row_index(df, ["id"], "at", 3)
    assert placed.where("at != id").count() == 0 and placed.count() == n
    got = trailing(df, {"m": mean_over("x", 8), "d": step_over("x")}, 7, ["id"], rows_per_range=3).toPandas().sort_values("id")
    want = df.toPandas().sort_values("id")["x"].reset_index(drop=True)
    assert np.allclose(got["m"], want.rolling(8, min_periods=1).mean())
    assert np.allclose(got["d"], want.diff(), equal_nan=True)


def test_odd_columns_pass_through(spark):
    df = spark.createDataFrame([(i, float(i), "a") for i in range(40)], "`my id` int, `x.y` double, `__at` string").withColumn("nothing", F.lit(None))
    got = row_index(df, ["my id"], "at", 5).orderBy("at").collect()
    assert [r["at"] for r in got] == list(range(40)) and got[3]["nothing"] is None and got[3]["x.y"] == 3.0


@pytest.mark.parametrize("sums", [4096, 8])
def test_small_ranges_are_cut_out_of_few_tasks(spark, monkeypatch, sums):
    monkeypatch.setattr(ordering, "MOST_TASKS", 3)
    monkeypatch.setattr(ordering, "RANGES_PER_BLOCK", sums)
    df = table(spark)
    cut = ordering.ranged(df, ["tie", "id"], 58, 7)
    assert len(cut.rows.inputFiles()) <= 3
    sizes = [r["__size"] for r in cut.sizes.orderBy("__number").collect()]
    assert max(sizes) <= 7 and sum(sizes) == 400 and len(sizes) >= 58
    got = trailing(df, {"m": mean_over("x", 5)}, 4, ["tie", "id"], rows_per_range=7).toPandas().sort_values(["tie", "id"])
    assert np.allclose(got["m"].to_numpy(), got["x"].rolling(5, min_periods=1).mean())
    at = row_index(df, ["tie", "id"], "at", 7).toPandas().sort_values(["tie", "id"])
    assert at["at"].tolist() == list(range(400))
