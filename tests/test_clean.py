import numpy as np
import pandas as pd

from millrace.operators import clean as cl
from pyspark.sql import functions as F


def test_sentinels_exact_spelling(spark):
    words = ["", "NA", "N/A", "null", "NULL", "None", "-", "--", " NA ", "na", "x"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    kept = [r["w"] for r in cl.null_sentinels(df).collect() if r["w"] is not None]
    assert sorted(kept) == sorted([" NA ", "na", "x"])


def test_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").toDF(" a", "b", "a ")
    out = cl.tidy_names(df)
    assert out.columns == ["a", "b"] and out.first()["a"] == 1


def test_cast_share(spark):
    rows = [(str(i), str(i) if i < 79 else "x", "1d" if i % 2 else "1e3", "NaN" if i == 0 else " 5 ", "2024-01-01" if i else "later") for i in range(100)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, day string")
    out, _ = cl.cast_texts(df)
    kinds = dict(out.dtypes)
    assert kinds["a"] == "double" and kinds["b"] == "string" and kinds["c"] == "string" and kinds["d"] == "double"
    assert kinds["day"] == "timestamp" and out.where("day is null").count() == 1
    assert out.where("d is null").count() == 1
    enough = spark.createDataFrame([(str(i) if i < 80 else "x",) for i in range(100)], "b string")
    assert dict(cl.cast_texts(enough)[0].dtypes)["b"] == "double"


def test_trend_needs_five(spark):
    rows = [(i, 2.0 * i + 1 if i < 5 else None, float(i) if i < 4 else None) for i in range(8)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    got = cl.trend_impute(df, ["a", "b"], ["id"], rows_per_range=3).orderBy("id").toPandas()
    assert np.allclose(got["a"], [2 * i + 1 for i in range(8)])
    assert got["b"].tolist() == [0, 1, 2, 3, 1.5, 1.5, 1.5, 1.5]


def test_mode(spark):
    df = spark.createDataFrame([("b", None), ("a", None), ("b", None), ("a", None), (None, None)], "t string, e string")
    got = cl.mode_impute(df).collect()
    assert [r["t"] for r in got].count("a") == 3 and all(r["e"] == "Unknown" for r in got)


def test_bins(spark):
    values = [1.0, 2.0, 3.0, 4.0]
    df = spark.createDataFrame([(v, 7.0) for v in values], "x double, k double")
    out = cl.quantile_bins(df, ["x", "k"], 4, number_suffix="_no").orderBy("x").collect()
    labels = pd.qcut(pd.Series(values), 4).astype(str).tolist()
    assert [r["x_bin"] for r in out] == labels
    assert [r["x_no"] for r in out] == [1, 2, 3, 4]
    assert all(r["k_bin"] is None for r in out)


def test_clean_runs_whole(spark):
    rows = [(i, f"{i % 7}.5" if i % 9 else "NA", "north" if i % 2 else None, 20.0 + i % 5, None) for i in range(60)]
    df = spark.createDataFrame(rows + rows, "id int, amount string, place string, temp double, void string")
    out, log = cl.clean(df, ["id"])
    assert out.count() == 60 and out.where("amount is null or place is null").count() == 0
    assert {"amount_bin", "temp_smooth"} <= set(out.columns) and "schema cast numeric amount" in log
    median, _ = cl.clean(df, ["id"], impute="median")
    assert "void" not in median.columns and median.where("place = 'Unknown'").count() == 30


def test_dedupe_key_keeps_first(spark):
    df = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (None, "c", 1), (None, "d", 2)], "k int, v string, o int")
    got = {(r["k"], r["v"]) for r in cl.dedupe(df, ["k"], ["o"]).collect()}
    assert got == {(1, "b"), (None, "c")}


def test_znorm(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "x double")
    got = [r["x_z"] for r in cl.znorm(df, ["x"]).orderBy("x").collect()]
    assert np.allclose(got, [-1, 0, 1])
    assert cl.znorm(df.withColumn("c", F.lit(4.0)), ["c"]).where("c_z = 0").count() == 3
