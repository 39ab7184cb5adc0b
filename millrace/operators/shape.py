"""Sort, top-k, buckets, samples and pivots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.names import quoted


def c(name: str) -> Column:
    return F.col(quoted(name))


def totals(df: DataFrame, category: str, metric: Column | None = None, label: str = "label") -> DataFrame:
    """Sum of a metric (missing as 0) or the row count per category; a missing category is its own group."""
    value = F.sum(F.coalesce(metric, F.lit(0.0))) if metric is not None else F.count("*").cast("double")
    return df.groupBy(c(category).cast("string").alias(label)).agg(value.alias("value"))


def top(groups: DataFrame, n: int, label: str = "label", value: str = "value") -> DataFrame:
    return groups.orderBy(F.col(value).desc(), F.col(label).asc_nulls_last()).limit(n)


def top_with_other(groups: DataFrame, n: int = 8, label: str = "label", value: str = "value") -> DataFrame:
    """The ``n`` largest groups and one row ``Other`` for the rest, if that is not zero."""
    window = Window.partitionBy(F.lit(0)).orderBy(F.col(value).desc(), F.col(label).asc_nulls_last())
    first = top(groups, n, label, value).withColumn("rank", F.row_number().over(window))
    marks = first.select(F.col(label).alias("_label"), "rank")
    # At most n rows on the small side.
    marked = groups.join(F.broadcast(marks), F.col(label).eqNullSafe(F.col("_label")), "left")
    is_top = F.col("rank").isNotNull()
    named = marked.select(
        F.when(is_top, F.col(label)).otherwise(F.lit("Other")).alias(label),
        F.coalesce("rank", F.lit(n + 1)).alias("rank"),
        value,
    )
    out = named.groupBy(label, "rank").agg(F.sum(value).alias(value))
    return out.where((F.col("rank") <= n) | (F.col(value) != 0)).select(label, value, "rank")


def repeatable_sample(df: DataFrame, n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """``n`` rows chosen by a hash of a unique key: the same rows in every run and layout."""
    order = F.md5(F.concat_ws("|", *[F.coalesce(c(k).cast("string"), F.lit("")) for k in key], F.lit(str(seed))))
    return df.orderBy(order, *[c(k) for k in key]).limit(n)


def pivot_mean(df: DataFrame, rows: Column, columns: Column, value: Column, limit: int = 24) -> DataFrame | None:
    """Mean per (row, column) value pair as a wide table; None above ``limit`` column values."""
    data = df.select(rows.alias("row"), columns.cast("string").alias("col"), value.alias("v"))
    seen = [r["col"] for r in data.select("col").where("col is not null").distinct().limit(limit + 1).collect()]
    if len(seen) > limit:
        return None
    return data.groupBy("row").pivot("col", sorted(seen)).agg(F.avg("v"))


def histogram(df: DataFrame, value: Column) -> DataFrame:
    """Equal-width bins, as many as min(40, max(10, sqrt(n)))."""
    data = df.select(value.cast("double").alias("v")).where("v is not null")
    row = data.agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if row["n"] < 5:
        return df.sparkSession.createDataFrame([], "bin int, lo double, hi double, n bigint")
    bins, lo = min(40, max(10, int(row["n"] ** 0.5))), row["lo"]
    width = (row["hi"] - lo) / bins
    number = F.least(F.floor((F.col("v") - lo) / width).cast("int"), F.lit(bins - 1)) if width else F.lit(0)
    counted = data.groupBy(number.alias("bin")).agg(F.count("*").alias("n"))
    return counted.select(
        F.col("bin").cast("int").alias("bin"),
        (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lo"),
        (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("hi"),
        "n",
    )


def append(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out
