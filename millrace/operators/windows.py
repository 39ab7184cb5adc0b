"""Window and order-sensitive operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.names import quoted
from millrace.operators.ordering import row_index, trailing


def c(name: str) -> Column:
    return F.col(quoted(name))


def x(name: str) -> Column:
    return c(name).cast("double")


def mean_over(name: str, rows: int):
    return lambda w: F.avg(x(name)).over(w.rowsBetween(-(rows - 1), 0))


def std_over(name: str, rows: int):
    """Sample deviation of the frame; NULL while it holds a single value."""
    return lambda w: F.stddev_samp(x(name)).over(w.rowsBetween(-(rows - 1), 0))


def step_over(name: str):
    return lambda w: x(name) - F.lag(x(name)).over(w)


def change_over(name: str):
    """Relative change from the previous row; NULL when that was 0."""
    return lambda w: F.try_divide(x(name) - F.lag(x(name)).over(w), F.lag(x(name)).over(w))


def rolling(df: DataFrame, columns: dict, back: int, order_by: Sequence[str], partition_by: Sequence[str] = (), **kw):
    return trailing(df, columns, back, order_by, partition_by, **kw)


def latest(df: DataFrame, order_by: Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    """The last row of the table, or of every group; an aggregate with map-side combine, not a window."""
    whole = F.struct(*[c(n) for n in df.columns])
    rank = F.struct(*[c(n) for n in order_by])
    kept = df.groupBy(*[quoted(p) for p in partition_by]).agg(F.max_by(whole, rank).alias("_row"))
    return kept.where(F.col("_row").isNotNull()).select("_row.*")


def last_rows(df: DataFrame, n: int, order_by: Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    """The last ``n`` rows; per group the row number limit is applied before the shuffle by the optimizer."""
    newest = [c(o).desc_nulls_last() for o in order_by]
    if not partition_by:
        return df.orderBy(*newest).limit(n)
    window = Window.partitionBy(*[quoted(p) for p in partition_by]).orderBy(*newest)
    return df.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= n).drop("_rank")


def trend_slope(df: DataFrame, value: str, order_by: Sequence[str], last: int | None = None) -> DataFrame:
    """Least-squares slope of a column over row position, over the last rows or the whole table."""
    known = df.where(c(value).isNotNull()).select(*[c(n) for n in dict.fromkeys([*order_by, value])])
    if last:
        known = last_rows(known, last, order_by)
    indexed = row_index(known, order_by, "_at")
    return indexed.agg(
        F.regr_slope(x(value), F.col("_at").cast("double")).alias("slope"),
        F.count("*").alias("points"),
        F.max_by(x(value), F.col("_at")).alias("last_value"),
    )


def last_per_time(df: DataFrame, time: str, order_by: Sequence[str]) -> DataFrame:
    """Keep the last row of every timestamp."""
    return latest(df, order_by, [time])


def series(df: DataFrame, time: Column, value: Column) -> DataFrame:
    """Sum per hour (span up to three days) or day, empty periods as 0; means if every sum is 0."""
    points = df.select(time.alias("t"), value.alias("v")).where("t is not null and v is not null")
    span = points.agg(F.min("t").alias("lo"), F.max("t").alias("hi")).first()
    if span["lo"] is None:
        return df.sparkSession.createDataFrame([], "period timestamp, value double, n bigint")
    unit = "hour" if (span["hi"] - span["lo"]).total_seconds() <= 3 * 86400 else "day"
    sums = points.groupBy(F.date_trunc(unit, "t").alias("p")).agg(
        F.sum("v").alias("total"), F.avg("v").alias("mean"), F.count("*").alias("n")
    )
    bounds = points.agg(F.date_trunc(unit, F.min("t")).alias("a"), F.date_trunc(unit, F.max("t")).alias("b"))
    calendar = bounds.select(F.explode(F.sequence("a", "b", F.expr(f"interval 1 {unit}"))).alias("period"))
    joined = calendar.join(sums, calendar["period"] == sums["p"], "left")
    any_sum = sums.agg(F.sum("total").alias("s")).first()["s"]
    shown = F.coalesce("total", F.lit(0.0)) if any_sum else F.col("mean")
    return joined.select("period", shown.alias("value"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def extremes(df: DataFrame, group: str, metric: str) -> DataFrame:
    """Leading and lagging group of a grouped table, with a name tie-break."""
    name = c(group).cast("string")
    return df.agg(
        F.max_by(name, F.struct(x(metric), name)).alias("leader"),
        F.max(x(metric)).alias("leader_value"),
        F.min_by(name, F.struct(x(metric), name)).alias("laggard"),
        F.min(x(metric)).alias("laggard_value"),
    )


def first_seen(df: DataFrame, text: str, order_by: Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    """Drop texts that repeat an earlier one apart from blanks and case. Their 128-bit hashes travel, not the texts."""
    key = F.md5(F.lower(F.trim(F.regexp_replace(c(text), r"\s+", " "))))
    keyed = df.withColumn("_key", key)
    rank = F.struct(*[c(o) for o in order_by])
    whole = F.struct(*[c(n) for n in df.columns])
    kept = keyed.groupBy(*[quoted(p) for p in partition_by], "_key").agg(F.min_by(whole, rank).alias("_row"))
    return kept.select("_row.*")


def describe_recent(df: DataFrame, value: str, order_by: Sequence[str], last: int = 200) -> DataFrame:
    """(statistic, value): count, mean, deviation, smallest and largest of the newest known values."""
    known = df.where(c(value).isNotNull()).select(*[c(n) for n in dict.fromkeys([*order_by, value])])
    v = x(value)
    stats = {"count": F.count(v).cast("double"), "mean": F.avg(v), "stddev": F.stddev_samp(v), "min": F.min(v), "max": F.max(v)}
    one = last_rows(known, last, order_by).agg(*[s.alias(n) for n, s in stats.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("statistic"), F.col(n).alias("value")) for n in stats])))
