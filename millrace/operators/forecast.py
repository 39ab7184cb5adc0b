"""Trend and season forecast: changepoint hinges and Fourier terms in one ridge regression on the cluster."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import checkpoint

CHANGEPOINTS = 25
# Prior scales as in the usual additive model: trend 5, changepoints 0.05, seasons 10.
TREND_SCALE, HINGE_SCALE, SEASON_SCALE = 5.0, 0.05, 10.0
DAY = 86_400.0
INTERVAL = 1.2816  # 80 % of a normal


def daily_last(df: DataFrame, time: Column, value: Column, tie: Column) -> DataFrame:
    """(ds, y): the last row of every timestamp."""
    points = df.select(time.alias("ds"), value.cast("double").alias("y"), tie.alias("tie"))
    points = points.where("ds is not null and y is not null")
    return points.groupBy("ds").agg(F.max_by("y", "tie").alias("y"))


def step_seconds(points: DataFrame) -> float | None:
    """The constant distance of the timestamps, or None when they are irregular."""
    t = F.unix_micros("ds")
    row = points.agg(F.min(t).alias("a"), F.max(t).alias("b"), F.count("*").alias("n")).first()
    if row["n"] < 3 or (row["b"] - row["a"]) % (row["n"] - 1):
        return None
    step = (row["b"] - row["a"]) // (row["n"] - 1)
    odd = points.where((F.unix_micros("ds") - F.lit(row["a"])) % F.lit(step) != 0).limit(1).count()
    return None if odd else step / 1e6


def _terms(seconds: Column, start: float, span: float, step: float | None) -> dict[str, Column]:
    scaled = (seconds - F.lit(start)) / F.lit(span)
    terms = {"trend": scaled * TREND_SCALE}
    for i in range(1, CHANGEPOINTS + 1):
        at = 0.8 * i / (CHANGEPOINTS + 1)
        terms[f"hinge{i}"] = F.greatest(scaled - F.lit(at), F.lit(0.0)) * HINGE_SCALE
    seasons = []
    if span >= 730 * DAY:
        seasons.append(("year", 365.25 * DAY, 10))
    if span >= 14 * DAY and (step is None or step < 7 * DAY):
        seasons.append(("week", 7 * DAY, 3))
    if span >= 2 * DAY and (step is None or step < DAY):
        seasons.append(("day", DAY, 4))
    for name, period, order in seasons:
        for k in range(1, order + 1):
            angle = seconds * F.lit(2.0 * math.pi * k / period)
            terms[f"{name}_sin{k}"] = F.sin(angle) * SEASON_SCALE
            terms[f"{name}_cos{k}"] = F.cos(angle) * SEASON_SCALE
    return terms


def forecast(points: DataFrame, periods: int | None = None, step: float | None = None) -> DataFrame:
    """(ds, yhat, yhat_lower, yhat_upper) for the periods after the last point of (ds, y).

    The default horizon is 90 steps, 90 * 24 for hourly or minutely series; irregular series step by day.
    """
    spark = points.sparkSession
    found = step_seconds(points)
    step = step or found or DAY
    periods = periods or (90 * 24 if found in (3600.0, 60.0) else 90)
    seconds = F.unix_micros("ds") / F.lit(1e6)
    x = F.unix_micros("ds") / F.lit(1e6)
    row = points.agg(
        F.count("*").alias("n"), F.min(x).alias("a"), F.max(x).alias("b"), F.max(F.abs("y")).alias("top"),
        F.var_pop("y").alias("var"), F.corr("y", x).alias("r"),
    ).first()
    if row["n"] < 10:
        raise ValueError(f"need at least 10 dated rows, have {row['n']}")
    span = max(row["b"] - row["a"], step)
    top = row["top"] or 1.0
    variance = row["var"] / top**2
    r = row["r"] if row["r"] is not None and not math.isnan(row["r"]) else 0.0
    noise = max(variance * (1.0 - r * r), 1e-8)
    names = list(_terms(seconds, row["a"], span, found))

    def features(frame: DataFrame) -> DataFrame:
        terms = _terms(F.unix_micros("ds") / F.lit(1e6), row["a"], span, found)
        return VectorAssembler(inputCols=names, outputCol="features").transform(frame.withColumns(terms))

    train = features(points.withColumn("label", F.col("y") / F.lit(top)))
    model = LinearRegression(
        solver="normal", standardization=False, elasticNetParam=0.0,
        regParam=noise * math.sqrt(max(variance, 1e-12)) / row["n"],
    ).fit(train.select("features", "label"))
    sigma = model.summary.rootMeanSquaredError * top
    last = dt.datetime.fromtimestamp(row["b"], dt.timezone.utc)
    start = int(last.timestamp() * 1e6)
    future = spark.range(1, periods + 1, numPartitions=1).select(
        F.timestamp_micros(F.lit(start) + F.col("id") * F.lit(int(step * 1e6))).alias("ds")
    )
    yhat = F.col("prediction") * F.lit(top)
    return model.transform(features(future)).select(
        "ds", yhat.alias("yhat"), (yhat - INTERVAL * sigma).alias("yhat_lower"), (yhat + INTERVAL * sigma).alias("yhat_upper")
    )


def outlook(points: DataFrame, target: str, periods: int | None = None) -> DataFrame:
    """One row: last value, forecast at the horizon, relative change and the sentence for the reader."""
    ahead = forecast(points, periods).agg(F.max_by("yhat", "ds").alias("forecast"), F.max("ds").alias("until"))
    last = points.agg(F.max_by("y", "ds").alias("last")).first()["last"]
    pct = F.when(F.lit(last == 0), F.lit(0.0)).otherwise((F.col("forecast") - F.lit(last)) / F.lit(abs(last) or 1.0) * 100)
    direction = F.when(pct >= 0, "increase").otherwise("decrease")
    text = F.format_string(
        "%s will %s %.1f%% in 90 days (last=%.3f, forecast=%.3f).",
        F.lit(target), direction, F.abs(pct), F.lit(float(last)), F.col("forecast"),
    )
    return ahead.select(F.lit(float(last)).alias("last"), "forecast", "until", pct.alias("pct"), text.alias("sentence"))


def forecast_by_series(points: DataFrame, key: str, periods: int = 30) -> DataFrame:
    """(key, ds, yhat, yhat_lower, yhat_upper): each series of (key, ds date, y) carried on by its own straight line.

    One aggregation fits all series; the band is that of the residuals. Series with fewer than three points are left out.
    """
    day = F.datediff("ds", F.lit("1970-01-01")).cast("double")
    line = points.where("ds IS NOT NULL AND y IS NOT NULL").groupBy(key).agg(
        F.regr_slope("y", day).alias("a"), F.regr_intercept("y", day).alias("b"), F.regr_sxx("y", day).alias("sxx"),
        F.regr_syy("y", day).alias("syy"), F.count("*").alias("n"), F.max("ds").alias("last"),
    ).where("n >= 3 AND sxx > 0")
    sigma = F.sqrt(F.greatest(F.col("syy") - F.col("a") * F.col("a") * F.col("sxx"), F.lit(0.0)) / F.col("n"))
    ahead = line.select("*", sigma.alias("sigma"), F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("step"))
    ds = F.date_add("last", F.col("step"))
    yhat = F.col("b") + F.col("a") * F.datediff(ds, F.lit("1970-01-01"))
    return ahead.select(key, ds.alias("ds"), yhat.alias("yhat"), (yhat - INTERVAL * F.col("sigma")).alias("yhat_lower"), (yhat + INTERVAL * F.col("sigma")).alias("yhat_upper"))


# Terms of a series by date: one, trend, hinges, then sines and cosines of the year and of the week.
YEAR, WEEK = 10, 3
WIDTH = 2 + CHANGEPOINTS + 2 * (YEAR + WEEK)
# Rows of series that one task sums; longer series are cut into parts of as many.
ROWS_PER_TASK = 200_000
LEAST_POINTS = 10


def date_terms(day: np.ndarray, first: np.ndarray, last: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(rows, WIDTH): terms of each date (days since 1970) of a series of `n` points from `first` to `last`.

    The year needs two years of dates, the week two weeks with less than a week between dates; the terms of others are 0.
    """
    span = np.maximum(last - first, 1.0)
    scaled = (day - first) / span
    out = np.zeros((len(day), WIDTH))
    out[:, 0], out[:, 1] = 1.0, scaled * TREND_SCALE
    at = 0.8 * np.arange(1, CHANGEPOINTS + 1) / (CHANGEPOINTS + 1)
    out[:, 2 : 2 + CHANGEPOINTS] = np.maximum(scaled[:, None] - at, 0.0) * HINGE_SCALE
    place = 2 + CHANGEPOINTS
    dense = span / np.maximum(n - 1, 1) < 7
    for period, order, known in ((365.25, YEAR, span >= 730), (7.0, WEEK, (span >= 14) & dense)):
        angle = (day * 2.0 * math.pi / period)[:, None] * np.arange(1, order + 1)
        out[:, place : place + order] = np.sin(angle) * SEASON_SCALE * known[:, None]
        out[:, place + order : place + 2 * order] = np.cos(angle) * SEASON_SCALE * known[:, None]
        place += 2 * order
    return out


def seasonal_by_series(points: DataFrame, key: str, periods: int = 30, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(key, ds, yhat, yhat_lower, yhat_upper): each series of (key, ds date, y) by its own trend, year and week.

    The fit is that of `forecast`: a ridge regression on changepoint hinges and Fourier terms. Its normal equations are summed
    over parts of the rows and solved for many keys at a time, so neither a long series nor many short ones meet in one task.
    Series with fewer than LEAST_POINTS dated values are left out; several values of a date all count.
    """
    day = F.datediff("ds", F.lit("1970-01-01")).cast("double")
    known = points.where("ds IS NOT NULL AND y IS NOT NULL").select(F.col(key).alias("key"), day.alias("day"), F.col("y").cast("double").alias("y"))
    known = known.where("key IS NOT NULL AND NOT isnan(y)")
    facts = known.groupBy("key").agg(
        F.count("*").alias("n"), F.min("day").alias("first"), F.max("day").alias("last"), F.max(F.abs("y")).alias("top"),
        F.var_pop("y").alias("variance"), F.corr("y", "day").alias("r"),
    )
    facts = checkpoint(facts.where(F.col("n") >= LEAST_POINTS))
    total = facts.agg(F.sum("n").alias("n"), F.count("*").alias("keys")).first()
    kind = known.schema["key"].dataType.simpleString()
    buckets = max(1, math.ceil((total["n"] or 0) / rows_per_task), math.ceil(total["keys"] / 5000))
    parts = F.ceil(F.col("n") / F.lit(rows_per_task))
    rows = known.join(facts, "key").withColumn("part", F.when(parts > 1, F.pmod(F.xxhash64("key", "day", "y"), parts)).otherwise(F.lit(-1)))
    rows = rows.withColumn("place", F.when(F.col("part") < 0, F.pmod(F.xxhash64("key"), F.lit(buckets))).otherwise(F.xxhash64("key")))

    def sums(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["key", "day", "y"], kind="stable")
        names, begin = np.unique(frame["key"].to_numpy(), return_index=True)
        edges, out = [*begin.tolist(), len(frame)], []
        columns = {c: frame[c].to_numpy(float) for c in ("day", "y", "first", "last", "n", "top")}
        for a, b in zip(edges, edges[1:]):
            square, cross, own = np.zeros((WIDTH, WIDTH)), np.zeros(WIDTH), 0.0
            for s in range(a, b, 20_000):
                some = {c: v[s : min(b, s + 20_000)] for c, v in columns.items()}
                x, y = date_terms(some["day"], some["first"], some["last"], some["n"]), some["y"] / np.where(some["top"] > 0, some["top"], 1.0)
                square, cross, own = square + x.T @ x, cross + x.T @ y, own + float(y @ y)
            out.append((square[np.triu_indices(WIDTH)].tobytes(), cross.tobytes(), own))
        return pd.DataFrame({"key": names, "square": [o[0] for o in out], "cross": [o[1] for o in out], "own": [o[2] for o in out]})

    part = rows.groupBy("place", "part").applyInPandas(sums, f"key {kind}, square binary, cross binary, own double")
    solved = part.join(facts, "key").withColumn("place", F.pmod(F.xxhash64("key"), F.lit(buckets)))

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["key", "own", "square"], kind="stable").reset_index(drop=True)
        names, begin = np.unique(frame["key"].to_numpy(), return_index=True)
        upper = np.add.reduceat(np.stack([np.frombuffer(s) for s in frame["square"]]), begin)
        cross = np.add.reduceat(np.stack([np.frombuffer(s) for s in frame["cross"]]), begin)
        own = np.add.reduceat(frame["own"].to_numpy(), begin)
        n, first, last, top, variance, r = (frame[c].to_numpy(float)[begin] for c in ("n", "first", "last", "top", "variance", "r"))
        top = np.where(top > 0, top, 1.0)
        square = np.zeros((len(names), WIDTH, WIDTH))
        i, j = np.triu_indices(WIDTH)
        square[:, i, j] = square[:, j, i] = upper
        noise = np.maximum(variance / top**2 * (1.0 - np.nan_to_num(r) ** 2), 1e-8)
        held = square + noise[:, None, None] * np.diag([0.0] + [1.0] * (WIDTH - 1))
        w = np.linalg.solve(held, cross[:, :, None])[:, :, 0]
        error = own - 2 * (w * cross).sum(1) + np.einsum("ki,kij,kj->k", w, square, w)
        sigma = np.sqrt(np.maximum(error, 0.0) / n) * top
        ahead = np.tile(np.arange(1, periods + 1), len(names))
        at = np.repeat(np.arange(len(names)), periods)
        days = last[at] + ahead
        yhat = (date_terms(days, first[at], last[at], n[at]) * w[at]).sum(1) * top[at]
        ds = (np.datetime64("1970-01-01") + days.astype(int)).astype(object)
        return pd.DataFrame({"key": names[at], "ds": ds, "yhat": yhat, "yhat_lower": yhat - INTERVAL * sigma[at], "yhat_upper": yhat + INTERVAL * sigma[at]})

    ahead = solved.groupBy("place").applyInPandas(solve, f"key {kind}, ds date, yhat double, yhat_lower double, yhat_upper double")
    return ahead.withColumnRenamed("key", key)
