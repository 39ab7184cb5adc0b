"""Live tables: register decoding, the rolling buffer, latest values, alerts and trends.

Device reads are outside this library: a collector lands rows of raw registers as files, which are read as a
stream. Times are event times; late rows are cut off by the watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.ordering import row_index
from millrace.operators.windows import last_rows, trend_slope
from millrace.session import drop_folder

# Register name -> (address, scale).
REGISTERS = {
    "temperature": (0, 0.1),
    "vibration": (1, 0.001),
    "pressure": (2, 0.1),
    "smps_voltage": (3, 0.1),
    "smps_current": (4, 0.01),
    "speed": (5, 1.0),
    "torque": (6, 0.1),
    "rul": (7, 1.0),
    "failure": (8, 1.0),
    "load": (9, 0.1),
}
METRICS = list(REGISTERS) + ["voltage", "current"]
POLL = "5 seconds"


def as_stream(
    spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet", per_trigger: int = 64, fmt: str = "parquet"
) -> DataFrame:
    """Files landed in a folder as a stream, a bounded number of them per batch."""
    reader = spark.readStream.schema(schema).format(fmt).option("pathGlobFilter", pattern)
    return reader.option("maxFilesPerTrigger", per_trigger).load(folder)


def decode(raw: DataFrame, registers: Mapping[str, tuple[int, float]] = REGISTERS) -> DataFrame:
    """Rows (timestamp, source, device, registers array) to named values; works on batches and streams.

    A register's value is raw * scale, rounded to six places; the failure flag becomes 0 or 1.
    """
    start = min(address for address, _ in registers.values())
    out = [F.col(n) for n in ("timestamp", "source", "device") if n in raw.columns]
    for name, (address, scale) in registers.items():
        value = F.get(F.col("registers"), F.lit(address - start)).cast("double") * F.lit(float(scale))
        flag = F.when(value > 0, 1.0).when(value.isNotNull(), 0.0)
        out.append((flag if name == "failure" else F.round(value, 6)).alias(name))
    return raw.select(*out)


def append_buffer(stream: DataFrame, folder: str, checkpoint: str, once: bool = True, delay: str = "10 minutes", key=("device", "timestamp")):
    """Append decoded rows to a table partitioned by day; a repeated row is written once."""
    unique = stream.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(list(key))
    daily = unique.withColumn("day", F.to_date("timestamp"))
    writer = daily.writeStream.format("parquet").partitionBy("day").option("path", folder).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=POLL)
    return writer.outputMode("append").start()


def read_buffer(spark: SparkSession, folder: str, rows: int | None = None, tie: tuple[str, ...] = ("device",)) -> DataFrame:
    """The buffer table; `rows` is a retention rule that keeps the newest ones on reading, by default all."""
    df = spark.read.parquet(folder).drop("day")
    return df if rows is None else last_rows(df, rows, ["timestamp", *tie])


def expired_days(buffer: DataFrame, keep_days: int) -> DataFrame:
    """Day partitions a retention job may drop."""
    newest = buffer.agg(F.max("day").alias("newest")).first()["newest"]
    return buffer.select("day").distinct().where(F.col("day") < F.date_sub(F.lit(newest), keep_days))


def latest_values(df: DataFrame, entity: str, time: str, tie: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Latest value of every tag per machine; the same aggregation on a batch and on a stream."""
    columns = columns or [c for c in METRICS if c in df.columns]
    rank = F.struct(time, *([tie] if tie else []))
    values = [F.col(c) for c in columns]
    kept = df.groupBy(entity).agg(F.max_by(F.struct(F.col(time), *values), rank).alias("_last"))
    return kept.select(entity, "_last.*")


def alert_test(vibration: Column, mean: Column) -> Column:
    return vibration > mean * 1.5 + 0.1


def exact_mean(name: str) -> Column:
    """The mean by a decimal sum, so it hangs on no order of the rows; values that fit into none are averaged as they are."""
    value, exact = F.col(name), F.col(name).try_cast("decimal(38,12)")
    return F.when(F.count(exact) == F.count(value), F.sum(exact).cast("double") / F.nullif(F.count(value), F.lit(0))).otherwise(F.avg(value))


def alerts(df: DataFrame, entity: str, time: str, tie: str, window: str = "1 day") -> DataFrame:
    """(entity, window start, latest vibration, mean, spike, failed) per event-time window.

    One aggregation gives the window's mean and its latest row, so it runs unchanged on a watermarked stream.
    """
    rank = F.struct(time, tie)
    grouped = df.groupBy(F.window(time, window).alias("w"), F.col(entity)).agg(
        exact_mean("vibration").alias("mean_vibration"),
        F.max_by(F.struct("vibration", "failure"), rank).alias("last"),
        F.count("*").alias("rows"),
    )
    return grouped.select(
        F.col("w.start").alias("window_start"), F.col(entity), "rows",
        F.col("last.vibration").alias("vibration"), "mean_vibration",
        F.coalesce(alert_test(F.col("last.vibration"), F.col("mean_vibration")), F.lit(False)).alias("spike"),
        F.coalesce(F.col("last.failure") >= 1, F.lit(False)).alias("failed"),
    )


def start_alerts(stream: DataFrame, entity: str, time: str, tie: str, folder: str, checkpoint: str, window: str = "1 day", delay: str = "1 hour", once: bool = True):
    """Write finished windows with a spike or a failure to an alert table."""
    found = alerts(stream.withWatermark(time, delay), entity, time, tie, window).where("spike or failed")
    writer = found.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=POLL)
    return writer.outputMode("append").start()


# Parts of a keyed state; a batch rewrites those that its rows belong to.
PARTS = 64


def _manifests(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches whose states are complete and still there, ascending."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    found = [s.getPath() for s in files.listStatus(path)]
    done = [p.getName() for p in found if p.getName().startswith("at=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(n[3:]) for n in done)


def _pointers(spark: SparkSession, folder: str, number: int) -> dict[int, int]:
    """Which batch wrote each part of a state; at most as many rows as parts."""
    return {r["part"]: r["batch"] for r in spark.read.parquet(f"{folder}/at={number}").collect()}


def _parts(spark: SparkSession, folder: str, pointers: Mapping[int, int]) -> DataFrame | None:
    paths = [f"{folder}/batch={b}/part={p}" for p, b in sorted(pointers.items())]
    return spark.read.parquet(*paths) if paths else None


def read_latest(spark: SparkSession, folder: str) -> DataFrame:
    """What a job of this module has kept up to date in a folder."""
    done = _manifests(spark, folder)
    state = _parts(spark, folder, _pointers(spark, folder, done[-1])) if done else None
    if state is None:
        raise ValueError(f"nothing has been written to {folder} yet")
    return state


def _upsert(stream: DataFrame, folder: str, checkpoint: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame], once: bool, key: str | None = None, parts: int = PARTS):
    """Merge every batch into the table kept in a folder; nothing but part numbers passes through the driver.

    The state lies in parts by a hash of the key, or in one without a key. A batch reads and writes the parts of its own rows,
    beside the former ones, and then a list of all parts: readers and repeated batches see a whole state. The state before
    stays until the next batch; what only older lists name is deleted.
    """
    part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int") if key else F.lit(0)

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            touched = [r["part"] for r in batch.select(part.alias("part")).distinct().collect()]
            done = [n for n in _manifests(spark, folder) if n < number]
            before = _pointers(spark, folder, done[-1]) if done else {}
            if touched:
                old = _parts(spark, folder, {p: b for p, b in before.items() if p in touched})
                merge(old, batch).withColumn("part", part).write.mode("overwrite").partitionBy("part").parquet(f"{folder}/batch={number}")
            now = {**before, **dict.fromkeys(touched, number)}
            if now:
                listed = spark.createDataFrame([(p, b) for p, b in now.items()], "part int, batch long")
                listed.coalesce(1).write.mode("overwrite").parquet(f"{folder}/at={number}")
            _forget(spark, folder, done, before, now)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=POLL)).start()


def _forget(spark: SparkSession, folder: str, done: list[int], before: Mapping[int, int], now: Mapping[int, int]) -> None:
    """Delete the lists older than the last one, and the parts that only they name."""
    kept = {*before.items(), *now.items()}
    for number in done[:-1]:
        for p, b in set(_pointers(spark, folder, number).items()) - kept:
            drop_folder(spark, f"{folder}/batch={b}/part={p}")
        drop_folder(spark, f"{folder}/at={number}")
    named = {b for _, b in kept}
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path):
        name = s.getPath().getName()
        if name.startswith("batch=") and int(name[6:]) not in named:
            drop_folder(spark, f"{folder}/{name}")


def start_latest(stream: DataFrame, entity: str, time: str, tie: str, folder: str, checkpoint: str, once: bool = True, parts: int = PARTS):
    """Keep the latest values per machine as a table of one row for each."""
    columns = [c for c in METRICS if c in stream.columns]

    def merge(state: DataFrame | None, batch: DataFrame) -> DataFrame:
        both = batch.select(entity, time, tie, *columns)
        if state is not None:
            both = both.unionByName(state)
        rank = F.struct(time, tie)
        return both.groupBy(entity).agg(F.max_by(F.struct(time, tie, *columns), rank).alias("_last")).select(entity, "_last.*")

    return _upsert(stream, folder, checkpoint, merge, once, entity, parts)


def start_trend(stream: DataFrame, value: str, order_by: list[str], folder: str, checkpoint: str, last: int = 50, once: bool = True):
    """Keep the slope over the newest rows up to date; between batches only those rows are kept, beside the figures."""

    def merge(state: DataFrame | None, batch: DataFrame) -> DataFrame:
        rows = batch.select(*order_by, value).where(F.col(value).isNotNull())
        if state is not None:
            rows = rows.unionByName(state.select(F.explode("_rows").alias("r")).select("r.*"))
        newest = last_rows(rows, last, order_by)
        # At most `last` rows are gathered.
        kept = newest.agg(F.collect_list(F.struct(*order_by, value)).alias("_rows"))
        # One row on either side.
        return trend_slope(newest, value, order_by).join(kept)

    return _upsert(stream, folder, checkpoint, merge, once)


def recent_trend(buffer: DataFrame, value: str, order_by: list[str], last: int = 50) -> DataFrame:
    """Slope over the newest rows of the buffer."""
    return trend_slope(buffer, value, order_by, last)


def recent_forecast(buffer: DataFrame, value: str, order_by: list[str], last: int = 500, steps: int = 24) -> DataFrame:
    """(step, yhat): the least-squares line through the newest known values, carried on."""
    known = last_rows(buffer.where(F.col(value).isNotNull()).select(*order_by, value), last, order_by)
    at, y = F.col("_at").cast("double"), F.col(value).cast("double")
    line = row_index(known, order_by, "_at").agg(F.regr_slope(y, at).alias("a"), F.regr_intercept(y, at).alias("b"), F.count("*").alias("n"))
    ahead = line.select("a", "b", "n", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    return ahead.select(F.col("step").cast("long").alias("step"), (F.col("b") + F.col("a") * (F.col("n") - 1 + F.col("step"))).alias("yhat"))


def insights(df: DataFrame, entity: str, time: str, tie: str) -> DataFrame:
    """(entity, seq, line): what a right-hand rail would say about every machine."""
    latest = latest_values(df, entity, time, tie).alias("l")
    means = df.groupBy(entity).agg(exact_mean("vibration").alias("mean_v"), F.count("*").alias("rows"))
    both = latest.join(means, entity)
    spike = F.format_string("Vibration spike %.3f (mean %.3f): inspect bearings.", "vibration", "mean_v")
    calm = F.format_string("Vibration %.3f within recent envelope.", "vibration")
    lines = F.array_compact(F.array(
        F.format_string("Buffer %d rows", "rows"),
        F.when(F.col("vibration").isNotNull(), F.when(alert_test(F.col("vibration"), F.col("mean_v")), spike).otherwise(calm)),
        F.when(F.col("temperature").isNotNull(), F.format_string("Temperature %.2f", "temperature")),
        F.when(F.col("failure") >= 1, F.lit("Failure flag 1 on the latest packet: open a maintenance ticket.")),
    ))
    return both.select(entity, F.posexplode(lines).alias("seq", "line"))


