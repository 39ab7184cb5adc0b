import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.sources import tabular as tab
from millrace.streaming import live


def write(path, text):
    path.write_text(text)
    return str(path)


def test_text_files(spark, tmp_path):
    csv = write(tmp_path / "a.csv", "timestamp,v,name\n2024-01-01 00:00:00,1.5,x\nbad,2,y\n")
    df = tab.read_table(spark, csv)
    assert dict(df.dtypes) == {"timestamp": "timestamp", "v": "double", "name": "string"}
    assert df.where("timestamp is null").count() == 1
    tsv = write(tmp_path / "a.tsv", "a\tb\n1\tx,y\n")
    assert tab.read_table(spark, tsv).first()["b"] == "x,y"
    js = write(tmp_path / "a.json", '[{"a": 1, "b": "x"}, {"a": 2, "b": null}]')
    assert tab.read_table(spark, js).count() == 2


def test_save_and_load(spark, tmp_path):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1))], "id int, at timestamp")
    saved = tab.save_tables({"clean_df": df, "none": None, "empty": df.where("id > 5")}, str(tmp_path / "s"))
    assert list(saved) == ["clean_df"]
    assert tab.load_tables(spark, saved)["clean_df"].dtypes == df.dtypes


def test_kpi_file(spark, tmp_path):
    kpis = spark.createDataFrame([("Rows", 2.0)], "kpi string, value double")
    tab.write_kpis(kpis, str(tmp_path / "k"))
    assert spark.read.option("header", True).csv(str(tmp_path / "k")).first()["kpi"] == "Rows"
    tab.write_kpis(kpis.where("value > 9"), str(tmp_path / "n"))
    assert spark.read.option("header", True).csv(str(tmp_path / "n")).first()["kpi"] == "(none)"


def test_excel_needs_schema(spark):
    with pytest.raises(ValueError):
        tab.read_table(spark, "book.xlsx")


REGISTERS = "timestamp timestamp, source string, device string, registers array<int>"


def raw(spark, rows):
    return spark.createDataFrame([(dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m), "plc", d, r) for m, d, r in rows], REGISTERS)


def test_decode(spark):
    got = live.decode(raw(spark, [(0, "M1", [755, 512, 50, 2400, 123, 1500, 33, 90, 7, 400]), (1, "M1", [755, 512])])).orderBy("timestamp").collect()
    assert (got[0]["temperature"], got[0]["vibration"], got[0]["smps_current"], got[0]["failure"], got[0]["load"]) == (75.5, 0.512, 1.23, 1.0, 40.0)
    assert got[1]["temperature"] == 75.5 and got[1]["failure"] is None and got[1]["load"] is None


def test_stream_counts_repeats_once(spark, tmp_path):
    rows = [(m, f"M{m % 2}", [700, 100 + 1000 * (m == 9), 50, 2400, 100, 1500, 30, 90, int(m == 8), 400]) for m in range(10)]
    landed = str(tmp_path / "landed")
    raw(spark, rows).write.parquet(landed)
    raw(spark, rows[:4]).write.mode("append").parquet(landed)
    stream = live.decode(live.as_stream(spark, landed, raw(spark, []).schema, per_trigger=1))
    out = str(tmp_path / "buffer")
    live.append_buffer(stream, out, str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(out).count() == 10
    assert live.read_buffer(spark, out, 3).count() == 3
    # A second run finds nothing new.
    live.append_buffer(stream, out, str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(out).count() == 10

    buffer = live.read_buffer(spark, out, None)
    latest = {r["device"]: r for r in live.latest_values(buffer, "device", "timestamp").collect()}
    assert latest["M1"]["vibration"] == 1.1 and latest["M0"]["failure"] == 1.0
    found = {r["device"]: (r["spike"], r["failed"]) for r in live.alerts(buffer, "device", "timestamp", "source").collect()}
    assert found == {"M0": (False, True), "M1": (True, False)}
    lines = [r["line"] for r in live.insights(buffer, "device", "timestamp", "source").collect()]
    assert any("spike 1.100" in x for x in lines) and any("Failure flag" in x for x in lines)


def test_late_rows_are_cut(spark, tmp_path):
    landed = str(tmp_path / "landed")
    base = [700, 100, 50, 2400, 100, 1500, 30, 90, 1, 400]
    for i, minutes in enumerate(([0, 10], [60 * 30], [5], [60 * 60])):
        raw(spark, [(m, "M1", base) for m in minutes]).coalesce(1).write.mode("append").parquet(landed)
    stream = live.decode(live.as_stream(spark, landed, raw(spark, []).schema, per_trigger=1))
    live.start_alerts(stream, "device", "timestamp", "source", str(tmp_path / "alerts"), str(tmp_path / "st"), once=True).awaitTermination()
    got = {str(r["window_start"])[:10]: r["rows"] for r in spark.read.parquet(str(tmp_path / "alerts")).collect()}
    # Day one closed before the straggler came; the last day is still open.
    assert got["2024-01-01"] in (2, 3) and "2024-01-02" in got and "2024-01-03" not in got


def test_latest_stream_equals_batch(spark, tmp_path):
    rows = [(m, f"M{m % 3}", [700 + m] * 10) for m in range(30)]
    landed = str(tmp_path / "landed")
    kept, state = str(tmp_path / "kept"), str(tmp_path / "state")
    batch = live.latest_values(live.decode(raw(spark, rows)), "device", "timestamp", "source")
    with pytest.raises(ValueError):
        live.read_latest(spark, kept)
    # Landed and read in two goes; the second run goes on from the first.
    for part in (rows[:17], rows[17:]):
        raw(spark, part).write.mode("append").parquet(landed)
        stream = live.decode(live.as_stream(spark, landed, raw(spark, []).schema, per_trigger=1))
        live.start_latest(stream, "device", "timestamp", "source", kept, state).awaitTermination()
    assert sorted(map(str, live.read_latest(spark, kept).drop("source").collect())) == sorted(map(str, batch.collect()))


def test_trend_stream_equals_batch(spark, tmp_path):
    rows = [(m, "M1", [700 + (m * 7) % 13, 100 + (m * 5) % 11, 50, 2400, 100, 1500, 30, 90, 0, 400]) for m in range(40)]
    landed, kept, state = (str(tmp_path / n) for n in ("landed", "kept", "state"))
    for part in (rows[:25], rows[25:]):
        raw(spark, part).write.mode("append").parquet(landed)
        stream = live.decode(live.as_stream(spark, landed, raw(spark, []).schema, per_trigger=1))
        live.start_trend(stream, "vibration", ["timestamp"], kept, state, last=20).awaitTermination()
    want = live.recent_trend(live.decode(raw(spark, rows)), "vibration", ["timestamp"], 20).first()
    got = live.read_latest(spark, kept).first()
    assert got["points"] == want["points"] == 20 and abs(got["slope"] - want["slope"]) < 1e-12 and got["last_value"] == want["last_value"]


def test_expired_days(spark):
    days = spark.createDataFrame([(dt.date(2024, 1, d),) for d in range(1, 11)], "day date")
    assert live.expired_days(days, 7).count() == 2
    assert days.where(F.col("day").isNull()).count() == 0


def test_polling_runs_by_the_clock_and_rewrites_touched_parts_only(spark, tmp_path):
    """The 5 s trigger runs again and again until it is stopped; a batch leaves other parts alone, and old states go."""
    landed, kept, state = (str(tmp_path / n) for n in ("landed", "kept", "state"))
    first = [(m, f"M{m}", [700 + m] * 10) for m in range(12)]
    raw(spark, first).coalesce(1).write.mode("append").parquet(landed)
    stream = live.decode(live.as_stream(spark, landed, raw(spark, []).schema, per_trigger=1))
    query = live.start_latest(stream, "device", "timestamp", "source", kept, state, once=False, parts=8)
    try:
        query.processAllAvailable()
        files = lambda: {str(p.relative_to(kept)) for p in (tmp_path / "kept").rglob("*.parquet") if "batch=" in str(p)}
        one = files()
        assert live.read_latest(spark, kept).count() == 12
        for turn in range(4):  # one machine at a time
            raw(spark, [(100 + turn, "M3", [900 + turn] * 10)]).coalesce(1).write.mode("append").parquet(landed)
            query.processAllAvailable()
        runs = [p for p in query.recentProgress if p["numInputRows"]]
        starts = [dt.datetime.fromisoformat(p["timestamp"].replace("Z", "+00:00")) for p in runs]
        assert len(runs) >= 5 and all((b - a).total_seconds() >= 4.9 for a, b in zip(starts, starts[1:]))
    finally:
        query.stop()
    assert not query.isActive
    got = {r["device"]: r["temperature"] for r in live.read_latest(spark, kept).collect()}
    assert len(got) == 12 and got["M3"] == 90.3 and got["M5"] == 70.5
    # All parts but that of the one machine are the files of the first batch; of the others the last two are left.
    late = {f for f in files() if not f.startswith("batch=0/")}
    assert len({f.split("/")[0] for f in late}) == 2 and len({f.split("/")[1] for f in late}) == 1
    assert {f for f in files() if f.startswith("batch=0/")} == {f for f in one if f.split("/")[1] != next(iter(late)).split("/")[1]}
    assert len(live._manifests(spark, kept)) == 2


def test_means_do_not_hang_on_the_order_of_rows(spark):
    rows = spark.createDataFrame([(i, "M1", 0.1) for i in range(3)] + [(3, "M2", None)], "id int, device string, v double")
    got = rows.groupBy("device").agg(live.exact_mean("v").alias("m")).orderBy("device").collect()
    assert [r["m"] for r in got] == [0.3 / 3, None]
