import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from millrace.operators import kpis as kp
from millrace.operators import profile as pf
from millrace.operators import quality as qa
from millrace.operators.anomaly import average_path, forest_here
from millrace.operators.board import Board, board_source, pareto
from millrace.operators.briefs import top_actions, weekly_briefs
from millrace.operators.features import add_features
from millrace.operators.profile import column_kinds, column_profile, date_columns
from millrace.operators.retrieval import extract_answer, keyword_search, row_documents
from millrace.operators import risk as rk
from millrace.operators.risk import risk_score
from millrace.operators.shape import top_with_other
from millrace.operators.star import money_impact, star
from millrace.operators.windows import first_seen, series
from millrace.plans.catalogue import QUERIES


def machines(spark, n=80):
    rng = np.random.default_rng(0)
    rows = [
        (
            dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), f"M{i % 3 + 1}", "Pune" if i % 2 else "Mumbai",
            float(rng.normal(75, 4)), float(rng.normal(0.5, 0.08)), float(rng.normal(5, 0.2)), 100 - 60.0 * i / (n - 1), int(rng.random() < 0.12),
        )
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "timestamp timestamp, machine_id string, location string, temperature double, vibration double, pressure double, rul double, failure int")


def test_group_of_nulls(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 2.0), (None, 5.0)], "region string, revenue double")
    got = {r["location"]: (r["mean"], r["sum"], r["rows"]) for r in kp.compare_locations(df, "sales_forecasting").collect()}
    assert got == {"a": (None, 0.0, 0), "b": (2.0, 2.0, 1), None: (5.0, 5.0, 1)}
    fact = {r["entity_key"]: r["revenue"] for r in star(df, "region", ["revenue"])["fact"].collect()}
    assert fact == {"a": None, "b": 2.0, "nan": 5.0}


def test_unreadable_dates_are_dropped(spark):
    df = spark.createDataFrame([("2024-01-03", 1.0), ("soon", 2.0), ("2024-02-01", 3.0)], "date string, revenue double")
    assert [r["period"] for r in kp.compare_months(df, "sales_forecasting").collect()] == ["2024-01", "2024-02"]
    assert kp.apply_filters(df, start="2024-01-01").count() == 2
    assert kp.apply_filters(df, start="2024-01-03", end="2024-01-03").count() == 1


def test_series_fills_gaps(spark):
    days = [(dt.datetime(2024, 1, 1), 1.0), (dt.datetime(2024, 1, 9), 4.0)]
    got = series(spark.createDataFrame(days, "t timestamp, v double"), F.col("t"), F.col("v")).orderBy("period").collect()
    assert len(got) == 9 and [r["value"] for r in got][1:8] == [0.0] * 7
    hours = [(dt.datetime(2024, 1, 1, h), 1.0) for h in (0, 0, 5)]
    got = series(spark.createDataFrame(hours, "t timestamp, v double"), F.col("t"), F.col("v")).orderBy("period").collect()
    assert [r["value"] for r in got] == [2.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    flat = [(dt.datetime(2024, 1, 1), -1.0), (dt.datetime(2024, 1, 1, 1), 1.0), (dt.datetime(2024, 1, 9), 0.0)]
    got = series(spark.createDataFrame(flat, "t timestamp, v double"), F.col("t"), F.col("v")).orderBy("period").collect()
    assert got[0]["value"] == 0.0 and got[1]["value"] is None


def test_other_and_pareto(spark):
    groups = spark.createDataFrame([(f"g{i:02}", float(20 - i)) for i in range(12)], "label string, value double")
    got = top_with_other(groups).orderBy("rank").collect()
    assert [r["label"] for r in got][-1] == "Other" and got[-1]["value"] == sum(20 - i for i in range(8, 12)) and len(got) == 9
    assert pareto(groups.where("label = 'g00'")) is None
    shares = pareto(groups, 5).orderBy("rank").collect()
    assert shares[-1]["cum_pct"] == 100.0 and shares[-1]["pct_of_all"] < 100.0


def test_board_on_awkward_names(spark):
    rows = [(f"2024-0{i // 28 + 1}-{i % 28 + 1:02}", 100 + i, i % 7, float(i % 5), f"Z{i % 3}", f"C{i % 2}", f"rep{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "sold_on string, amount_usd int, qty_units int, margin_pct double, zone string, channel string, sales_rep string")
    board = Board(df, ["sales_rep"], "sales")
    assert board.metric == "amount_usd" and board.date == "sold_on" and board.category in ("zone", "channel")
    data = board.datasets()
    assert len(data) == 9 and all(d is not None and d.count() > 0 for d in data.values())
    empty = Board(df.withColumn("amount_usd", F.lit(0)).select("zone", "amount_usd"), ["zone"], "sales")
    assert empty.share() is None and "zero" in empty.reasons["share"]
    assert board_source(None, df, None) is df


def test_kinds_follow_storage_type(spark):
    rows = [(i, 1.5 * (i % 9), i % 2, f"2024-01-{i % 28 + 1:02}", f"t{i % 4}", f"u{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "order_id int, amount double, flag int, seen string, kind string, customer string")
    assert column_kinds(df) == {"order_id": "id_like", "amount": "number", "flag": "boolean", "seen": "date", "kind": "text", "customer": "id_like"}
    assert date_columns(df) == ["seen"]
    exact = {r["column"]: r["distinct"] for r in column_profile(df).collect()}
    assert exact["amount"] == 9 and exact["customer"] == 60


def test_quality_report_has_all_rows(spark):
    report = qa.quality_report(machines(spark), ["timestamp", "machine_id"]).orderBy("place").toPandas()
    assert report["check"].tolist() == list(qa.CHECKS) and len(report) == 19
    status = dict(zip(report["check"], report["status"]))
    assert status["missing"] == "PASS" and status["timestamp"] == "PASS" and status["rowcount"] == "PASS"
    # The remaining life falls from row to row.
    assert status["expectations"] == "PASS" and status["physics_rules"] == "PASS"


def test_report_lines_come_from_the_whole_report(spark, monkeypatch):
    made, whole = [], qa.quality_report

    def noted(df, *args, **named):
        made.append((df.columns, whole(df, *args, **named)))
        return made[-1][1]

    monkeypatch.setattr(qa, "quality_report", noted)
    lines = [r["line"] for r in QUERIES["quality_report_lines"](spark, "/root/testdata/sf0.001").collect()]
    ((columns, report),) = made
    rows = report.orderBy("place").collect()
    assert columns == "event_id timestamp machine_id location temperature vibration pressure speed rul failure".split()
    assert [r["check"] for r in rows] == list(qa.CHECKS)
    bad = [f"Quality {r['check']}: {r['detail']}" for r in rows if r["status"] in ("FAIL", "WARN")]
    assert len(bad) > 2 and lines == bad[:2]


def test_jump_rules(spark):
    rows = [(i, 20.0 + (60.0 if i == 5 else 0.0), 0.5 if i != 7 else 9.0) for i in range(10)]
    df = spark.createDataFrame(rows, "id int, temp double, vib double")
    got = {r["column"]: r["jumps"] for r in qa.impossible_jumps(df, ["id"], rows_per_range=3).collect()}
    assert got == {"temp": 2, "vib": 2}


def test_money(spark):
    one = spark.createDataFrame([(0.9, 600, 5, "A1", 0.8)], "availability double, downtime_minutes int, scrap int, asset_id string, oee double")
    got = money_impact(one, 100.0, 2.0, domain="plant_oee").first()
    assert got["hours"] == 10.0 and got["total_usd"] == 1010.0 and got["minutes_assumed"] and got["ok"]
    hours = spark.createDataFrame([(5.0,), (7.0,)], "idle_hours double")
    assert money_impact(hours, 10.0, domain="plant_oee").first()["total_usd"] == 120.0
    revenue = spark.createDataFrame([(5.0,)], "revenue double")
    generic = money_impact(revenue, domain="generic").first()
    assert generic["revenue_total"] == 5.0 and generic["total_usd"] == 0.0


def test_features_divide_by_zero(spark):
    df = spark.createDataFrame([(1, 10.0, 0), (2, 30.0, 3)], "id int, revenue double, units int")
    got = add_features(df, "sales_forecasting", ["id"]).orderBy("id").collect()
    assert got[0]["ASP"] is None and got[1]["ASP"] == 10.0 and got[1]["revenue_pct_change"] == 2.0


def test_risk_stays_in_range(spark):
    got = risk_score(machines(spark), "predictive_maintenance", ["timestamp"]).first()
    assert 0.5 <= got["risk"] <= 99.5 and got["anomaly_rate"] is not None and got["label_probability"] is not None


def test_texts(spark):
    df = spark.createDataFrame([(1, "M1", None, 3.0), (2, "M2", 80.0, 9.0)], "id int, machine_id string, temperature double, vibration double")
    docs = row_documents(df, "id").orderBy("row_id").collect()
    assert docs[0]["document"] == "row_id=1 | id=1 | machine_id=M1 | vibration=3.0"
    none = keyword_search(row_documents(df, "id"), "zebra", 6)
    assert none.count() == 2 and {r["source"] for r in none.collect()} == {"fallback"}
    hit = keyword_search(row_documents(df, "id"), "why did m2 spike", 6).collect()
    assert "M2" in hit[0]["document"] and hit[0]["score"] > hit[1]["score"]
    assert extract_answer(df, "why did machine M1 fail").first()["peak_vibration"] == 3.0
    assert extract_answer(df, "why did machine X9 fail").first()["peak_vibration"] == 9.0


def test_first_seen_and_actions(spark):
    found = [(1, 1, 0, "Check  pump"), (1, 2, 0, "check pump"), (1, 3, 0, "Call"), (2, 1, 0, " "), (3, 1, 0, "a"), (3, 1, 1, "b"), (3, 1, 2, "c"), (3, 1, 3, "d")]
    findings = spark.createDataFrame(found, "owner int, priority int, seq int, text string")
    assert first_seen(findings, "text", ["priority", "seq"], ["owner"]).count() == 7
    owners = spark.createDataFrame([(1,), (2,), (3,)], "owner int")
    got = top_actions(findings, owners).toPandas()
    assert got.groupby("owner").size().tolist() == [3, 3, 3]
    assert got[got["owner"] == 3]["action"].tolist() == ["a", "b", "c"]
    assert got[got["owner"] == 1].sort_values("rank")["action"].tolist()[:2] == ["Check  pump", "Call"]


def test_brief_takes_newest_session(spark):
    jobs = spark.createDataFrame([(1, "weekly_report", True, "a@x"), (2, "weekly_report", True, ""), (3, "weekly_report", False, "c@x"), (4, "weekly_report", True, "d@x")], "user_id int, job_type string, enabled boolean, email string")
    sessions = spark.createDataFrame(
        [(1, "2024-01-01", 1, ["old"], "5", []), (1, "2024-02-01", 2, ["new", "b", "c", "d"], "7", [("k", "v")])],
        "user_id int, created_at string, session_id int, actions array<string>, impact string, kpis array<struct<name:string,value:string>>",
    )
    got = {r["user_id"]: r["brief"] for r in weekly_briefs(jobs, sessions, "2024-02-05").collect()}
    assert set(got) == {1, 4} and "1. new" in got[1] and "old" not in got[1] and "4." not in got[1]
    assert "No actions yet" in got[4] and "N/A" in got[4]


def test_kpi_missing_columns(spark):
    df = spark.createDataFrame(pd.DataFrame({"x": [1.0, 2.0]}))
    got = {r["kpi"]: r["value"] for r in kp.kpi_table(df, "sales_forecasting").collect()}
    assert got["Rows"] == 2 and got["Total_Revenue"] is None


def test_risk_of_each_entity_is_that_of_its_own_rows(spark):
    """Anomaly rate and failure probability by entity equal those of a loop over the entities, and differ between them."""
    rng = np.random.default_rng(4)
    parts = []
    for name, n, level in (("M1", 120, 0.2), ("M2", 90, 2.5), ("M3", 10, 1.0), (None, 40, 0.5)):
        vib = rng.normal(level, 0.3, n)
        parts.append(pd.DataFrame({"machine_id": name, "vibration": vib, "temperature": rng.normal(60, 5, n), "failure": (vib + rng.normal(0, 0.2, n) > level + 0.3).astype(int)}))
    frame = pd.concat(parts, ignore_index=True)
    frame["at"] = rng.permutation(len(frame))
    df = spark.createDataFrame(frame)
    got = {r["entity"]: r for r in rk.risk_score(df, "predictive_maintenance", ["at"], "machine_id").collect()}
    assert set(got) == {"M1", "M2", "M3", None}
    work = add_features(df, "predictive_maintenance", ["at"]).toPandas()
    names = [c for c in work.columns if c not in ("machine_id", "failure") and pd.api.types.is_numeric_dtype(work[c])]
    for name, one in work.groupby("machine_id", dropna=False):
        one, key = one.sort_values("at"), None if pd.isna(name) else name
        rate, p = rk.judge_rows(one[names].fillna(0.0).to_numpy(float), one["failure"].to_numpy(float))
        assert (got[key]["anomaly_rate"], got[key]["label_probability"]) == (rate, p)
        risk = got[key]["rule_risk"]
        if rate is not None:
            risk = 0.5 * risk + 50 * rate
            risk = risk if p is None else 0.4 * risk + 60 * p
        assert np.isclose(got[key]["risk"], min(99.5, max(0.5, risk)))
    assert got["M3"]["anomaly_rate"] is None and got["M1"]["label_probability"] != got["M2"]["label_probability"]
    assert 0.05 < got["M1"]["anomaly_rate"] <= 0.1


def test_a_large_entity_is_judged_over_the_cluster(spark):
    rng = np.random.default_rng(7)
    frame = pd.DataFrame({"entity": ["a"] * 200 + ["b"] * 60, "_o0": np.arange(260), "x0": rng.normal(0, 1, 260), "x1": rng.normal(0, 1, 260)})
    frame["raw_label"] = (frame["x0"] > 0.5).astype(float)
    df = spark.createDataFrame(frame)
    one, two = ({r["entity"]: r for r in rk._judged_entities(df, ["x0", "x1"], ["_o0"], True, most).collect()} for most in (10**6, 100))
    assert one["b"] == two["b"] and abs(one["a"]["anomaly_rate"] - two["a"]["anomaly_rate"]) < 0.02
    assert abs(one["a"]["label_probability"] - two["a"]["label_probability"]) < 0.1


def test_trees_of_rows_at_hand_isolate_their_samples():
    """Every leaf's path is its depth and the mean depth of the rows that end there; an outlier has the highest score."""
    x = np.random.default_rng(5).normal(0, 1, (60, 3)).round(1)
    x[7] = 9.0
    forest = forest_here(x, trees=20)
    for feature, cut, path in zip(forest.feature, forest.cut, forest.path):
        ends = []
        for row in x:
            at, depth = 0, 0
            while feature[at] >= 0:
                at, depth = 2 * at + 1 + (row[feature[at]] > cut[at]), depth + 1
            ends.append((at, depth))
        for at, depth in ends:
            alike = [r for r, e in zip(x, ends) if e[0] == at]
            assert path[at] == depth + average_path(len(alike))
            assert depth == forest.depth or len(np.unique(alike, axis=0)) == 1
    assert forest.scores(x).argmax() == 7
    assert np.array_equal(forest.scores(x), np.concatenate([forest.scores(x[i : i + 7]) for i in range(0, 60, 7)]))


def test_kinds_count_exactly_only_what_a_sketch_leaves_open(spark, monkeypatch):
    counted, exact = [], pf.distinct_counts
    monkeypatch.setattr(pf, "distinct_counts", lambda df: counted.append(df.columns) or exact(df))
    n = 4000
    frame = pd.DataFrame({"amount": np.arange(n) % 1000 * 1.5, "reading": np.arange(n) * 0.5, "close": np.arange(n) % 3401, "below": np.arange(n) % 3399, "flag": np.arange(n) % 2})
    got = column_kinds(spark.createDataFrame(frame))
    assert got == {"amount": "number", "reading": "id_like", "close": "id_like", "below": "number", "flag": "boolean"}
    assert counted == [["close", "below", "flag"]]


def test_the_label_forest_is_that_of_one_task(spark, monkeypatch):
    """The probability of a whole table comes from the forest that an entity of these rows gets, over passes too."""
    import pytest

    from millrace.operators import risk as rk
    from millrace.operators import trees as tr

    draw = np.random.default_rng(5)
    n = 300
    x = draw.integers(0, 30, (n, 3)).astype(float)
    frame = pd.DataFrame({"_o0": np.arange(n), "x0": x[:, 0], "x1": x[:, 1], "x2": x[:, 2], "raw_label": (x[:, 0] + draw.integers(0, 9, n) > 24).astype(float)})
    df = spark.createDataFrame(frame)
    fit, found = tr.fit_many, []
    for most in (10**9, 0):
        monkeypatch.setattr(tr, "fit_many", lambda data, specs, give, most=most: fit(data, specs, give, most))
        found.append(rk._recent_probability(df, ["x0", "x1", "x2"], ["_o0"]))
    alone = rk.judge_rows(x, frame["raw_label"].to_numpy())[1]
    assert found[0] == pytest.approx(found[1], abs=1e-9) and found[0] == pytest.approx(alone, abs=0.05)
