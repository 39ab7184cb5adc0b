from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import domains as dm
from millrace.operators import models as mo
from millrace.operators import trees as tr
from millrace.plans.catalogue import QUERIES


@pytest.fixture(scope="module")
def found(spark):
    rng = np.random.default_rng(0)
    make = lambda columns: spark.createDataFrame(pd.DataFrame({c: rng.uniform(1, 40, 30) for c in columns}))
    tables = {
        "machines": make(["machine_id", "temperature", "vibration", "pressure", "rul", "failure"]),
        "shop": make(["region", "revenue", "sales", "sku", "units", "customer_id"]),
        "school": make(["student_id", "age", "math_score", "reading_score", "writing_score", "gender"]),
        "weak": make(["age", "score"]),
        "line": make(["asset_id", "downtime_minutes", "scrap", "oee", "availability"]),
    }
    return dm.catalogue(spark, tables, kinds=True)


def test_votes(found):
    got = {r["table"]: r["domain"] for r in dm.decide(dm.vote(dm.heuristic_scores(found))).collect()}
    assert got["machines"] == "predictive_maintenance" and got["shop"] == "sales_forecasting" and got["school"] == "education"
    assert got["weak"] != "healthcare"


def test_packs_and_plant(found):
    got = {r["table"]: (r["domain"], r["app_domain"]) for r in dm.pack_domain(dm.pack_scores(found)).collect()}
    assert got["line"] == ("plant_oee", "generic") and got["school"] == ("education", "education") and got["weak"][0] == "generic"
    match = {r["table"]: r["match"] for r in dm.plant_score(found).collect()}
    assert match["line"] and not match["shop"]


def test_classifier_knows_the_packs(found):
    got = {r["table"]: r["domain"] for r in dm.classify_schemas(found).collect()}
    assert got["machines"] == "predictive_maintenance" and got["school"] == "education"


def test_override(spark, found):
    decided = dm.decide(dm.vote(dm.heuristic_scores(found)))
    chosen = spark.createDataFrame([("shop", "generic")], "table string, chosen string")
    got = {r["table"]: (r["domain"], r["detected"], r["overridden"]) for r in dm.with_override(decided, chosen).collect()}
    assert got["shop"] == ("generic", "sales_forecasting", True) and not got["school"][2]


def test_roles_and_mapping(spark):
    columns = ["timestamp", "Machine ID", "vibration", "temperature", "rul", "failure", "torque_2", "asset", "when", "note", "date of rul"]
    kinds = {"timestamp": "date", "when": "date", "note": "text", "asset": "id_like"}
    tables = spark.createDataFrame(
        [("m", "predictive_maintenance", columns, kinds), ("s", "sales", ["rev_2", "cust", "net_sales", "amount", "x"], {"rev_2": "number", "amount": "number", "x": "boolean"}),
         ("c", "churn", ["key", "left"], {"key": "id_like", "left": "boolean"}), ("g", "unheard", ["key", "value"], {"key": "id_like"}), ("none", "generic", [], {})],
        "table string, domain string, columns array<string>, kinds map<string,string>",
    )
    got = {}
    for r in dm.suggest_roles(tables).collect():
        got.setdefault(r["table"], {})[r["column"]] = r["role"]
    assert got["m"] == {
        "timestamp": "date", "Machine ID": "id", "vibration": "sensor", "temperature": "sensor", "rul": "rul_target", "failure": "failure_label",
        "torque_2": "sensor", "asset": "asset", "note": "category",
    }
    assert got["s"] == {"rev_2": "revenue", "net_sales": "revenue", "amount": "revenue"}
    assert got["c"] == {"key": "customer_id", "left": "churn_flag"} and got["g"] == {"key": "id", "value": "metric"} and "none" not in got
    saved = {"revenue": "revenue", "customer": "customer", "zzz": "region"}
    assert dm.match_mapping(["Revenue", "customer_name", "qty"], saved) == {"Revenue": "revenue", "customer_name": "customer"}


def table(spark, n=400):
    rng = np.random.default_rng(1)
    a, b = rng.normal(0, 1, n), rng.normal(0, 1, n)
    frame = pd.DataFrame({
        "row": np.arange(n), "a": a, "b": b, "kind": np.where(a > 0, "hi", "lo"), "amount": 3 * a - 2 * b + 5 + rng.normal(0, 0.1, n),
        "ring": (a * a + b * b < 1.2).astype(int), "grp": (a + b > 0).astype(int) + (a - b > 1).astype(int),
    })
    return frame, spark.createDataFrame(frame)


def test_linear_models_equal_closed_form(spark):
    frame, df = table(spark)
    fit = mo.run_ols(df, "amount", "row", ["a", "b"])
    train = frame.iloc[:320]
    x = np.column_stack([train["a"], train["b"], np.ones(320)])
    want = np.linalg.lstsq(x, train["amount"], rcond=None)[0]
    assert np.allclose([fit["coefficients"][k] for k in ("a", "b", "const")], want, atol=1e-8)
    assert fit["metrics"]["r2"] > 0.99 and fit["p_values"]["a"] < 1e-6
    rss = ((train["amount"] - x @ want) ** 2).sum()
    assert np.isclose(fit["metrics"]["aic"], 320 * (np.log(2 * np.pi) + np.log(rss / 320) + 1) + 6)


def test_ridge_shrinks_as_alpha_one(spark):
    frame, df = table(spark)
    ready = mo.prepare(df, "amount", "regression", "row", ["a", "b"])
    spread = frame["amount"].std(ddof=0)
    model = mo.build("Ridge", 400, spread=spread).fit(ready.data)
    x, y = frame[["a", "b"]].to_numpy(), frame["amount"].to_numpy()
    xc, yc = x - x.mean(0), y - y.mean()
    assert np.allclose(model.coefficients.toArray(), np.linalg.solve(xc.T @ xc + np.eye(2), xc.T @ yc), atol=1e-6)


@pytest.mark.parametrize("model,target,least", [("LogisticRegression", "kind", 0.9), ("SVC", "ring", 0.85), ("KNeighborsClassifier", "ring", 0.85), ("RandomForestClassifier", "grp", 0.85)])
def test_classifiers_learn(spark, model, target, least):
    _, df = table(spark)
    result = mo.run_model(df, model, "row", target, cross_validate=False, features=["a", "b"])
    assert result["metrics"]["accuracy"] >= least and result["predictions"].count() > 40


def test_svr_learns_a_bend(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(-3, 3, 400)
    df = spark.createDataFrame(pd.DataFrame({"row": np.arange(400), "x": x, "score": np.sin(x) + rng.normal(0, 0.05, 400)}))
    assert mo.run_model(df, "SVR", "row", "score", cross_validate=False)["metrics"]["r2"] > 0.9


def test_targets_and_features(spark):
    _, df = table(spark)
    named = df.withColumnRenamed("ring", "failure").withColumnRenamed("amount", "revenue").withColumnRenamed("row", "row_id")
    assert mo.pick_target(named, "classification") == "failure" and mo.pick_target(named, "regression") == "revenue"
    assert mo.domain_target(named, "sales_forecasting") == "revenue"
    assert mo.target_task(named, "revenue") == "regression" and mo.target_task(named, "failure") == "classification"
    assert "row_id" not in mo.pick_features(named, "revenue", mo.bounded_profile(named, 40))


def test_time_split_and_briefing(spark):
    _, df = table(spark)
    result = mo.run_model(df, "DecisionTreeClassifier", "row", "kind", by_time=True, cross_validate=True, features=["a", "b"])
    assert result["predictions"].agg({"key": "min"}).first()[0] == 320
    text = mo.briefing(mo.metrics_table(spark, [result])).first()["sentence"]
    assert text.startswith("DecisionTreeClassifier on kind: accuracy") and "n/a" not in text


@pytest.mark.parametrize("name", ["search", "bake_off"])
def test_registered_queries_run_the_whole_operator(spark, monkeypatch, name):
    """All columns, and nothing given beyond table, target or domain, and key: trials, folds, ranges and models are the defaults."""
    seen = []

    def called(df, *args, **named):
        seen.append((df.columns, args, named))
        raise InterruptedError

    monkeypatch.setattr(mo, name, called)
    with pytest.raises(InterruptedError):
        QUERIES[f"model_{name}"](spark, "/root/testdata/sf0.001")
    columns = ["o_orderkey", "revenue", "priority", "balance", "segment", "line_count", "qty", "paid", "churn"]
    assert seen == [(columns, ("churn" if name == "search" else "telecom_churn", "o_orderkey"), {})]


def test_search_scores_every_trial_on_every_fold(spark):
    """All trials are accounted for, each with the score of its own fits, and the best one is kept."""
    _, df = table(spark, 300)
    ranges = {"forest_trees": (3, 6), "boost_rounds": (3, 6), "forest_depth": (2, 4), "boost_depth": (2, 3)}
    found = mo.search(df, "ring", "row", trials=6, folds=3, ranges=ranges)
    assert found["trials"] == len(found["board"]) == 6 and [b["kind"] for b in found["board"]] == ["forest", "boost"] * 3
    assert found["metrics"]["cv_score"] == max(b["score"] for b in found["board"]) == found["params"]["score"]
    ready = mo.prepare(df, "ring", "classification", "row")
    data = tr.binned(ready.data.withColumn("fold", F.pmod(F.xxhash64("key", F.lit(42)), F.lit(3)).cast("int")), len(ready.features))
    x, y, key, fold = tr._arrays(data.table.toArrow(), data.width)
    n = np.bincount(y.astype(int))
    specs = mo._trials("classification", 2, 6, {**mo.SEARCH_RANGES, **ranges}, tuple(len(y) / (2 * n)))
    for spec, line in zip(specs, found["board"]):
        scores = []
        for f in range(3):
            one = replace(spec, fold=f)
            grown, held = tr.fit_here(one, x, y, key, fold, data.bins), fold == f
            scores.append(tr.metrics(one, tr.scored(one, y[held], tr.decided(one, tr.predicted(one, grown, x[held]))))["f1"])
        assert np.isclose(np.mean(scores), line["score"])


def test_search_for_values_takes_the_least_error(spark):
    _, df = table(spark, 200)
    found = mo.search(df, "amount", "row", trials=4, folds=2, ranges={"forest_trees": (3, 6), "boost_rounds": (20, 30), "boost_rate": (0.2, 0.3)})
    assert found["task"] == "regression" and found["metrics"]["cv_score"] == min(b["score"] for b in found["board"])
    assert found["metrics"]["r2"] > 0.8


@pytest.mark.parametrize("model,target", [("GradientBoostingClassifier", "grp"), ("XGBClassifier", "ring"), ("XGBRegressor", "amount"), ("LGBMRegressor", "amount")])
def test_boosted_models_are_validated(spark, model, target):
    _, df = table(spark)
    result = mo.run_model(df, model, "row", target, features=["a", "b"])
    least = {"grp": 0.9, "ring": 0.85, "amount": 0.9}[target]
    first = "r2" if target == "amount" else "accuracy"
    assert result["metrics"][first] >= least and result["metrics"]["cv_score"] >= least and result["predictions"].count() > 40


def test_schema_classifier_keeps_the_best_of_its_trials(spark, found):
    """More trials never score worse, a repeated fit is the same, and schemas of one domain's own words are known."""
    few, more = (dm.fit_schemas(spark, n) for n in (1, 6))
    assert few.score <= more.score == max(b["score"] for b in more.board) and len(more.board) == 6 and len(few.board) == 1
    assert more.board[0] == few.board[0] and dm.fit_schemas(spark, 0).board == few.board
    got = {r["table"]: (r["domain"], r["probability"]) for r in dm.classify_schemas(found, 6).collect()}
    assert got["machines"][0] == "predictive_maintenance" and all(1 / len(dm.KEYWORDS) < p <= 1 for _, p in got.values())
    assert got == {r["table"]: (r["domain"], r["probability"]) for r in dm.classify_schemas(found, 6).collect()}


def test_a_bake_off_prepares_its_table_once(spark, monkeypatch):
    _, df = table(spark, 200)
    df = df.withColumnRenamed("kind", "churn")
    made = {"prepare": [], "binned": []}
    prepare, binned = mo.prepare, tr.binned
    monkeypatch.setattr(mo, "prepare", lambda *a: made["prepare"].append(a[1:3]) or prepare(*a))
    monkeypatch.setattr(tr, "binned", lambda *a: made["binned"].append(1) or binned(*a))
    results, board = mo.bake_off(df, "telecom_churn", "row", ["RandomForestClassifier", "LogisticRegression", "GradientBoostingClassifier"])
    assert made == {"prepare": [("churn", "classification")], "binned": [1]}
    assert [r["place"] for r in board.collect()] == [1, 2, 3]
    for r in results:
        if r["model"] == "LogisticRegression":
            alone = mo.run_model(df, r["model"], "row", "churn", by_time=True)
            assert alone["metrics"] == pytest.approx(r["metrics"], abs=1e-9)


@pytest.mark.parametrize("model,target", [("DecisionTreeClassifier", "ring"), ("LinearRegression", "amount")])
@pytest.mark.parametrize("beside", [10**9, 0])
def test_folds_are_fitted_once_each_and_no_fit_is_thrown_away(spark, monkeypatch, model, target, beside):
    """The cross-validator fitted the folds one after another, and then all rows for a model that nothing asked for."""
    from pyspark.ml.tuning import CrossValidator

    _, df = table(spark, 200)
    ready = mo.prepare(df, target, mo.TASKS[model], "row", ["a", "b"])
    estimator = mo.build(model, ready.rows)
    old = CrossValidator(estimator=estimator, estimatorParamMaps=[{}], evaluator=mo._evaluator(ready.task), numFolds=5, foldCol="fold")
    want = old.fit(ready.data).avgMetrics[0]
    fits, kind = [], type(estimator)
    fit = kind.fit
    monkeypatch.setattr(kind, "fit", lambda self, *a: fits.append(1) or fit(self, *a))
    monkeypatch.setattr(mo, "ROWS_BESIDE", beside)
    found = mo.run_model(df, model, "row", target, features=["a", "b"])["metrics"]["cv_score"]
    assert found == pytest.approx(want, abs=1e-9) and len(fits) == 6


def test_the_briefing_joins_once_for_both_models(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(mo, "run_model", lambda df, model, key, target, features: seen.append(df) or {"model": model, "target": target, "metrics": {"r2": 1.0}})
    assert len(QUERIES["model_briefing"](spark, "/root/testdata/sf0.001").collect()) == 2
    assert seen[0] is seen[1] and all("table-" in f for f in seen[0].inputFiles())
