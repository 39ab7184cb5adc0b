"""Supervised models on Spark ML: catalogue, feature preparation, holdout and cross-validation metrics."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import cached_property
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator  # noqa: F401  (tests watch that it is not used)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.cast import number
from millrace.functions.names import is_number, is_time, numeric_columns, quoted, resolve
from millrace.operators import machines, trees
from millrace.operators.neighbours import knn_classify
from millrace.operators.ordering import row_index
from millrace.operators.profile import bounded_profile
from millrace.session import checkpoint

# Model name -> task.
TASKS = {
    "LogisticRegression": "classification",
    "DecisionTreeClassifier": "classification",
    "RandomForestClassifier": "classification",
    "GradientBoostingClassifier": "classification",
    "KNeighborsClassifier": "classification",
    "SVC": "classification",
    "XGBClassifier": "classification",
    "LinearRegression": "regression",
    "Ridge": "regression",
    "RandomForestRegressor": "regression",
    "GradientBoostingRegressor": "regression",
    "SVR": "regression",
    "XGBRegressor": "regression",
    "LGBMRegressor": "regression",
    "Prophet": "forecast",
    "PCA": "dimensionality",
    "StatsmodelsOLS": "regression",
    "IsolationForest": "anomaly",
}

# Models tried for a domain, in this order.
RECOMMENDED = {
    "predictive_maintenance": [
        "RandomForestRegressor", "XGBRegressor", "RandomForestClassifier", "XGBClassifier", "Prophet",
        "IsolationForest", "PCA",
    ],
    "sales_forecasting": ["Prophet", "RandomForestRegressor", "XGBRegressor", "Ridge"],
    "telecom_churn": ["RandomForestClassifier", "XGBClassifier", "LogisticRegression"],
    "healthcare": ["RandomForestClassifier", "XGBClassifier", "LogisticRegression"],
    "education": ["RandomForestRegressor", "XGBRegressor", "RandomForestClassifier"],
    "finance_risk": ["RandomForestClassifier", "XGBClassifier", "LogisticRegression"],
    "energy_utilities": ["Prophet", "RandomForestRegressor", "XGBRegressor", "PCA"],
    "warehouse_logistics": ["RandomForestRegressor", "XGBRegressor", "Prophet"],
    "agriculture_iot": ["RandomForestRegressor", "Prophet", "IsolationForest"],
    "hr_people": ["RandomForestClassifier", "XGBClassifier", "LogisticRegression"],
    "generic": ["RandomForestRegressor", "RandomForestClassifier", "Prophet", "PCA"],
}

# Targets by domain and by task.
DOMAIN_TARGETS = {
    "predictive_maintenance": ["rul", "failure", "temperature"],
    "sales_forecasting": ["revenue", "sales", "gmv"],
    "telecom_churn": ["churn"],
    "healthcare": ["readmission", "bmi"],
    "education": ["gpa", "marks", "score", "grade"],
    "finance_risk": ["default", "loan_amount"],
    "energy_utilities": ["load", "kwh", "mw"],
    "warehouse_logistics": ["inventory", "lead_time"],
    "agriculture_iot": ["yield", "moisture"],
    "hr_people": ["attrition", "salary"],
}
CLASS_TARGETS = ["failure", "fault", "churn", "default", "readmission", "attrition", "label", "class"]
VALUE_TARGETS = ["rul", "remaining_useful_life", "revenue", "sales", "amount", "gmv", "temperature", "load", "score"]

ROWS_PER_PARTITION = 20_000
ROWS_BESIDE = 4_000_000  # rows of all fits that run side by side, each with its own copy

# Ranges of the random search as (low, high).
SEARCH_RANGES = {
    "forest_trees": (50, 300), "forest_depth": (2, 20), "forest_split": (2, 12),
    "boost_rounds": (50, 250), "boost_depth": (2, 8), "boost_rate": (0.01, 0.3),
}


def pick_target(df: DataFrame, task: str, profile: dict | None = None) -> str | None:
    for hint in CLASS_TARGETS if task == "classification" else VALUE_TARGETS:
        found = resolve(df.columns, hint)
        if found:
            return found
    if task == "classification":
        profile = profile or bounded_profile(df, 40)
        few = [n for n in df.columns if 2 <= profile[n]["distinct"] <= 8 and not n.lower().endswith("_id")]
        return few[0] if few else None
    numbers = numeric_columns(df)
    return numbers[-1] if numbers else None


def domain_target(df: DataFrame, domain: str) -> str | None:
    for hint in DOMAIN_TARGETS.get(domain, ["rul", "failure", "revenue", "churn"]):
        found = resolve(df.columns, hint)
        if found:
            return found
    return pick_target(df, "regression") or pick_target(df, "classification")


def pick_features(df: DataFrame, target: str, profile: dict) -> list[str]:
    """Leave out the target, times, identifiers and text with many values."""
    out = []
    for field in df.schema.fields:
        low, stats = field.name.lower(), profile[field.name]
        if field.name == target or is_time(field.dataType):
            continue
        if low in ("id", "uuid", "index") or low.endswith("_id") or "unnamed" in low:
            continue
        if not is_number(field.dataType):
            if any(h in low for h in ("timestamp", "datetime", "date", "time")):
                continue
            if stats["distinct"] > min(40, max(15, int(stats["rows"] * 0.4))):
                continue
        out.append(field.name)
    return out


def target_task(df: DataFrame, target: str, share: float = 0.7) -> str:
    """Regression for a numeric target with more than eight values."""
    y = number(df, target)
    row = df.agg(F.count(y).alias("n"), F.approx_count_distinct(y).alias("d"), F.count("*").alias("rows")).first()
    if row["d"] <= 16:
        row = df.agg(F.count(y).alias("n"), F.count_distinct(y).alias("d"), F.count("*").alias("rows")).first()
    return "regression" if row["n"] >= max(10, int(share * row["rows"])) and row["d"] > 8 else "classification"


@dataclass
class Prepared:
    data: DataFrame  # key, label, features, fold
    features: list[str]
    task: str
    labels: list[str]
    rows: int

    @cached_property
    def binned(self) -> trees.Binned:
        return trees.binned(self.data, len(self.features))

    @cached_property
    def held(self) -> dict[bool, trees.Binned]:
        """Tables with the holdout marked, by time or not, as far as they were asked for."""
        return {}

    def holdout(self, by_time: bool) -> trees.Binned:
        if by_time not in self.held:
            self.held[by_time] = _holdout(self.binned, by_time)
        return self.held[by_time]


def prepare(df: DataFrame, target: str, task: str, key: str, features: Sequence[str] | None = None) -> Prepared:
    """Vector of all features: numbers with missing as 0, text as codes of its sorted values.

    ``key`` is a unique column; folds follow its hash, so they survive recomputation.
    """
    if not features:
        features = [f for f in pick_features(df, target, bounded_profile(df, 40)) if f != key]
    features = list(features)
    if not features:
        raise ValueError("no usable feature columns")
    data = df.where(F.col(quoted(target)).isNotNull())
    columns = []
    select = [F.col(quoted(key)).alias("key")]
    texts = []
    for i, n in enumerate(features):
        if is_number(df.schema[n].dataType) or df.schema[n].dataType.simpleString() == "boolean":
            select.append(F.coalesce(number(df, n), F.lit(0.0)).alias(f"f{i}"))
        else:
            select.append(F.coalesce(F.col(quoted(n)).cast("string"), F.lit("nan")).alias(f"t{i}"))
            texts.append(i)
        columns.append(f"f{i}")
    if task == "classification":
        select.append(F.col(quoted(target)).cast("string").alias("target"))
    else:
        select.append(number(df, target).alias("label"))
    # Read for each text's values, the bins or a cache, and the rows: what stands behind it runs once.
    data = checkpoint(data.select(*select))
    labels: list[str] = []
    if task == "classification":
        indexer = StringIndexer(inputCol="target", outputCol="label", stringOrderType="alphabetAsc").fit(data)
        labels, data = list(indexer.labels), indexer.transform(data)
    else:
        data = data.where("label is not null")
    for i in texts:
        data = StringIndexer(inputCol=f"t{i}", outputCol=f"f{i}", stringOrderType="alphabetAsc").fit(data).transform(data)
    data = VectorAssembler(inputCols=columns, outputCol="features").transform(data)
    fold = F.pmod(F.xxhash64("key", F.lit(42)), F.lit(5)).cast("int")
    data = data.select("key", "label", "features", fold.alias("fold"))
    rows = data.count()
    if rows < 12:
        raise ValueError(f"need at least 12 rows, have {rows}")
    # Boosted trees run a job per tree level; a small table in many partitions would only wait for tasks.
    wanted = math.ceil(rows / ROWS_PER_PARTITION)
    if wanted < df.sparkSession.sparkContext.defaultParallelism:
        data = data.coalesce(wanted)
    return Prepared(data, features, task, labels, rows)


def split(data: DataFrame, by_time: bool = False, test: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Holdout: the last share along the key, or a hash-random share."""
    if by_time:
        indexed = row_index(data, ["key"], "_at")
        rows = data.count()
        cut = max(1, min(rows - 1, int(rows * (1 - test))))
        return indexed.where(F.col("_at") < cut).drop("_at"), indexed.where(F.col("_at") >= cut).drop("_at")
    draw = F.pmod(F.xxhash64("key", F.lit(7)), F.lit(10_000))
    return data.where(draw >= int(test * 10_000)), data.where(draw < int(test * 10_000))


def balanced_weights(data: DataFrame) -> DataFrame:
    """Add ``weight`` = rows / (classes * rows of the class)."""
    counts = {r["label"]: r["n"] for r in data.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    pairs = [x for k, n in counts.items() for x in (F.lit(k), F.lit(total / (len(counts) * n)))]
    return data.withColumn("weight", F.create_map(*pairs)[F.col("label")])


def boosted(model: str, task: str, classes: int) -> trees.Spec | None:
    """The settings of a boosted model; None for other names.

    The plain kind takes Newton steps without a penalty. The second one has a penalty of 1 on leaf values and a least
    hessian of 1, the third grows 31 leaves of 20 rows, best first.
    """
    if model in ("GradientBoostingClassifier", "GradientBoostingRegressor"):
        return trees.Spec("boost", task, classes, trees=100, depth=3, rate=0.1, penalty=0.0, least_weight=1e-9)
    if model in ("XGBClassifier", "XGBRegressor"):
        return trees.Spec("boost", task, classes, trees=120 if task == "classification" else 140, depth=5, rate=0.08)
    if model == "LGBMRegressor":
        return trees.Spec("boost", task, classes, trees=140, depth=6, rate=0.08, penalty=0.0, least_weight=1e-3, least_rows=20, leaves=31)
    return None


def forest(model: str, task: str, classes: int, width: int) -> trees.Spec | None:
    """The settings of a forest; None for other names."""
    if model not in ("RandomForestClassifier", "RandomForestRegressor"):
        return None
    columns = math.ceil(math.sqrt(width)) if task == "classification" else math.ceil(width / 3)
    return trees.Spec("forest", task, classes, trees=120, depth=10, penalty=0.0, least_weight=0.0, columns=columns)


def build(model: str, rows: int, spread: float = 1.0):
    """The Spark ML estimator for a catalogue name."""
    if model == "LogisticRegression":
        # The L2 strength of the usual C = 1.
        return LogisticRegression(maxIter=1000, regParam=1.0 / rows, standardization=False)
    if model == "DecisionTreeClassifier":
        return DecisionTreeClassifier(maxDepth=8, seed=42)
    if model in ("LinearRegression", "StatsmodelsOLS"):
        return LinearRegression(solver="normal", standardization=False)
    if model == "Ridge":
        return LinearRegression(solver="normal", standardization=False, regParam=spread / rows)
    raise ValueError(f"unknown model {model}")


def _metrics(predicted: DataFrame, task: str) -> dict[str, float]:
    if task == "classification":
        score = MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction")
        return {
            "accuracy": score.setMetricName("accuracy").evaluate(predicted),
            "f1": score.setMetricName("f1").evaluate(predicted),
        }
    score = RegressionEvaluator(labelCol="label", predictionCol="prediction")
    return {m: score.setMetricName(m).evaluate(predicted) for m in ("r2", "rmse", "mae")}


def _evaluator(task: str):
    if task == "classification":
        return MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy")
    return RegressionEvaluator(labelCol="label", metricName="r2")


def run_model(
    df: DataFrame,
    model: str,
    key: str,
    target: str | None = None,
    by_time: bool = False,
    cross_validate: bool = True,
    features: Sequence[str] | None = None,
    ready: Prepared | None = None,
) -> dict:
    """Fit one catalogue model. Returns metrics, the predictions of the holdout and what was used.

    ``ready`` is the table as ``prepare`` gives it, for callers that fit several models to it.
    """
    task = TASKS[model]
    target = target or pick_target(df, task)
    if target is None:
        raise ValueError("no target column found")
    if model == "StatsmodelsOLS":
        return run_ols(df, target, key, features)
    ready = ready or prepare(df, target, task, key, features)
    data, width = ready.data, len(ready.features)
    classes = max(len(ready.labels), 2)
    spec = boosted(model, task, classes) or forest(model, task, classes, width)
    if spec:
        metrics, shown = _fit_trees(ready, spec, by_time, 5 if cross_validate else 0)
        return {
            "model": model, "task": task, "target": target, "features": ready.features, "labels": ready.labels,
            "rows": ready.rows, "metrics": metrics, "predictions": shown,
        }
    if model in ("SVC", "SVR"):
        metrics, shown = _fit_machines(data, width, task, classes, ready.rows, by_time, 5 if cross_validate else 0)
        return {
            "model": model, "task": task, "target": target, "features": ready.features, "labels": ready.labels,
            "rows": ready.rows, "metrics": metrics, "predictions": shown,
        }
    data = data.cache()
    try:
        train, test = split(data, by_time)
        metrics: dict[str, float] = {}
        if model == "KNeighborsClassifier":
            predicted = _neighbours(train, test, width)
            metrics = _metrics(predicted, task)
            if cross_validate:
                # One search for all folds: a row passes over those of its own fold.
                found = _neighbours(data, data, width, apart="fold")
                right = F.avg((F.col("label") == F.col("prediction")).cast("double"))
                metrics["cv_score"] = float(np.mean([r["a"] for r in found.groupBy("fold").agg(right.alias("a")).collect()]))
        else:
            spread = 1.0
            if model == "Ridge":
                spread = train.agg(F.stddev_pop("label")).first()[0] or 1.0
            estimator = build(model, ready.rows, spread)
            predicted, scores = _fit_beside(estimator, data, train, test, task, ready.rows, 5 if cross_validate else 0)
            metrics = _metrics(predicted, task)
            if scores:
                metrics["cv_score"] = float(np.mean(scores))
        shown = predicted.select("key", F.col("label").alias("y_true"), F.col("prediction").alias("y_pred"))
    finally:
        data.unpersist()
    return {
        "model": model, "task": task, "target": target, "features": ready.features, "labels": ready.labels,
        "rows": ready.rows, "metrics": metrics, "predictions": shown,
    }


def _fit_beside(estimator, data: DataFrame, train: DataFrame, test: DataFrame, task: str, rows: int, folds: int) -> tuple[DataFrame, list[float]]:
    """The holdout with predictions, and the score of each fold. A fit is a row of short jobs: those of small tables run side by side."""
    known = {r["fold"] for r in data.select("fold").distinct().collect()} if folds else set()
    for f in range(folds):
        if f not in known or known == {f}:
            raise ValueError(f"no rows to fit or to score at fold {f}")

    def score(f: int) -> float:
        return _evaluator(task).evaluate(estimator.fit(data.where(F.col("fold") != f)).transform(data.where(F.col("fold") == f)))

    beside = inheritable_thread_target(data.sparkSession)
    with ThreadPool(max(1, min(folds + 1, ROWS_BESIDE // max(rows, 1)))) as pool:
        fitted = pool.apply_async(beside(lambda: estimator.fit(train)))
        scores = pool.map(beside(score), range(folds), 1)
        return fitted.get().transform(test), scores


def _holdout(data: trees.Binned, by_time: bool) -> trees.Binned:
    """The same table with fold 1 for the rows held out, 0 for the others."""
    train, test = split(data.table, by_time)
    one = train.withColumn("fold", F.lit(0)).unionByName(test.withColumn("fold", F.lit(1)))
    return replace(data, table=checkpoint(one))


def _held(data: trees.Binned) -> trees.Binned:
    return replace(data, table=data.table.where("fold = 1"))


def _class_weights(data: trees.Binned, classes: int) -> tuple[float, ...]:
    """rows / (classes * rows of the class), 0 for a class without rows."""
    counts = {int(r["label"]): r["n"] for r in data.table.groupBy("label").agg(F.count("*").alias("n")).collect()}
    return tuple(data.rows / (len(counts) * counts[k]) if k in counts else 0.0 for k in range(classes))


def _fit_trees(ready: Prepared, spec: trees.Spec, by_time: bool, folds: int) -> tuple[dict[str, float], DataFrame]:
    """Metrics and predictions of the holdout, and the mean score of the folds. Classes weigh alike in a forest."""
    if spec.kind == "forest" and spec.task == "classification":
        spec = replace(spec, class_weights=_class_weights(ready.binned, spec.classes))
    held, data, spec = ready.holdout(by_time), ready.binned, replace(spec, fold=1)
    score = "accuracy" if spec.task == "classification" else "r2"
    beside = inheritable_thread_target(held.table.sparkSession)
    # A boosted model takes one task: that of the holdout is fitted beside those of the folds.
    with ThreadPool(1) as pool:
        scores = pool.apply_async(beside(lambda: trees.cross_validated(data, [spec], folds, score))) if folds else None
        (grown,) = trees.fit_many(held, [spec], "trees")
        found = checkpoint(trees.predictions(_held(held), spec, grown))
        metrics = _metrics(found, spec.task)
        if scores:
            metrics["cv_score"] = scores.get()[0]
    return metrics, found.select("key", F.col("label").alias("y_true"), F.col("prediction").alias("y_pred"))


def _fit_machines(data: DataFrame, width: int, task: str, classes: int, rows: int, by_time: bool, folds: int) -> tuple[dict[str, float], DataFrame]:
    """Metrics and predictions of the holdout, and the mean score of the folds, by machines that are fitted together."""
    table = machines.flat(*split(data, by_time))
    found = machines.fit(table, width, classes if task == "classification" else 0, 1.0 / rows, folds)
    predicted = checkpoint(machines.predictions(table, width, found))
    held = predicted.where("held").select("key", "label", F.col("held_prediction").alias("prediction"))
    metrics = _metrics(held, task)
    if folds:
        y, e = F.col("label"), F.col("label") - F.col("prediction")
        score = F.avg((e == 0).cast("double")) if task == "classification" else 1 - F.sum(e * e) / (F.var_pop(y) * F.count("*"))
        metrics["cv_score"] = float(np.mean([r["s"] for r in predicted.groupBy("fold").agg(score.alias("s")).collect()]))
    return metrics, held.select("key", F.col("label").alias("y_true"), F.col("prediction").alias("y_pred"))


def _neighbours(train: DataFrame, test: DataFrame, width: int, apart: str | None = None) -> DataFrame:
    names = [f"x{i}" for i in range(width)]

    def wide(frame: DataFrame) -> DataFrame:
        v = vector_to_array("features")
        return frame.select("key", "label", "fold", *[v[i].alias(n) for i, n in enumerate(names)])

    found = knn_classify(wide(train), wide(test), names, "label", "key", 5, apart)
    # Read for several figures; the search runs once.
    return checkpoint(test.select("key", "label", "fold").join(found, "key").withColumn("prediction", F.col("prediction").cast("double")))


def run_ols(df: DataFrame, target: str, key: str, features: Sequence[str] | None = None) -> dict:
    """Least squares: first 80 % fitted, rest held out, with p-values, AIC and BIC. Without `features` all numeric ones."""
    if not features:
        picked = pick_features(df, target, bounded_profile(df, 40))
        features = [f for f in picked if f != key and is_number(df.schema[f].dataType)]
    features = list(features)
    data = df.select(
        F.col(quoted(key)).alias("key"), number(df, target).alias("label"),
        *[number(df, n).alias(f"f{i}") for i, n in enumerate(features)],
    ).na.drop()
    data = VectorAssembler(inputCols=[f"f{i}" for i in range(len(features))], outputCol="features").transform(data)
    train, test = split(data.select("key", "label", "features"), by_time=True)
    model = LinearRegression(solver="normal", standardization=False).fit(train)
    fit = model.summary
    n, rss, k = fit.numInstances, fit.meanSquaredError * fit.numInstances, len(features) + 1
    likelihood = -n / 2.0 * (math.log(2.0 * math.pi) + math.log(max(rss, 1e-300) / n) + 1.0)
    predicted = model.transform(test)
    metrics = _metrics(predicted, "regression")
    metrics.update(aic=2 * k - 2 * likelihood, bic=k * math.log(n) - 2 * likelihood)
    return {
        "model": "StatsmodelsOLS", "task": "regression", "target": target, "features": features, "labels": [],
        "rows": n, "metrics": metrics,
        "coefficients": dict(zip([*features, "const"], [*model.coefficients.toArray().tolist(), model.intercept])),
        "p_values": dict(zip([*features, "const"], fit.pValues)),
        "predictions": predicted.select("key", F.col("label").alias("y_true"), F.col("prediction").alias("y_pred")),
    }


def metrics_table(spark, results: Sequence[dict]) -> DataFrame:
    rows = [(r["model"], r["target"], name, float(v)) for r in results for name, v in r["metrics"].items()]
    return spark.createDataFrame(rows, "model string, target string, metric string, value double")


def briefing(metrics: DataFrame) -> DataFrame:
    """One sentence per model from its metrics."""
    wide = metrics.groupBy("model", "target").pivot("metric", ["accuracy", "f1", "r2", "rmse", "mae", "cv_score"]).agg(F.first("value"))
    show = lambda n: F.coalesce(F.format_string("%.4f", F.col(n)), F.lit("n/a"))
    classes = F.format_string(
        "%s on %s: accuracy %s, F1 %s, CV %s. Use this score to prioritise high-risk rows.",
        "model", "target", show("accuracy"), show("f1"), show("cv_score"),
    )
    values = F.format_string(
        "%s on %s: R2 %s, RMSE %s, MAE %s, CV %s. Higher R2 and lower RMSE make planning safer.",
        "model", "target", show("r2"), show("rmse"), show("mae"), show("cv_score"),
    )
    return wide.select("model", "target", F.when(F.col("accuracy").isNotNull(), classes).otherwise(values).alias("sentence"))


def bake_off(df: DataFrame, domain: str, key: str, models: Sequence[str] | None = None) -> tuple[list[dict], DataFrame]:
    """The given or recommended models on the domain's target, best cross-validated score first."""
    # What stands behind the table, and what the models are fitted to, is made once for all of them.
    df = checkpoint(df)
    target = domain_target(df, domain)
    if target is None:
        raise ValueError("no target column found for this domain")
    task = target_task(df, target)
    names = list(models or [m for m in RECOMMENDED.get(domain, []) if TASKS[m] == task])
    if not names:
        names = ["RandomForestRegressor", "XGBRegressor"] if task == "regression" else ["RandomForestClassifier", "XGBClassifier"]
    ready = {t: prepare(df, target, t, key) for t in dict.fromkeys(TASKS[m] for m in names if m != "StatsmodelsOLS")}
    results = [run_model(df, m, key, target, by_time=True, ready=ready.get(TASKS[m])) for m in names]
    results.sort(key=lambda r: -r["metrics"]["cv_score"])
    board = [(i + 1, r["model"], target, float(r["metrics"]["cv_score"])) for i, r in enumerate(results)]
    return results, df.sparkSession.createDataFrame(board, "place int, model string, target string, score double")


def search(
    df: DataFrame, target: str, key: str, trials: int = 50, folds: int = 5, by_time: bool = True, balanced: bool = True,
    ranges: dict[str, tuple] | None = None,
) -> dict:
    """Random search over forests and boosted trees, scored by cross-validation, then holdout metrics.

    The table is binned once, and the models of all trials and folds are fitted together. ``ranges`` narrows
    ``SEARCH_RANGES``. The result has the score of every trial, in order.
    """
    task = target_task(df, target, 0.8)
    ready = prepare(df, target, task, key)
    fold = F.pmod(F.xxhash64("key", F.lit(42)), F.lit(folds)).cast("int")
    data = trees.binned(ready.data.withColumn("fold", fold), len(ready.features))
    classes, weights = max(len(ready.labels), 2), None
    if task == "classification" and balanced:
        weights = _class_weights(data, classes)
    specs = _trials(task, classes, trials, {**SEARCH_RANGES, **(ranges or {})}, weights)
    metric = ("f1" if balanced else "accuracy") if task == "classification" else "rmse"
    scores = trees.cross_validated(data, specs, folds, metric)
    best = (min if metric == "rmse" else max)(range(len(specs)), key=scores.__getitem__)
    held, spec = _holdout(data, by_time), replace(specs[best], fold=1)
    (grown,) = trees.fit_many(held, [spec], "trees")
    metrics = _metrics(checkpoint(trees.predictions(_held(held), spec, grown)), task)
    board = [{"trial": i, "kind": s.kind, "trees": s.trees, "depth": s.depth, "least_split": s.least_split, "rate": s.rate, "score": x} for i, (s, x) in enumerate(zip(specs, scores))]
    return {
        "model": {"forest": "RandomForest", "boost": "GradientBoosting"}[spec.kind] + {"classification": "Classifier", "regression": "Regressor"}[task],
        "task": task, "target": target, "metrics": {**metrics, "cv_score": scores[best]}, "params": board[best], "trials": len(specs), "board": board,
    }


def _trials(task: str, classes: int, trials: int, ranges: dict[str, tuple], weights: tuple[float, ...] | None) -> list[trees.Spec]:
    """Seeded random settings within the searched ranges, forests and boosted trees in turn."""
    rng, out = random.Random(42), []
    for i in range(trials):
        if i % 2 == 0:
            out.append(trees.Spec(
                "forest", task, classes, trees=rng.randint(*ranges["forest_trees"]), depth=rng.randint(*ranges["forest_depth"]),
                least_split=rng.randint(*ranges["forest_split"]), least_weight=0.0, columns="sqrt" if task == "classification" else "all",
                class_weights=weights, paths=True,
            ))
        else:
            rounds, depth = rng.randint(*ranges["boost_rounds"]), rng.randint(*ranges["boost_depth"])
            rate = math.exp(rng.uniform(*(math.log(v) for v in ranges["boost_rate"])))
            out.append(trees.Spec("boost", task, classes, trees=rounds, depth=depth, rate=rate, class_weights=weights))
    return out
