"""Risk score of the latest state, and the findings derived from a table."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.cast import number
from millrace.functions.names import numeric_columns, quoted, resolve
from millrace.operators import trees
from millrace.operators.anomaly import anomaly_summary, forest_here
from millrace.operators.features import add_features
from millrace.operators.models import balanced_weights
from millrace.operators.windows import last_rows, latest
from millrace.session import checkpoint

BASE_RISK = 15.0
LEAST_ROWS = 15  # rows that anomalies need
RECENT = 24  # latest rows whose label probability counts
GROUP_ROWS = 500_000  # rows of an entity that one task judges
LABELS = ("failure", "fault", "alarm", "label", "churn", "default", "readmission")


def _stats(df: DataFrame, name: str | None) -> tuple[Column, Column]:
    if name is None:
        return F.lit(None).cast("double"), F.lit(None).cast("double")
    return F.avg(number(df, name)), F.stddev_samp(number(df, name))


def rule_risk(df: DataFrame, domain: str, order_by: Sequence[str], entity: str | None = None) -> DataFrame:
    """Base risk plus the domain's rules on the latest row, for the table or for every entity.

    ``df`` already has the domain's feature columns. Means and deviations are those of the whole table.
    """
    c = lambda n: number(df, n) if n in df.columns else F.lit(None).cast("double")
    vib, temp = resolve(df.columns, "vibration", "vib"), resolve(df.columns, "temperature", "temp")
    load = resolve(df.columns, "load", "consumption", "kwh", "mw", "power")
    rev = resolve(df.columns, "revenue", "sales")
    flag = resolve(df.columns, "churn") if domain == "telecom_churn" else resolve(df.columns, "attrition", "churn")
    mean_v, std_v = _stats(df, vib)
    mean_r, _ = _stats(df, rev)
    rate = F.avg(F.coalesce(number(df, flag), F.lit(0.0))) if flag else F.lit(None).cast("double")
    row = df.agg(mean_v.alias("mean_v"), std_v.alias("std_v"), mean_r.alias("mean_r"), rate.alias("rate"), F.count("*").alias("n")).first()
    last = latest(df, order_by, [entity] if entity else [])
    add = F.lit(0.0)

    def when(test: Column, points: float) -> Column:
        return F.when(F.coalesce(test, F.lit(False)), points).otherwise(0.0)

    if domain in ("predictive_maintenance", "energy_utilities", "agriculture_iot"):
        if vib and row["mean_v"] is not None:
            add = add + when(number(df, vib) > row["mean_v"] + 2 * (row["std_v"] or 1.0), 25.0)
        if temp:
            add = add + when(number(df, temp) > 90, 15.0)
        add = add + when(F.abs(c("temp_gradient")) > 10, 20.0)
    if domain == "healthcare":
        add = add + when(c("BMI") >= 30, 20.0) + when(c("BRISK_SCORE") > 3.5, 18.0)
    if domain == "sales_forecasting" and rev and row["n"] > 5:
        add = add + when(number(df, rev) < (row["mean_r"] or 0.0) * 0.7, 25.0)
    if domain == "finance_risk":
        add = add + when(c("DTI_proxy") > 0.45, 28.0)
    if domain == "warehouse_logistics":
        add = add + when(c("days_of_cover") < 3, 30.0)
    if domain == "energy_utilities" and load:
        add = add + when(F.abs(F.coalesce(c("load_gradient"), F.lit(0.0))) > F.abs(number(df, load)) * 0.2, 22.0)
    if domain == "agriculture_iot":
        add = add + when(c("irrigation_stress") > 20, 25.0) + when(c("ph_dev_neutral") > 1.5, 15.0)
    risk = F.lit(BASE_RISK) + add
    if domain in ("telecom_churn", "hr_people") and row["rate"] is not None:
        risk = F.greatest(risk, F.lit(row["rate"] * 100.0))
    name = F.col(quoted(entity)).cast("string") if entity else F.lit("all")
    return last.select(name.alias("entity"), risk.alias("rule_risk"))


def risk_score(df: DataFrame, domain: str, order_by: Sequence[str], entity: str | None = None) -> DataFrame:
    """(entity, rule_risk, anomaly_rate, label_probability, risk): rules, then anomalies, then a classifier.

    Half of the score is the anomaly rate; with a label of two to five values 60 % of the result is the mean
    forest probability of the last 24 rows. The result stays within 0.5 and 99.5. With an entity each one has its own
    forests over its own rows.
    """
    # Scored, sampled and trained on several times below; the windows behind it run once.
    work = checkpoint(add_features(df, domain, order_by))
    rules = rule_risk(work, domain, order_by, entity)
    label = resolve(work.columns, *LABELS)
    names = [n for n in numeric_columns(work) if n != label]
    filled = work.select(
        *[F.col(quoted(o)).alias(f"_o{i}") for i, o in enumerate(order_by)],
        *[F.coalesce(number(work, n), F.lit(0.0)).alias(f"x{i}") for i, n in enumerate(names)],
        (F.coalesce(number(work, label), F.lit(0.0)) if label else F.lit(0.0)).alias("raw_label"),
        *([F.col(quoted(entity)).alias("_entity")] if entity else []),
    )
    features = [f"x{i}" for i in range(len(names))]
    if entity:
        order = [f"_o{i}" for i in range(len(order_by))]
        filled = filled.withColumn("entity", F.col("_entity").cast("string"))
        judged = _judged_entities(filled.drop("_entity"), features, order, bool(label))
        both = rules.alias("r").join(judged.alias("j"), F.col("r.entity").eqNullSafe(F.col("j.entity")), "left")
        risk = F.when(F.col("anomaly_rate").isNull(), F.col("rule_risk")).otherwise(0.5 * F.col("rule_risk") + 50.0 * F.col("anomaly_rate"))
        risk = F.when(F.col("label_probability").isNull(), risk).otherwise(0.4 * risk + 60.0 * F.col("label_probability"))
        return both.select("r.entity", "rule_risk", "anomaly_rate", "label_probability", F.least(F.lit(99.5), F.greatest(F.lit(0.5), risk)).alias("risk"))
    rate, probability = None, None
    shape = filled.agg(F.count("*").alias("n"), F.approx_count_distinct("raw_label").alias("d"), F.count_if(F.col("raw_label") > 0).alias("pos")).first()
    if shape["n"] >= LEAST_ROWS and names:
        rate = anomaly_summary(filled, features, contamination=0.1).first()["rate"]
        if label and shape["d"] <= 5 and 0 < shape["pos"] < shape["n"]:
            probability = _recent_probability(filled, features, [f"_o{i}" for i in range(len(order_by))])
    risk = F.col("rule_risk")
    if rate is not None:
        risk = 0.5 * risk + F.lit(50.0 * rate)
    if probability is not None:
        risk = 0.4 * risk + F.lit(60.0 * probability)
    return rules.select(
        "entity", "rule_risk", F.lit(rate).cast("double").alias("anomaly_rate"),
        F.lit(probability).cast("double").alias("label_probability"),
        F.least(F.lit(99.5), F.greatest(F.lit(0.5), risk)).alias("risk"),
    )


def judge_rows(x: np.ndarray, raw_label: np.ndarray | None) -> tuple[float | None, float | None]:
    """(anomaly rate, label probability) of rows in time order, by forests over these rows alone."""
    n = len(x)
    if n < LEAST_ROWS or not x.shape[1]:
        return None, None
    scores = forest_here(x).scores(x)
    rate = float((scores > np.quantile(scores, 0.9)).mean())
    if raw_label is None or not 0 < (raw_label > 0).sum() < n or len(np.unique(raw_label)) > 5:
        return rate, None
    y = (raw_label > 0).astype(float)
    cuts = []
    for c, most in zip(np.quantile(x, np.arange(1, trees.BINS) / trees.BINS, axis=0, method="inverted_cdf").T, x.max(0)):
        values = np.unique(c)
        cuts.append(values[values < most])
    bins = trees.cut_up(x, cuts)
    spec = _label_forest(n, y.sum())
    found = trees.forest_here(spec, bins, y, np.arange(n, dtype=np.uint64), bins[-RECENT:])
    return rate, float(trees.likely(spec, found)[:, 1].mean())


def _judged_entities(filled: DataFrame, features: Sequence[str], order: Sequence[str], labelled: bool, most: int = GROUP_ROWS) -> DataFrame:
    """(entity, anomaly_rate, label_probability). Entities of up to `most` rows are judged many at a time, each in one
    task; the few that have more, one after another over the whole cluster."""
    schema = "entity string, anomaly_rate double, label_probability double"
    sizes = checkpoint(filled.groupBy("entity").agg(F.count("*").alias("n")))
    large = [r["entity"] for r in sizes.where(F.col("n") > most).collect()]

    def judge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([*order, *features], na_position="first")
        found = judge_rows(rows[list(features)].to_numpy(float), rows["raw_label"].to_numpy(float) if labelled else None)
        return pd.DataFrame({"entity": rows["entity"].iloc[:1], "anomaly_rate": [found[0]], "label_probability": [found[1]]}).astype({"anomaly_rate": float, "label_probability": float})

    small = filled
    for name in large:
        small = small.where(~F.col("entity").eqNullSafe(F.lit(name)))
    # Rows are few for the work they make, so their size must not decide how many tasks share it.
    facts, spark = sizes.agg(F.count("*").alias("n"), F.sum("n").alias("rows")).first(), filled.sparkSession
    tasks = max(1, min(facts["n"], max(4 * spark.sparkContext.defaultParallelism, math.ceil((facts["rows"] or 0) / most))))
    out = small.repartition(tasks, "entity").groupBy("entity").applyInPandas(judge, schema)
    for name in large:
        mine = filled.where(F.col("entity").eqNullSafe(F.lit(name)))
        rate = anomaly_summary(mine, features, contamination=0.1).first()["rate"]
        shape = mine.agg(F.count("*").alias("n"), F.approx_count_distinct("raw_label").alias("d"), F.count_if(F.col("raw_label") > 0).alias("pos")).first()
        split = labelled and shape["d"] <= 5 and 0 < shape["pos"] < shape["n"]
        one = [(name, rate, _recent_probability(mine, features, order) if split else None)]
        out = out.unionByName(filled.sparkSession.createDataFrame(one, schema))
    clean = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return out.select("entity", clean("anomaly_rate"), clean("label_probability"))


def _recent_probability(filled: DataFrame, features: Sequence[str], order: Sequence[str], last: int = RECENT) -> float:
    """Mean probability of a label in the latest rows, by the forest of `judge_rows` over all rows, or Spark's for tables too large to send."""
    if filled.count() * (len(features) + 17) > trees.MOST_SENT:
        # Passes of the library's trees take longer than Spark's forest.
        data = filled.withColumn("label", (F.col("raw_label") > 0).cast("double"))
        data = balanced_weights(VectorAssembler(inputCols=list(features), outputCol="features").transform(data))
        model = RandomForestClassifier(numTrees=100, maxDepth=8, seed=42, weightCol="weight").fit(data)
        scored = model.transform(last_rows(data, last, order))
        return scored.select(F.avg(vector_to_array("probability")[1]).alias("p")).first()["p"]
    # Rows are drawn by their key.
    rows = filled.withColumn("key", F.xxhash64(*order, *features)).withColumn("label", (F.col("raw_label") > 0).cast("double")).withColumn("fold", F.lit(0))
    ready = trees.binned(VectorAssembler(inputCols=list(features), outputCol="features").transform(rows).select("key", "label", "features", "fold"), len(features))
    (grown,) = trees.fit_many(ready, [spec := _label_forest(ready.rows, ready.table.agg(F.sum("label")).first()[0])], "trees")
    x = np.array([list(r) for r in last_rows(filled, last, order).select(*features).collect()], float)
    return float(trees.likely(spec, trees.predicted(spec, grown, trees.cut_up(x, ready.cuts)))[:, 1].mean())


def _label_forest(rows: int, labelled: float) -> trees.Spec:
    """Both classes weigh alike."""
    weights = rows / (2 * (rows - labelled)), rows / (2 * labelled)
    return trees.Spec("forest", "classification", 2, trees=100, depth=8, least_weight=0.0, columns="sqrt", class_weights=weights)


def action_findings(df: DataFrame, domain: str, order_by: Sequence[str], risk: float | None = None) -> DataFrame:
    """(priority, text): plain-language findings of a domain."""
    spark = df.sparkSession
    parts: list[DataFrame] = []
    if domain == "predictive_maintenance":
        vib = resolve(df.columns, "vibration", "vib")
        machine = resolve(df.columns, "machine_id", "machine", "asset_id", "asset")
        if vib:
            m = df.agg(F.avg(number(df, vib)).alias("m"), F.stddev_samp(number(df, vib)).alias("s")).first()
            hot = df.where(number(df, vib) >= (m["m"] or 0.0) + 2 * (m["s"] or 1.0))
            rank = F.struct(*[F.col(quoted(o)) for o in order_by])
            who = F.col(quoted(machine)).cast("string") if machine else F.lit("sensor")
            spike = hot.agg(F.max_by(F.struct(who.alias("who"), number(df, vib).alias("v")), rank).alias("last"))
            found = F.format_string("ALERT: bearing wear pattern on %s, vibration spiked to %.2f.", "last.who", "last.v")
            parts.append(spike.select(F.lit(1).alias("priority"), F.when(F.col("last").isNull(), "Sensors within envelope, continue condition monitoring.").otherwise(found).alias("text")))
        lines = [(2, "Schedule maintenance within 8-12 h, inspect bearings, verify the temperature gradient.")]
        if risk is not None:
            lines.append((3, f"Expected downtime if ignored: about {round(2 + risk / 20.0, 1)} h."))
        parts.append(spark.createDataFrame(lines, "priority int, text string"))
    elif domain == "sales_forecasting":
        rev, place = resolve(df.columns, "revenue", "sales", "gmv"), resolve(df.columns, "location", "region", "store")
        if rev and place:
            means = df.groupBy(F.col(quoted(place)).cast("string").alias("g")).agg(F.avg(number(df, rev)).alias("m")).where("g is not null and m is not null")
            ends = means.agg(F.min_by("g", F.struct("m", "g")).alias("a"), F.min("m").alias("am"), F.max_by("g", F.struct("m", "g")).alias("b"), F.max("m").alias("bm"))
            text = F.format_string("Revenue soft spot: %s (avg=%.2f) against leader %s (%.2f).", "a", "am", "b", "bm")
            parts.append(ends.select(F.lit(1).alias("priority"), text.alias("text")))
        parts.append(spark.createDataFrame([(2, "Promote the weak region, re-check stockouts, run the outlook.")], "priority int, text string"))
    elif domain == "telecom_churn":
        churn = resolve(df.columns, "churn")
        rate = F.avg(F.coalesce(number(df, churn), F.lit(0.0))) if churn else F.lit(0.0)
        text = F.format_string("Churn rate %.1f%%: put the high-tenure, low-ARPU cohort first.", F.col("rate") * 100)
        parts.append(df.agg(rate.alias("rate")).select(F.lit(1).alias("priority"), text.alias("text")))
        parts.append(spark.createDataFrame([(2, "Retention offers, call-drop analysis, win-back campaign.")], "priority int, text string"))
    elif domain == "healthcare":
        parts.append(spark.createDataFrame([(1, "Flag the high BMI and glucose cohort, schedule follow-ups, watch readmission risk.")], "priority int, text string"))
    else:
        parts.append(spark.createDataFrame([(1, "Review the KPIs and share the weekly pack.")], "priority int, text string"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
