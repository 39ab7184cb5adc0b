"""KPI packs: every pack is one aggregation over the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.cast import as_time, moment, number
from millrace.functions.names import is_time, numeric_columns, quoted, resolve
from millrace.operators.ordering import row_index
from millrace.operators.windows import trend_slope
from millrace.operators.profile import distinct_counts

# KPI name -> (aggregate, column hints in order of preference).
PACKS = {
    "predictive_maintenance": {
        "Mean_temp": ("mean", "temperature", "temp"),
        "Mean_vib": ("mean", "vibration", "vib"),
        "Mean_pressure": ("mean", "pressure"),
        "Failure_Count": ("total0", "failure", "fault", "alarm"),
        "Min_RUL": ("min", "rul", "remaining_useful_life"),
    },
    "healthcare": {
        "Mean_Age": ("mean", "age"),
        "Mean_BP": ("mean", "bp", "blood_pressure", "systolic"),
        "Mean_Glucose": ("mean", "glucose", "blood_sugar"),
        "Patients": ("distinct_or_rows", "patient", "patient_id"),
        "Readmission%": ("rate", "readmission"),
    },
    "education": {
        "Students": ("distinct_or_rows", "student", "student_id"),
        "Mean_Score": ("mean", "math_score", "score", "marks", "gpa"),
        "Mean_Attendance": ("mean", "attendance"),
    },
    "sales_forecasting": {
        "Total_Revenue": ("sum", "revenue", "sales", "gmv", "amount"),
        "Avg_Order": ("mean", "revenue", "sales", "amount"),
        "Units": ("sum", "units", "qty", "quantity"),
        "Customers": ("distinct", "customer", "customer_id"),
        "SKUs": ("distinct", "sku", "product"),
    },
    "telecom_churn": {
        "Churn%": ("rate", "churn"),
        "Mean_Tenure": ("mean", "tenure"),
        "Mean_ARPU": ("mean", "arpu", "monthly_charges", "revenue"),
        "Subscribers": ("distinct_or_rows", "subscriber", "customer", "customer_id"),
    },
    "finance_risk": {
        "Default%": ("rate", "default", "delinquent", "fraud"),
        "Mean_Loan": ("mean", "loan", "loan_amount", "amount", "balance"),
        "Mean_Income": ("mean", "income", "annual_income"),
        "Mean_Score": ("mean", "credit_score", "score"),
    },
    "warehouse_logistics": {
        "Total_Stock": ("sum", "inventory", "stock", "on_hand"),
        "Mean_LeadTime": ("mean", "lead_time", "leadtime"),
        "Shipments": ("sum", "shipment", "shipments", "orders"),
        "SKUs": ("distinct", "sku"),
    },
    "energy_utilities": {
        "Mean_Load": ("mean", "load", "consumption", "kwh", "mw", "power"),
        "Peak_Load": ("max", "load", "consumption", "kwh", "mw", "power"),
        "Mean_Voltage": ("mean", "voltage"),
        "Mean_Current": ("mean", "current"),
    },
    "agriculture_iot": {
        "Mean_Moisture": ("mean", "moisture", "soil_moisture"),
        "Mean_Rainfall": ("mean", "rainfall", "rain"),
        "Mean_pH": ("mean", "ph"),
        "Mean_Yield": ("mean", "yield", "crop_yield"),
    },
    "hr_people": {
        "Headcount": ("distinct_or_rows", "employee", "employee_id"),
        "Mean_Salary": ("mean", "salary", "compensation", "pay"),
        "Attrition%": ("rate", "attrition", "churn"),
        "Departments": ("distinct", "department"),
    },
}

# The metric that stands for a domain when groups are compared.
DOMAIN_METRICS = {
    "sales_forecasting": ["revenue", "sales", "gmv", "amount", "units"],
    "healthcare": ["age", "bmi", "glucose", "bp", "systolic", "readmission"],
    "education": ["gpa", "marks", "score", "attendance", "grade"],
    "telecom_churn": ["churn", "arpu", "tenure", "monthly_charges"],
    "predictive_maintenance": ["temperature", "vibration", "pressure", "rul", "failure"],
    "finance_risk": ["loan_amount", "amount", "default", "credit_score", "income"],
    "warehouse_logistics": ["inventory", "stock", "lead_time", "shipments"],
    "energy_utilities": ["load", "kwh", "mw", "power", "voltage"],
    "agriculture_iot": ["moisture", "yield", "rainfall", "ph"],
    "hr_people": ["salary", "attrition", "performance"],
}

# Hints for the four filter columns.
FILTER_HINTS = {
    "location": (
        "location", "loc", "region", "city", "store", "warehouse", "site", "plant", "branch", "state", "country",
        "ward", "department",
    ),
    "date": ("date", "timestamp", "datetime", "day", "order_date", "admit_date", "hire_date"),
    "time": ("time", "hour", "timestamp", "datetime"),
    "people": (
        "customer", "customer_id", "patient", "patient_id", "employee", "employee_id", "user", "user_id",
        "subscriber", "person", "name",
    ),
}


def body_mass(weight: Column, height: Column) -> Column:
    """Weight over squared height; heights above 3 are centimetres."""
    metres = F.when(height > 3, height / 100.0).otherwise(height)
    return F.try_divide(weight, metres * metres)


def _aggregate(df: DataFrame, kind: str, hints) -> Column | None:
    name = resolve(df.columns, *hints)
    if name is None:
        return {"total0": F.lit(0.0), "distinct_or_rows": F.count("*").cast("double")}.get(kind)
    x = number(df, name)
    known = F.coalesce(x, F.lit(0.0))
    return {
        "mean": F.avg(x),
        "sum": F.sum(x),
        "min": F.min(x),
        "max": F.max(x),
        "total0": F.sum(known),
        "rate": F.avg(known) * 100,
        "distinct": F.count_distinct(F.col(quoted(name))).cast("double"),
        "distinct_or_rows": F.count_distinct(F.col(quoted(name))).cast("double"),
    }[kind]


def kpi_table(df: DataFrame, domain: str = "generic", means: int | None = None) -> DataFrame:
    """(kpi, value) rows, unrounded; NULL where the table has no such column or no readable value.

    A table of no known domain gets the mean of its first `means` numeric columns, of all by default.
    """
    missing = F.lit(0).cast("long")
    for name in df.columns:
        missing = missing + F.count_if(F.col(quoted(name)).isNull())
    cells = F.greatest(F.count("*") * len(df.columns), F.lit(1))
    measures = {
        "Rows": F.count("*").cast("double"),
        "Cols": F.lit(float(len(df.columns))),
        "Missing%": missing / cells * 100,
    }
    counted: dict[str, str] = {}
    if domain in PACKS:
        for kpi, (kind, *hints) in PACKS[domain].items():
            agg = _aggregate(df, kind, hints)
            if kind.startswith("distinct") and resolve(df.columns, *hints):
                counted[kpi] = resolve(df.columns, *hints)
            if agg is not None or kind in ("mean", "sum"):
                measures[kpi] = F.lit(None).cast("double") if agg is None else agg
        weight, height = resolve(df.columns, "weight"), resolve(df.columns, "height")
        if domain == "healthcare" and weight and height:
            measures["Mean_BMI"] = F.avg(body_mass(number(df, weight), number(df, height)))
    else:
        for name in numeric_columns(df)[:means]:
            measures[f"Mean_{name}"] = F.avg(number(df, name))
    if len(counted) > 1:
        # Several count(distinct) in one aggregation would copy every row for each; pairs are counted beside it.
        measures.update({k: F.lit(None) for k in counted})
    one = df.agg(*[m.cast("double").alias(f"m{i}") for i, m in enumerate(measures.values())])
    rows = [F.struct(F.lit(k).alias("kpi"), F.col(f"m{i}").alias("value")) for i, k in enumerate(measures)]
    flat = one.select(F.inline(F.array(*rows)))
    if len(counted) < 2:
        return flat
    numbers = distinct_counts(df.select(*[F.col(quoted(n)).alias(f"d{i}") for i, n in enumerate(counted.values())]))
    named = F.get(F.array(*[F.lit(k) for k in counted]), F.col("i"))
    # One row for each distinct count.
    joined = flat.join(F.broadcast(numbers.select(named.alias("of"), "distinct")), F.col("kpi") == F.col("of"), "left")
    value = F.when(F.col("kpi").isin(*counted), F.coalesce("distinct", F.lit(0)).cast("double")).otherwise(F.col("value"))
    return joined.select("kpi", value.alias("value"))


def filter_columns(columns) -> dict[str, str | None]:
    return {role: resolve(columns, *hints) for role, hints in FILTER_HINTS.items()}


def apply_filters(df: DataFrame, locations=None, people=None, start=None, end=None) -> DataFrame:
    """Keep the chosen locations, people and dates (both ends included)."""
    cols = filter_columns(df.columns)
    for role, chosen in (("location", locations), ("people", people)):
        if cols[role] and chosen:
            df = df.where(F.col(quoted(cols[role])).cast("string").isin([str(v) for v in chosen]))
    when = cols["date"] or cols["time"]
    if when and (start is not None or end is not None):
        dtype = df.schema[when].dataType
        column = F.col(quoted(when))
        # A real time column is compared in its own type, so the bounds reach the file scan.
        own = dtype if is_time(dtype) else "timestamp"
        column = column if is_time(dtype) else as_time(column, dtype)
        if start is not None:
            df = df.where(column >= F.lit(str(start)).cast(own))
        if end is not None:
            df = df.where(column <= F.lit(str(end)).cast(own))
    return df


def filter_values(df: DataFrame, role: str, limit: int = 200) -> DataFrame:
    name = filter_columns(df.columns)[role]
    values = df.select(F.col(quoted(name)).cast("string").alias("value")).where("value is not null")
    return values.distinct().orderBy("value").limit(limit)


def date_bounds(df: DataFrame) -> DataFrame:
    cols = filter_columns(df.columns)
    t = moment(df, cols["date"] or cols["time"])
    return df.agg(F.to_date(F.min(t)).alias("first_day"), F.to_date(F.max(t)).alias("last_day"))


def comparison_metric(df: DataFrame, domain: str) -> str | None:
    for hint in DOMAIN_METRICS.get(domain, []):
        found = resolve(df.columns, hint)
        if found:
            return found
    numbers = numeric_columns(df)
    return numbers[0] if numbers else None


def group_means(df: DataFrame, group: Column, metric: Column, label: str) -> DataFrame:
    return df.groupBy(group.alias(label)).agg(
        F.avg(metric).alias("mean"),
        F.coalesce(F.sum(metric), F.lit(0.0)).alias("sum"),
        F.count(metric).alias("rows"),
    )


def compare_locations(df: DataFrame, domain: str = "generic") -> DataFrame | None:
    """Mean, sum and count of the domain metric per location, best first; a missing location is a group."""
    place, metric = filter_columns(df.columns)["location"], comparison_metric(df, domain)
    if not place or not metric:
        return None
    out = group_means(df, F.col(quoted(place)), number(df, metric), "location")
    return out.orderBy(F.col("mean").desc_nulls_last(), "location")


def compare_months(df: DataFrame, domain: str = "generic") -> DataFrame | None:
    cols, metric = filter_columns(df.columns), comparison_metric(df, domain)
    when = cols["date"] or cols["time"]
    if not when or not metric:
        return None
    dated = df.select(F.date_format(moment(df, when), "yyyy-MM").alias("period"), number(df, metric).alias("v"))
    return group_means(dated.where("period is not null"), F.col("period"), F.col("v"), "period").orderBy("period")


def period_trend(months: DataFrame) -> DataFrame:
    """Slope over the periods of a month table (one row per month, so it is small by nature)."""
    return trend_slope(months.select("period", "mean"), "mean", ["period"])


def next_period(months: DataFrame, trees: int = 80) -> DataFrame:
    """Forest forecast of the next period from the period number."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    points = row_index(months.where("mean is not null").select("period", "mean"), ["period"], "at")
    points = points.withColumn("at", F.col("at").cast("double"))
    vectors = VectorAssembler(inputCols=["at"], outputCol="features")
    forest = RandomForestRegressor(labelCol="mean", numTrees=trees, maxDepth=10, maxBins=128, seed=42)
    model = forest.fit(vectors.transform(points))
    last = points.agg(F.max("at").alias("last_at"), F.max_by("mean", "at").alias("last"))
    ahead = vectors.transform(last.withColumn("at", F.col("last_at") + 1))
    move = F.col("prediction") - F.col("last")
    return model.transform(ahead).select(
        "last",
        F.col("prediction").alias("forecast"),
        (move / F.when(F.col("last") == 0, 1.0).otherwise(F.abs("last")) * 100).alias("pct"),
    )


def spread(df: DataFrame, group: str, metric: str) -> DataFrame:
    """Lowest and highest group mean and the gap between them."""
    means = df.groupBy(F.col(quoted(group)).cast("string").alias("g")).agg(F.avg(number(df, metric)).alias("m"))
    return means.where("m is not null").agg(
        F.min_by("g", F.struct("m", "g")).alias("lowest"),
        F.min("m").alias("low"),
        F.max_by("g", F.struct("m", "g")).alias("highest"),
        F.max("m").alias("high"),
        (F.max("m") - F.min("m")).alias("gap"),
    )


def relation(df: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation and slope of y on x."""
    a, b = number(df, x), number(df, y)
    both = df.select(a.alias("x"), b.alias("y")).where("x is not null and y is not null")
    return both.agg(
        F.corr("x", "y").alias("correlation"), F.regr_slope("y", "x").alias("slope"), F.count("*").alias("points")
    )
