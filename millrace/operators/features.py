"""Domain feature columns. Windowed ones take an order and, optionally, an entity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.cast import number, ratio
from millrace.functions.names import resolve
from millrace.operators.kpis import body_mass
from millrace.operators.ordering import trailing
from millrace.operators.windows import change_over, mean_over, std_over, step_over

# Column hints used by the features.
HINTS = {
    "weight": ("weight",),
    "height": ("height",),
    "bp": ("bp", "blood_pressure", "systolic"),
    "glucose": ("glucose", "blood_sugar"),
    "age": ("age",),
    "temperature": ("temperature", "temp"),
    "vibration": ("vibration", "vib"),
    "pressure": ("pressure",),
    "flow": ("flow", "flow_rate"),
    "revenue": ("revenue", "sales", "amount"),
    "units": ("units", "qty", "quantity"),
    "balance": ("balance", "amount", "loan_amount"),
    "income": ("income", "annual_income"),
    "credit": ("credit_score", "score"),
    "stock": ("inventory", "stock", "on_hand"),
    "demand": ("demand", "orders", "shipments"),
    "lead": ("lead_time", "leadtime"),
    "load": ("load", "consumption", "kwh", "mw", "power"),
    "voltage": ("voltage",),
    "current": ("current",),
    "tenure": ("tenure",),
    "arpu": ("arpu", "revenue"),
    "usage": ("data_usage", "minutes", "usage"),
    "moisture": ("moisture", "soil_moisture"),
    "rain": ("rainfall", "rain"),
    "ph": ("ph",),
    "salary": ("salary", "compensation", "pay"),
    "attrition": ("attrition",),
}


def _or(x: Column, default: float) -> Column:
    return F.coalesce(x, F.lit(default))


def _plan(domain: str, has, x) -> tuple[dict, dict, int, dict]:
    """Row-wise columns, window columns, rows the windows look back, and columns to standardise."""
    row: dict[str, Column] = {}
    window: dict = {}
    back, scaled = 0, {}
    if domain == "healthcare" and has("weight", "height"):
        row["BMI"] = body_mass(x("weight"), x("height"))
        risk = F.lit(0.0)
        for part, default, scale in (("bp", 120.0, 120.0), ("glucose", 100.0, 100.0), ("age", 40.0, 100.0)):
            if has(part):
                risk = risk + _or(x(part), default) / scale
        row["BRISK_SCORE"] = risk
    elif domain == "predictive_maintenance":
        if has("temperature"):
            window["temp_gradient"], back = ("temperature", step_over), 4
        if has("vibration"):
            window["vib_rolling_std"], back = ("vibration", lambda n: std_over(n, 5)), 4
        if has("temperature", "vibration"):
            row["thermal_mech_index"] = _or(x("temperature"), 0.0) / 100.0 + _or(x("vibration"), 0.0)
        if has("pressure", "flow"):
            row["pressure_flow_ratio"] = ratio(x("pressure"), x("flow"))
    elif domain == "sales_forecasting":
        if has("revenue", "units"):
            row["ASP"] = ratio(x("revenue"), x("units"))
        if has("revenue"):
            window["revenue_ma7"] = ("revenue", lambda n: mean_over(n, 7))
            window["revenue_pct_change"], back = ("revenue", change_over), 6
    elif domain == "finance_risk":
        if has("balance", "income"):
            row["DTI_proxy"] = ratio(x("balance"), x("income"))
        if has("credit"):
            scaled["credit_score_z"] = "credit"
    elif domain == "warehouse_logistics":
        if has("stock", "demand"):
            row["days_of_cover"] = ratio(x("stock"), x("demand"))
        if has("lead"):
            window["lead_time_ma"], back = ("lead", lambda n: mean_over(n, 5)), 4
    elif domain == "energy_utilities":
        if has("load"):
            window["load_rolling_std"] = ("load", lambda n: std_over(n, 6))
            window["load_gradient"], back = ("load", step_over), 5
        if has("voltage", "current"):
            row["apparent_power_proxy"] = x("voltage") * x("current")
    elif domain == "telecom_churn":
        if has("tenure", "arpu"):
            row["lifetime_value_proxy"] = x("tenure") * x("arpu")
        if has("usage"):
            scaled["usage_z"] = "usage"
    elif domain == "agriculture_iot":
        if has("moisture"):
            window["moisture_gradient"], back = ("moisture", step_over), 1
        if has("moisture", "rain"):
            row["irrigation_stress"] = ratio(x("moisture"), _or(x("rain"), 0.0) + 1.0)
        if has("ph"):
            row["ph_dev_neutral"] = F.abs(x("ph") - 7.0)
    elif domain == "hr_people":
        if has("salary"):
            scaled["salary_z"] = "salary"
        if has("attrition"):
            row["attrition_flag"] = _or(x("attrition"), 0.0)
    return row, window, back, scaled


def add_features(
    df: DataFrame, domain: str, order_by: Sequence[str] = (), partition_by: Sequence[str] = (), **options
) -> DataFrame:
    """Add the feature columns of a domain. ``order_by`` is needed by domains with windowed features."""
    original = df.columns
    found = {part: resolve(original, *hints) for part, hints in HINTS.items()}
    row, window, back, scaled = _plan(
        domain, lambda *parts: all(found[p] for p in parts), lambda part: number(df, found[part])
    )
    new = dict(row)
    if scaled:
        aggs = []
        for name, part in scaled.items():
            aggs += [F.avg(number(df, found[part])).alias(f"m_{name}"), F.stddev_samp(number(df, found[part])).alias(f"s_{name}")]
        stats = df.agg(*aggs).first()
        for name, part in scaled.items():
            mean = F.lit(stats[f"m_{name}"]).cast("double")
            # A zero or missing deviation leaves the centred value as it is.
            new[name] = (number(df, found[part]) - mean) / F.lit(stats[f"s_{name}"] or 1.0)
    out = df.withColumns(new) if new else df
    if window:
        if not order_by:
            raise ValueError(f"features of {domain} follow the row order; pass order_by")
        helpers = {f"_w_{part}": number(df, found[part]) for part, _ in window.values()}
        made = {name: make(f"_w_{part}") for name, (part, make) in window.items()}
        out = trailing(out.withColumns(helpers), made, back, order_by, partition_by, **options).drop(*helpers)
    order = original + [n for n in _order(domain) if n in out.columns and n not in original]
    return out.select(*[f"`{n}`" for n in order])


def _order(domain: str) -> list[str]:
    # Names of the produced columns.
    return {
        "healthcare": ["BMI", "BRISK_SCORE"],
        "predictive_maintenance": ["temp_gradient", "vib_rolling_std", "thermal_mech_index", "pressure_flow_ratio"],
        "sales_forecasting": ["ASP", "revenue_ma7", "revenue_pct_change"],
        "finance_risk": ["DTI_proxy", "credit_score_z"],
        "warehouse_logistics": ["days_of_cover", "lead_time_ma"],
        "energy_utilities": ["load_rolling_std", "load_gradient", "apparent_power_proxy"],
        "telecom_churn": ["lifetime_value_proxy", "usage_z"],
        "agriculture_iot": ["moisture_gradient", "irrigation_stress", "ph_dev_neutral"],
        "hr_people": ["salary_z", "attrition_flag"],
    }.get(domain, [])
