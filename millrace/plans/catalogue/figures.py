"""KPIs, comparisons, features, the star build and the value of losses."""

from pyspark.sql import functions as F

from millrace.operators import kpis as kp
from millrace.operators.features import add_features
from millrace.operators.risk import action_findings, risk_score, rule_risk
from millrace.operators.star import money_impact, star
from millrace.plans.catalogue.base import DERIVED, query, rounded


def _missing(columns: str, source: str) -> str:
    parts = " + ".join(f"COUNT(*) FILTER (WHERE {c} IS NULL)" for c in columns.split())
    return f"100.0 * ({parts}) / (COUNT(*) * {len(columns.split())})"


# Derived table and columns per pack, and the SQL of every KPI.
_PACKS = {
    "predictive_maintenance": ("readings", "event_id timestamp machine_id location temperature vibration pressure speed rul failure", {
        "Mean_temp": "AVG(temperature)", "Mean_vib": "AVG(vibration)", "Mean_pressure": "AVG(pressure)",
        "Failure_Count": "SUM(COALESCE(failure, 0))", "Min_RUL": "MIN(rul)",
    }),
    "healthcare": ("patients", "event_id patient_id age bp glucose weight height readmission", {
        "Mean_Age": "AVG(age)", "Mean_BP": "AVG(bp)", "Mean_Glucose": "AVG(glucose)",
        "Patients": "COUNT(DISTINCT patient_id)", "Readmission%": "100 * AVG(COALESCE(readmission, 0))",
        "Mean_BMI": "AVG(weight / POWER(CASE WHEN height > 3 THEN height / 100.0 ELSE height END, 2))",
    }),
    "education": ("students", "student_id math_score attendance course", {
        "Students": "COUNT(DISTINCT student_id)", "Mean_Score": "AVG(math_score)", "Mean_Attendance": "AVG(attendance)",
    }),
    "sales_forecasting": ("sales", "order_id customer_id sku region order_date revenue units product", {
        "Total_Revenue": "SUM(revenue)", "Avg_Order": "AVG(revenue)", "Units": "SUM(units)",
        "Customers": "COUNT(DISTINCT customer_id)", "SKUs": "COUNT(DISTINCT sku)",
    }),
    "telecom_churn": ("subscribers", "subscriber_id churn tenure arpu data_usage plan", {
        "Churn%": "100 * AVG(churn)", "Mean_Tenure": "AVG(tenure)", "Mean_ARPU": "AVG(arpu)",
        "Subscribers": "COUNT(DISTINCT subscriber_id)",
    }),
    "finance_risk": ("loans", "application_id loan_amount income default_flag credit_score", {
        "Default%": "100 * AVG(default_flag)", "Mean_Loan": "AVG(loan_amount)", "Mean_Income": "AVG(income)",
        "Mean_Score": "AVG(credit_score)",
    }),
    "warehouse_logistics": ("stock", "sku inventory demand lead_time shipments warehouse", {
        "Total_Stock": "SUM(inventory)", "Mean_LeadTime": "AVG(lead_time)", "Shipments": "SUM(shipments)",
        "SKUs": "COUNT(DISTINCT sku)",
    }),
    "energy_utilities": ("meters", "event_id timestamp load voltage current", {
        "Mean_Load": "AVG(load)", "Peak_Load": "MAX(load)", "Mean_Voltage": "AVG(voltage)", "Mean_Current": "AVG(current)",
    }),
    "agriculture_iot": ("fields", "event_id timestamp moisture rainfall ph crop_yield", {
        "Mean_Moisture": "AVG(moisture)", "Mean_Rainfall": "AVG(rainfall)", "Mean_pH": "AVG(ph)", "Mean_Yield": "AVG(crop_yield)",
    }),
    "hr_people": ("staff", "employee_id salary department attrition", {
        "Headcount": "COUNT(DISTINCT employee_id)", "Mean_Salary": "AVG(salary)",
        "Attrition%": "100 * AVG(COALESCE(attrition, 0))", "Departments": "COUNT(DISTINCT department)",
    }),
    "generic": ("customer", "c_custkey c_name c_nationkey c_acctbal c_mktsegment", {
        "Mean_c_custkey": "AVG(c_custkey)", "Mean_c_nationkey": "AVG(c_nationkey)", "Mean_c_acctbal": "AVG(c_acctbal)",
    }),
}

for _domain, (_source, _columns, _kpis) in _PACKS.items():
    _measures = {"Rows": "COUNT(*)", "Cols": str(len(_columns.split())), "Missing%": _missing(_columns, _source), **_kpis}
    # One pass in the check as well: every measure becomes a column, then a row.
    _aggs = ", ".join(f'CAST({e} AS DOUBLE) AS m{i}' for i, e in enumerate(_measures.values()))
    _rows = " UNION ALL ".join(f"SELECT '{k}' AS kpi, ROUND(m{i}, 4) AS value FROM one" for i, k in enumerate(_measures))

    @query(f"kpi_{_domain}", f"WITH one AS (SELECT {_aggs} FROM {_source}) {_rows}", using=(_source,) if _source in DERIVED else ())
    def _kpi(t, domain=_domain, source=_source):
        return rounded(kp.kpi_table(getattr(t, source), domain), 4)


@query(
    "loc_to_loc",
    """SELECT region AS location, ROUND(AVG(revenue), 4) AS mean, ROUND(SUM(revenue), 4) AS sum, COUNT(revenue) AS rows
       FROM sales GROUP BY region""",
    using=("sales",),
)
def loc_to_loc(t):
    return rounded(kp.compare_locations(t.sales, "sales_forecasting"), 4)


@query(
    "loc_to_loc_null_group",
    """SELECT l AS location, ROUND(AVG(temperature), 6) AS mean, ROUND(COALESCE(SUM(temperature), 0), 4) AS sum, COUNT(temperature) AS rows
       FROM (SELECT CASE WHEN location = 'view' THEN NULL ELSE location END AS l, temperature FROM readings) GROUP BY l""",
    using=("readings",),
)
def loc_to_loc_null_group(t):
    gaps = t.readings.withColumn("location", F.expr("CASE WHEN location = 'view' THEN NULL ELSE location END"))
    out = kp.compare_locations(gaps, "predictive_maintenance")
    return out.select("location", F.round("mean", 6).alias("mean"), F.round("sum", 4).alias("sum"), "rows")


@query(
    "time_to_time",
    """SELECT STRFTIME(order_date, '%Y-%m') AS period, ROUND(AVG(revenue), 4) AS mean, ROUND(SUM(revenue), 4) AS sum, COUNT(revenue) AS rows
       FROM sales GROUP BY 1""",
    using=("sales",),
)
def time_to_time(t):
    return rounded(kp.compare_months(t.sales, "sales_forecasting"), 4)


@query(
    "period_trend",
    """WITH m AS (SELECT STRFTIME(order_date, '%Y-%m') AS period, AVG(revenue) AS mean FROM sales GROUP BY 1),
            i AS (SELECT mean, ROW_NUMBER() OVER (ORDER BY period) - 1 AS pos FROM m)
       SELECT ROUND(REGR_SLOPE(mean, pos), 6) AS slope, COUNT(*) AS points, ROUND(ARG_MAX(mean, pos), 6) AS last_value FROM i""",
    using=("sales",),
)
def period_trend(t):
    return rounded(kp.period_trend(kp.compare_months(t.sales, "sales_forecasting")))


@query("next_period_forecast")
def next_period_forecast(t):
    return rounded(kp.next_period(kp.compare_months(t.order_sales, "sales_forecasting")), 4)


@query(
    "group_spread",
    """WITH g AS (SELECT region, AVG(revenue) AS m FROM sales GROUP BY region)
       SELECT (SELECT region FROM g ORDER BY m, region LIMIT 1) AS lowest, ROUND(MIN(m), 6) AS low,
              (SELECT region FROM g ORDER BY m DESC, region DESC LIMIT 1) AS highest, ROUND(MAX(m), 6) AS high,
              ROUND(MAX(m) - MIN(m), 6) AS gap FROM g""",
    using=("sales",),
)
def group_spread(t):
    return rounded(kp.spread(t.sales, "region", "revenue"))


@query(
    "relation",
    """SELECT ROUND(CORR(l_quantity, l_extendedprice), 6) AS correlation,
              ROUND(REGR_SLOPE(l_extendedprice, l_quantity), 4) AS slope, COUNT(*) AS points FROM lineitem""",
)
def relation(t):
    out = kp.relation(t.lineitem, "l_quantity", "l_extendedprice")
    return out.select(F.round("correlation", 6).alias("correlation"), F.round("slope", 4).alias("slope"), "points")


@query(
    "money_impact_plant",
    """WITH s AS (SELECT SUM(downtime_minutes) / 60.0 AS hours, CAST(SUM(scrap) AS DOUBLE) AS qty_loss FROM plant)
       SELECT ROUND(hours, 4) AS hours, ROUND(qty_loss, 4) AS qty_loss, 0.0 AS revenue_total, TRUE AS minutes_assumed,
              ROUND(hours * 120, 4) AS downtime_usd, ROUND(qty_loss * 4, 4) AS qty_usd, 0.0 AS revenue_usd,
              ROUND(hours * 120 + qty_loss * 4, 4) AS total_usd, TRUE AS ok FROM s""",
    using=("plant",),
)
def money_impact_plant(t):
    return rounded(money_impact(t.plant, 120.0, 4.0, domain="plant_oee"), 4)


@query(
    "money_impact_sales",
    """SELECT 0.0 AS hours, 0.0 AS qty_loss, ROUND(SUM(revenue), 4) AS revenue_total, FALSE AS minutes_assumed, 0.0 AS downtime_usd,
              0.0 AS qty_usd, ROUND(SUM(revenue), 4) AS revenue_usd, ROUND(SUM(revenue), 4) AS total_usd, TRUE AS ok FROM sales""",
    using=("sales",),
)
def money_impact_sales(t):
    return rounded(money_impact(t.sales, domain="sales"), 4)


@query(
    "star_fact",
    """SELECT STRFTIME(order_date, '%Y-%m-%d') AS date_key, COALESCE(channel, 'nan') AS entity_key,
              ROUND(SUM(revenue), 2) AS revenue, ROUND(SUM(units), 2) AS units, COUNT(*) AS fact_rows
       FROM order_sales GROUP BY 1, 2""",
    using=("order_sales",),
)
def star_fact(t):
    fact = star(t.order_sales, "channel", ["revenue", "units"], "order_date")["fact"]
    return rounded(fact.withColumn("date_key", F.date_format("date_key", "yyyy-MM-dd")), 2)


@query(
    "star_date_dim",
    """SELECT DISTINCT STRFTIME(order_date, '%Y-%m-%d') AS date_key, YEAR(order_date) AS year, MONTH(order_date) AS month,
              DAY(order_date) AS day, DAYNAME(order_date) AS weekday FROM order_sales""",
    using=("order_sales",),
)
def star_date_dim(t):
    dim = star(t.order_sales, "channel", ["revenue"], "order_date")["date_dim"]
    return rounded(dim.withColumn("date_key", F.date_format("date_key", "yyyy-MM-dd")))


@query(
    "star_entity_dim",
    "SELECT DISTINCT CAST(customer_id AS VARCHAR) AS entity_key, 'customer_id' AS entity_role FROM order_sales",
    using=("order_sales",),
)
def star_entity_dim(t):
    return star(t.order_sales, "customer_id", ["revenue"])["entity_dim"]


def _z(column: str, source: str) -> str:
    return f"({column} - (SELECT AVG({column}) FROM {source})) / (SELECT STDDEV_SAMP({column}) FROM {source})"


# Source, key, order and the SQL of the produced columns.
_FEATURES = {
    "healthcare": ("patients", "event_id", "event_id", {
        "BMI": "weight / POWER(CASE WHEN height > 3 THEN height / 100.0 ELSE height END, 2)",
        "BRISK_SCORE": "COALESCE(bp, 120) / 120 + COALESCE(glucose, 100) / 100 + COALESCE(age, 40) / 100",
    }),
    "predictive_maintenance": ("readings", "event_id", "event_id", {
        "temp_gradient": "temperature - LAG(temperature) OVER (ORDER BY event_id)",
        "vib_rolling_std": "STDDEV_SAMP(vibration) OVER (ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)",
        "thermal_mech_index": "COALESCE(temperature, 0) / 100 + COALESCE(vibration, 0)",
    }),
    "sales_forecasting": ("order_sales", "order_id", "order_id", {
        "ASP": "CASE WHEN units <> 0 THEN revenue / units END",
        "revenue_ma7": "AVG(revenue) OVER (ORDER BY order_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)",
        "revenue_pct_change": "(revenue - LAG(revenue) OVER (ORDER BY order_id)) / NULLIF(LAG(revenue) OVER (ORDER BY order_id), 0)",
    }),
    "finance_risk": ("loans", "application_id", "application_id", {
        "DTI_proxy": "CASE WHEN income <> 0 THEN loan_amount / income END", "credit_score_z": _z("credit_score", "loans"),
    }),
    "warehouse_logistics": ("stock", "sku", "sku", {
        "days_of_cover": "CASE WHEN demand <> 0 THEN inventory / demand END",
        "lead_time_ma": "AVG(lead_time) OVER (ORDER BY sku ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)",
    }),
    "energy_utilities": ("meters", "event_id", "event_id", {
        "load_rolling_std": "STDDEV_SAMP(load) OVER (ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)",
        "load_gradient": "load - LAG(load) OVER (ORDER BY event_id)", "apparent_power_proxy": "voltage * current",
    }),
    "telecom_churn": ("subscribers", "subscriber_id", "subscriber_id", {
        "lifetime_value_proxy": "tenure * arpu", "usage_z": _z("data_usage", "subscribers"),
    }),
    "agriculture_iot": ("fields", "event_id", "event_id", {
        "moisture_gradient": "moisture - LAG(moisture) OVER (ORDER BY event_id)",
        "irrigation_stress": "moisture / (COALESCE(rainfall, 0) + 1)", "ph_dev_neutral": "ABS(ph - 7)",
    }),
    "hr_people": ("staff", "employee_id", "employee_id", {
        "salary_z": _z("salary", "staff"), "attrition_flag": "COALESCE(attrition, 0)",
    }),
}

for _domain, (_source, _key, _order, _columns) in _FEATURES.items():
    # Statistics are rounded to six places; plain arithmetic gives short decimals and keeps nine.
    _digits = {n: 6 if "(ORDER" in e or "STDDEV" in e else 9 for n, e in _columns.items()}
    _select = ", ".join(f"ROUND({e}, {_digits[n]}) AS {n}" for n, e in _columns.items())

    @query(f"features_{_domain}", f"SELECT {_key}, {_select} FROM {_source}", using=(_source,))
    def _features(t, domain=_domain, source=_source, key=_key, order=_order, digits=_digits):
        return rounded(add_features(getattr(t, source), domain, [order]).select(key, *digits), special=digits)


@query(
    "risk_rules",
    """WITH s AS (SELECT AVG(vibration) AS m, STDDEV_SAMP(vibration) AS d FROM readings),
            f AS (SELECT *, temperature - LAG(temperature) OVER (ORDER BY event_id) AS step FROM readings),
            l AS (SELECT * FROM f QUALIFY ROW_NUMBER() OVER (PARTITION BY machine_id ORDER BY event_id DESC) = 1)
       SELECT machine_id AS entity, CAST(15 + CASE WHEN vibration > m + 2 * d THEN 25 ELSE 0 END
              + CASE WHEN temperature > 90 THEN 15 ELSE 0 END + CASE WHEN ABS(step) > 10 THEN 20 ELSE 0 END AS DOUBLE) AS rule_risk
       FROM l, s""",
    using=("readings",),
)
def risk_rules(t):
    work = add_features(t.readings, "predictive_maintenance", ["event_id"])
    return rule_risk(work, "predictive_maintenance", ["event_id"], "machine_id")


@query("risk_score")
def risk(t):
    return rounded(risk_score(t.readings, "predictive_maintenance", ["event_id"]), 4)


@query("risk_by_machine")
def risk_by_machine(t):
    """Rules, anomalies and failure probability of each machine by its own rows."""
    return rounded(risk_score(t.readings, "predictive_maintenance", ["event_id"], "machine_id"), 4)


@query(
    "actions_maintenance",
    """WITH s AS (SELECT AVG(vibration) + 2 * STDDEV_SAMP(vibration) AS cut FROM readings),
            h AS (SELECT * FROM readings, s WHERE vibration >= cut ORDER BY event_id DESC LIMIT 1)
       SELECT CAST(1 AS BIGINT) AS priority, FORMAT('ALERT: bearing wear pattern on {}, vibration spiked to {:.2f}.', machine_id, vibration) AS text FROM h
       UNION ALL SELECT 2, 'Schedule maintenance within 8-12 h, inspect bearings, verify the temperature gradient.'""",
    using=("readings",),
)
def actions_maintenance(t):
    return rounded(action_findings(t.readings, "predictive_maintenance", ["event_id"]))


@query(
    "actions_sales",
    """WITH g AS (SELECT region, AVG(revenue) AS m FROM sales GROUP BY region),
            a AS (SELECT * FROM g ORDER BY m, region LIMIT 1), b AS (SELECT * FROM g ORDER BY m DESC, region DESC LIMIT 1)
       SELECT CAST(1 AS BIGINT) AS priority,
              FORMAT('Revenue soft spot: {} (avg={:.2f}) against leader {} ({:.2f}).', a.region, a.m, b.region, b.m) AS text FROM a, b
       UNION ALL SELECT 2, 'Promote the weak region, re-check stockouts, run the outlook.'""",
    using=("sales",),
)
def actions_sales(t):
    return rounded(action_findings(t.sales, "sales_forecasting", ["order_id"]))


@query(
    "actions_churn",
    """SELECT CAST(1 AS BIGINT) AS priority,
              FORMAT('Churn rate {:.1f}%: put the high-tenure, low-ARPU cohort first.', 100 * AVG(churn)) AS text FROM subscribers
       UNION ALL SELECT 2, 'Retention offers, call-drop analysis, win-back campaign.'""",
    using=("subscribers",),
)
def actions_churn(t):
    return rounded(action_findings(t.subscribers, "telecom_churn", ["subscriber_id"]))


