"""Cleaning steps, windows and other order-sensitive work."""

from pyspark.sql import functions as F

from millrace.functions.cast import moment
from millrace.operators import clean as cl
from millrace.operators import windows as win
from millrace.operators.kpis import apply_filters, date_bounds, filter_values
from millrace.operators.ordering import row_index
from millrace.operators.profile import column_profile
from millrace.plans.catalogue.base import query, rounded

# Small buckets make the registered queries run the bucketed plan also on small tables.
BUCKET = 2_000

_JUNK = """
    SELECT event_id, user_id,
           CASE event_type WHEN 'signup' THEN 'NA' WHEN 'view' THEN ' NA ' WHEN 'click' THEN '--' ELSE event_type END AS kind,
           CASE WHEN event_type = 'error' AND value > 150 THEN 'oops' WHEN event_type = 'view' AND value > 150 THEN 'N/A'
                ELSE CAST(value AS STRING) END AS amount,
           CASE WHEN event_type IN ('error', 'signup') THEN 'x' ELSE CAST(user_id AS STRING) END AS code,
           CASE WHEN event_type = 'click' AND value > 100 THEN 'soon' ELSE SUBSTRING(CAST(ts AS STRING), 1, 10) END AS seen_date
    FROM events"""


@query(
    "clean_dedupe_sentinels",
    """SELECT DISTINCT user_id, CASE event_type WHEN 'signup' THEN NULL WHEN 'view' THEN ' NA ' WHEN 'click' THEN NULL
       ELSE event_type END AS kind, event_type FROM events""",
)
def clean_dedupe_sentinels(t):
    base = t.sql(_JUNK).join(t.events.select("event_id", "event_type"), "event_id").select("user_id", "kind", "event_type")
    twice = base.unionByName(base).toDF(" user_id", "kind ", "event_type")
    return cl.null_sentinels(cl.dedupe(cl.drop_empty_rows(cl.tidy_names(twice))))


@query(
    "dedupe_by_key",
    """SELECT user_id, event_type, event_id, ROUND(value, 6) AS value FROM events
       QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1""",
)
def dedupe_by_key(t):
    kept = cl.dedupe(t.events, ["user_id", "event_type"], ["ts", "event_id"])
    return rounded(kept.select("user_id", "event_type", "event_id", "value"))


@query(
    "clean_casts",
    f"""WITH j AS ({_JUNK})
        SELECT event_id, ROUND(TRY_CAST(amount AS DOUBLE), 6) AS amount, code,
               STRFTIME(TRY_CAST(seen_date AS TIMESTAMP), '%Y-%m-%d') AS seen_date FROM j""",
)
def clean_casts(t):
    typed, _ = cl.cast_texts(cl.null_sentinels(t.sql(_JUNK)))
    return rounded(typed.select("event_id", "amount", "code", F.date_format("seen_date", "yyyy-MM-dd").alias("seen_date")))


@query(
    "clean_full",
    """WITH i AS (SELECT event_id, temperature, vibration, ROW_NUMBER() OVER (ORDER BY event_id) - 1 AS pos FROM readings),
            f AS (SELECT REGR_SLOPE(temperature, pos) AS a, REGR_INTERCEPT(temperature, pos) AS b FROM i),
            g AS (SELECT event_id, COALESCE(temperature, b + a * pos) AS temperature, vibration FROM i, f)
       SELECT event_id, ROUND(temperature, 6) AS temperature,
              ROUND(AVG(temperature) OVER w, 6) AS temperature_smooth, ROUND(AVG(vibration) OVER w, 6) AS vibration_smooth
       FROM g WINDOW w AS (ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
    using=("readings",),
)
def clean_full(t):
    raw = t.readings
    cleaned, _ = cl.clean(raw.unionByName(raw), ["event_id"])
    return rounded(cleaned.select("event_id", "temperature", "temperature_smooth", "vibration_smooth"))


@query(
    "clean_median_variant",
    """SELECT event_id, ROUND(COALESCE(bp, (SELECT QUANTILE_CONT(bp, 0.5) FROM patients)), 6) AS bp FROM patients""",
    using=("patients",),
)
def clean_median_variant(t):
    raw = t.patients.withColumn("empty", F.lit(None).cast("string"))
    cleaned, _ = cl.clean(raw, ["event_id"], impute="median", bins=False)
    return rounded(cleaned.select("event_id", "bp"))


@query(
    "impute_trend",
    """WITH i AS (SELECT event_id, temperature, ROW_NUMBER() OVER (ORDER BY timestamp, event_id) - 1 AS pos FROM readings),
            f AS (SELECT REGR_SLOPE(temperature, pos) AS a, REGR_INTERCEPT(temperature, pos) AS b FROM i)
       SELECT event_id, ROUND(COALESCE(temperature, b + a * pos), 6) AS temperature FROM i, f""",
    using=("readings",),
)
def impute_trend(t):
    filled = cl.trend_impute(t.readings, ["temperature"], ["timestamp", "event_id"], rows_per_range=BUCKET)
    return rounded(filled.select("event_id", "temperature"))


@query(
    "impute_trend_by_machine",
    """WITH i AS (SELECT event_id, machine_id, temperature,
                         ROW_NUMBER() OVER (PARTITION BY machine_id ORDER BY event_id) - 1 AS pos FROM readings),
            f AS (SELECT machine_id, COUNT(temperature) AS n, REGR_SLOPE(temperature, pos) AS a,
                         REGR_INTERCEPT(temperature, pos) AS b, QUANTILE_CONT(temperature, 0.5) AS m FROM i GROUP BY machine_id)
       SELECT event_id, ROUND(COALESCE(temperature, CASE WHEN n >= 5 THEN b + a * pos ELSE m END), 5) AS temperature
       FROM i JOIN f USING (machine_id)""",
    using=("readings",),
)
def impute_trend_by_machine(t):
    filled = cl.trend_impute(t.readings, ["temperature"], ["event_id"], ["machine_id"])
    return rounded(filled.select("event_id", "temperature"), 5)


@query(
    "impute_median_mode",
    """WITH g AS (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS kind,
                         CASE WHEN event_type = 'view' THEN NULL ELSE value END AS value FROM events),
            m AS (SELECT kind FROM g WHERE kind IS NOT NULL GROUP BY kind ORDER BY COUNT(*) DESC, kind LIMIT 1)
       SELECT event_id, COALESCE(g.kind, (SELECT kind FROM m)) AS kind, 'Unknown' AS note,
              ROUND(COALESCE(value, (SELECT QUANTILE_CONT(value, 0.5) FROM g)), 6) AS value FROM g""",
)
def impute_median_mode(t):
    gaps = t.events.select(
        "event_id", F.expr("CASE WHEN event_type = 'error' THEN NULL ELSE event_type END").alias("kind"),
        F.lit(None).cast("string").alias("note"), F.expr("CASE WHEN event_type = 'view' THEN NULL ELSE value END").alias("value"),
    )
    return rounded(cl.mode_impute(cl.median_impute(gaps, ["value"])))


@query(
    "bins_quantile",
    """WITH e AS (SELECT QUANTILE_CONT(o_totalprice, 0.2) AS a, QUANTILE_CONT(o_totalprice, 0.4) AS b,
                         QUANTILE_CONT(o_totalprice, 0.6) AS c, QUANTILE_CONT(o_totalprice, 0.8) AS d FROM orders)
       SELECT o_orderkey, CAST(1 + (o_totalprice > a)::INT + (o_totalprice > b)::INT + (o_totalprice > c)::INT
              + (o_totalprice > d)::INT AS BIGINT) AS bin FROM orders, e""",
)
def bins_quantile(t):
    binned = cl.quantile_bins(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice"], number_suffix="_no")
    return rounded(binned.select("o_orderkey", F.col("o_totalprice_no").alias("bin")))


@query(
    "bins_repeated_edges",
    """WITH e AS (SELECT QUANTILE_CONT(failure, 0) AS lo, QUANTILE_CONT(failure, 1) AS hi FROM readings)
       SELECT event_id, CASE WHEN lo < hi THEN '(-0.001, 1.0]' END AS failure_bin FROM readings, e""",
    using=("readings",),
)
def bins_repeated_edges(t):
    return cl.quantile_bins(t.readings.select("event_id", "failure"), ["failure"]).select("event_id", "failure_bin")


@query(
    "lab_transforms",
    """WITH e AS (SELECT QUANTILE_CONT(value, 0.25) AS a, QUANTILE_CONT(value, 0.5) AS b, QUANTILE_CONT(value, 0.75) AS c,
                         AVG(value) AS m, STDDEV_SAMP(value) AS s FROM events)
       SELECT event_id, CAST(1 + (value > a)::INT + (value > b)::INT + (value > c)::INT AS BIGINT) AS bin,
              ROUND(AVG(value) OVER (ORDER BY event_id ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), 6) AS value_dwdm_smooth,
              ROUND((value - m) / (s + 1e-9), 6) AS value_z FROM events, e""",
)
def lab_transforms(t):
    out, _ = cl.lab_transforms(t.events, ["event_id"], ["value"], ["value"], ["value"])
    edges = cl.bin_edges(t.events, ["value"], 4)["value"]
    labels = cl.bin_labels(edges)
    number = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("value_dwdm_bin"))
    return rounded(out.select("event_id", number.alias("bin"), "value_dwdm_smooth", "value_z"))


@query(
    "smooth_keyed",
    """SELECT event_id, ROUND(AVG(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
       ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS value_smooth FROM events""",
)
def smooth_keyed(t):
    out = cl.smooth(t.events, ["value"], ["ts", "event_id"], 5, ["user_id"])
    return rounded(out.select("event_id", "value_smooth"))


@query(
    "smooth_keyed_split",
    """SELECT event_id, ROUND(AVG(value) OVER (PARTITION BY event_type ORDER BY ts, event_id
       ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS value_smooth FROM events""",
)
def smooth_keyed_split(t):
    """Few large groups: every group is cut into buckets."""
    out = cl.smooth(t.events, ["value"], ["ts", "event_id"], 5, ["event_type"], rows_per_range=400)
    return rounded(out.select("event_id", "value_smooth"))


@query(
    "smooth_global",
    """SELECT event_id, ROUND(AVG(value) OVER (ORDER BY ts, event_id
       ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS value_smooth FROM events""",
)
def smooth_global(t):
    out = cl.smooth(t.events, ["value"], ["ts", "event_id"], 5, rows_per_range=BUCKET)
    return rounded(out.select("event_id", "value_smooth"))


@query("row_index", "SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS at FROM orders")
def row_positions(t):
    return row_index(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], "at", BUCKET).select("o_orderkey", "at")


@query(
    "znorm",
    """SELECT event_id, ROUND((value - (SELECT AVG(value) FROM events)) / ((SELECT STDDEV_SAMP(value) FROM events) + 1e-9), 6)
       AS value_z FROM events""",
)
def znorm(t):
    return rounded(cl.znorm(t.events, ["value"]).select("event_id", "value_z"))


@query(
    "filters",
    """SELECT order_id, sku, region, ROUND(revenue, 4) AS revenue FROM sales
       WHERE region IN ('NATION_1', 'NATION_7') AND order_date >= TIMESTAMP '1996-01-01' AND order_date <= TIMESTAMP '1997-12-31'""",
    using=("sales",),
)
def filters(t):
    kept = apply_filters(t.sales, ["NATION_1", "NATION_7"], None, "1996-01-01", "1997-12-31")
    return rounded(kept.select("order_id", "sku", "region", "revenue"), 4)


@query(
    "filters_people",
    """SELECT event_id, machine_id FROM (SELECT event_id, timestamp, 'user ' || machine_id AS machine_id, machine_id AS user_id FROM readings)
       WHERE user_id IN ('M3', 'M5') AND timestamp <= TIMESTAMP '2024-01-20'""",
    using=("readings",),
)
def filters_people(t):
    named = t.readings.select("event_id", "timestamp", F.concat(F.lit("user "), "machine_id").alias("machine_id"), F.col("machine_id").alias("user_id"))
    return apply_filters(named, None, ["M3", "M5"], None, "2024-01-20").select("event_id", "machine_id")


@query("filter_values", "SELECT DISTINCT region AS value FROM sales ORDER BY value LIMIT 200", using=("sales",))
def location_values(t):
    return filter_values(t.sales, "location")


@query(
    "date_bounds",
    "SELECT CAST(MIN(order_date) AS DATE) AS first_day, CAST(MAX(order_date) AS DATE) AS last_day FROM sales",
    using=("sales",),
)
def bounds(t):
    return date_bounds(t.sales)


@query(
    "diff_std_pct",
    """SELECT event_id, ROUND(value - LAG(value) OVER w, 6) AS step,
              ROUND(CASE WHEN LAG(value) OVER w <> 0 THEN (value - LAG(value) OVER w) / LAG(value) OVER w END, 6) AS change,
              ROUND(STDDEV_SAMP(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS std5
       FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def diff_std_pct(t):
    made = {"step": win.step_over("value"), "change": win.change_over("value"), "std5": win.std_over("value", 5)}
    return rounded(win.rolling(t.events, made, 4, ["ts", "event_id"], ["user_id"]).select("event_id", *made))


@query(
    "diff_std_global",
    """SELECT event_id, ROUND(value - LAG(value) OVER (ORDER BY ts, event_id), 6) AS step,
              ROUND(STDDEV_SAMP(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 6) AS std6
       FROM events""",
)
def diff_std_global(t):
    made = {"step": win.step_over("value"), "std6": win.std_over("value", 6)}
    return rounded(win.rolling(t.events, made, 5, ["ts", "event_id"], rows_per_range=BUCKET).select("event_id", *made))


@query(
    "latest_per_entity",
    """SELECT user_id, event_id, event_type, value FROM events
       QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def latest_per_entity(t):
    narrow = t.events.select("user_id", "event_id", "event_type", "value", "ts")
    return win.latest(narrow, ["ts", "event_id"], ["user_id"]).drop("ts")


@query("latest_row", "SELECT event_id, user_id, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
def latest_row(t):
    return win.latest(t.events, ["ts", "event_id"]).select("event_id", "user_id", "event_type", "value")


@query("last_n", "SELECT event_id, user_id, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def last_n(t):
    return win.last_rows(t.events, 500, ["ts", "event_id"]).select("event_id", "user_id", "value")


@query(
    "last_n_per_entity",
    """SELECT event_id, user_id, value FROM events
       QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3""",
)
def last_n_per_entity(t):
    return win.last_rows(t.events, 3, ["ts", "event_id"], ["user_id"]).select("event_id", "user_id", "value")


@query(
    "trend_slope",
    """WITH l AS (SELECT value, ts, event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50),
            i AS (SELECT value, ROW_NUMBER() OVER (ORDER BY ts, event_id) - 1 AS pos FROM l),
            w AS (SELECT value, ROW_NUMBER() OVER (ORDER BY ts, event_id) - 1 AS pos FROM events)
       SELECT 'last 50' AS span, ROUND(REGR_SLOPE(value, pos), 8) AS slope, COUNT(*) AS points FROM i
       UNION ALL SELECT 'all', ROUND(REGR_SLOPE(value, pos), 8), COUNT(*) FROM w""",
)
def trend_slope(t):
    parts = []
    for name, last in (("last 50", 50), ("all", None)):
        found = win.trend_slope(t.events, "value", ["ts", "event_id"], last)
        parts.append(found.select(F.lit(name).alias("span"), "slope", "points"))
    return rounded(parts[0].unionByName(parts[1]), 8)


@query(
    "describe_recent",
    """WITH l AS (SELECT temperature AS v FROM readings WHERE temperature IS NOT NULL ORDER BY event_id DESC LIMIT 200)
       SELECT 'count' AS statistic, CAST(COUNT(v) AS DOUBLE) AS value FROM l UNION ALL SELECT 'mean', ROUND(AVG(v), 6) FROM l
       UNION ALL SELECT 'stddev', ROUND(STDDEV_SAMP(v), 6) FROM l UNION ALL SELECT 'min', ROUND(MIN(v), 6) FROM l
       UNION ALL SELECT 'max', ROUND(MAX(v), 6) FROM l""",
    using=("readings",),
)
def describe_recent(t):
    return rounded(win.describe_recent(t.readings, "temperature", ["event_id"]))


@query(
    "last_per_time",
    """SELECT STRFTIME(o_orderdate, '%Y-%m-%d') AS day, o_orderkey, o_totalprice FROM orders
       QUALIFY ROW_NUMBER() OVER (PARTITION BY o_orderdate ORDER BY o_orderkey DESC) = 1""",
)
def last_per_time(t):
    kept = win.last_per_time(t.orders, "o_orderdate", ["o_orderkey"])
    return kept.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderkey", "o_totalprice")


@query(
    "resample_days",
    """WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, o_totalprice AS v FROM orders),
            c AS (SELECT UNNEST(GENERATE_SERIES((SELECT MIN(day) FROM d), (SELECT MAX(day) FROM d), INTERVAL 1 DAY)) AS day)
       SELECT STRFTIME(c.day, '%Y-%m-%d') AS period, ROUND(COALESCE(SUM(v), 0), 2) AS value, COUNT(v) AS n
       FROM c LEFT JOIN d ON CAST(c.day AS DATE) = d.day GROUP BY c.day""",
)
def resample_days(t):
    out = win.series(t.orders, moment(t.orders, "o_orderdate"), F.col("o_totalprice"))
    return rounded(out.select(F.date_format("period", "yyyy-MM-dd").alias("period"), "value", "n"), 2)


@query(
    "first_seen_texts",
    r"""SELECT MIN(doc_id) AS doc_id FROM documents GROUP BY LOWER(TRIM(REGEXP_REPLACE(text, '\s+', ' ', 'g')))""",
)
def first_seen_texts(t):
    return win.first_seen(t.documents.select("doc_id", "text"), "text", ["doc_id"]).select("doc_id")


@query(
    "group_extremes",
    """WITH g AS (SELECT region, AVG(revenue) AS m FROM sales GROUP BY region)
       SELECT (SELECT region FROM g ORDER BY m DESC, region DESC LIMIT 1) AS leader, ROUND(MAX(m), 6) AS leader_value,
              (SELECT region FROM g ORDER BY m, region LIMIT 1) AS laggard, ROUND(MIN(m), 6) AS laggard_value FROM g""",
    using=("sales",),
)
def group_extremes(t):
    means = t.sales.groupBy("region").agg(F.avg("revenue").alias("m"))
    return rounded(win.extremes(means, "region", "m"))


_PROFILE = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", COUNT(*) AS rows, COUNT({c}) AS non_null, COUNT(DISTINCT {c}) AS "distinct",
        COALESCE(MIN({c}) = MAX({c}), TRUE) AS constant, {f'COUNT(*) FILTER (WHERE {c} = 0)' if z else 'CAST(0 AS BIGINT)'} AS zeros FROM p"""
    for c, z in (("event_id", 1), ("temperature", 1), ("failure", 1), ("machine_id", 0), ("location", 0))
)


@query(
    "column_profile",
    f"WITH p AS (SELECT event_id, temperature, failure, machine_id, location FROM readings) {_PROFILE}",
    using=("readings",),
)
def profile(t):
    columns = t.readings.select("event_id", "temperature", "failure", "machine_id", "location")
    return column_profile(columns).select("column", "rows", "non_null", "distinct", "constant", "zeros")
