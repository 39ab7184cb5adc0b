"""Quality checks, single and as the full report."""

from pyspark.sql import functions as F

from millrace.operators import quality as qa
from millrace.operators.anomaly import anomaly_summary, score_rows
from millrace.operators.baskets import association_of_highs
from millrace.operators.density import dbscan_points, dbscan_summary
from millrace.operators.neighbours import knn_outliers
from millrace.operators.profile import bounded_profile, categories, column_kinds
from millrace.operators.quantiles import exact_quantiles
from millrace.plans.catalogue.base import kinds_sql, query, rounded
from millrace.session import checkpoint


@query(
    "duplicate_rows",
    """SELECT CAST(COUNT(*) - COUNT(DISTINCT (c_nationkey, c_mktsegment)) AS BIGINT) AS duplicate_rows FROM customer""",
)
def duplicate_rows(t):
    return qa.duplicate_rows(t.customer.select("c_nationkey", "c_mktsegment"))


@query(
    "quality_outliers",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", COUNT(*) FILTER (WHERE ABS(({c} - m) / (s + 1e-9)) > 3) AS z_hits,
            COUNT(*) FILTER (WHERE q3 > q1 AND ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))) AS iqr_hits
            FROM {t}, (SELECT AVG({c}) AS m, STDDEV_SAMP({c}) AS s, QUANTILE_CONT({c}, 0.25) AS q1, QUANTILE_CONT({c}, 0.75) AS q3 FROM {t})"""
        for t, c in (("events", "value"), ("events", "user_id"), ("lineitem", "l_extendedprice"), ("lineitem", "l_discount"))
    ),
)
def quality_outliers(t):
    a = qa.outlier_counts(t.events, ["value", "user_id"])
    return a.unionByName(qa.outlier_counts(t.lineitem, ["l_extendedprice", "l_discount"]))


@query(
    "quantiles",
    """SELECT 'l_extendedprice' AS name, CAST(q AS DOUBLE) AS prob, ROUND(QUANTILE_CONT(l_extendedprice, q), 6) AS value
       FROM lineitem, (SELECT UNNEST([0.05::DOUBLE, 0.25, 0.5, 0.9]) AS q) GROUP BY q"""
    .replace("QUANTILE_CONT(l_extendedprice, q)", "CASE q WHEN 0.05 THEN QUANTILE_CONT(l_extendedprice, 0.05) WHEN 0.25 THEN "
             "QUANTILE_CONT(l_extendedprice, 0.25) WHEN 0.5 THEN QUANTILE_CONT(l_extendedprice, 0.5) ELSE QUANTILE_CONT(l_extendedprice, 0.9) END"),
)
def quantiles(t):
    """Narrowed bracket by bracket: the limit for handing a bracket to the exact aggregate is set low here."""
    probs = [0.05, 0.25, 0.5, 0.9]
    found = exact_quantiles(t.lineitem, {"p": F.col("l_extendedprice")}, probs, small=500)["p"]
    rows = [("l_extendedprice", p, v) for p, v in zip(probs, found)]
    return rounded(t.spark.createDataFrame(rows, "name string, prob double, value double"))


@query(
    "quality_jumps",
    """WITH s AS (SELECT temperature - LAG(temperature) OVER w AS t, vibration - LAG(vibration) OVER w AS v,
                         pressure - LAG(pressure) OVER w AS p, speed - LAG(speed) OVER w AS sp FROM readings WINDOW w AS (ORDER BY event_id))
       SELECT 'temperature' AS "column", 50.0 AS "limit", COUNT(*) FILTER (WHERE ABS(t) > 50) AS jumps FROM s
       UNION ALL SELECT 'vibration', 5.0, COUNT(*) FILTER (WHERE ABS(v) > 5) FROM s
       UNION ALL SELECT 'pressure', 30.0, COUNT(*) FILTER (WHERE ABS(p) > 30) FROM s
       UNION ALL SELECT 'speed', ROUND((SELECT 4 * STDDEV_SAMP(speed) FROM readings), 6),
                        COUNT(*) FILTER (WHERE ABS(sp) > (SELECT 4 * STDDEV_SAMP(speed) FROM readings)) FROM s""",
    using=("readings",),
)
def quality_jumps(t):
    return rounded(qa.impossible_jumps(t.readings, ["event_id"]))


@query(
    "quality_correlations",
    """SELECT pair, ROUND(c, 6) AS corr, ABS(c) < 0.05 AS dead FROM (
         SELECT 'temperature|pressure' AS pair, CORR(temperature, pressure) AS c FROM readings
         UNION ALL SELECT 'temperature|vibration', CORR(temperature, vibration) FROM readings
         UNION ALL SELECT 'pressure|vibration', CORR(pressure, vibration) FROM readings)""",
    using=("readings",),
)
def quality_correlations(t):
    return rounded(qa.sensor_correlations(t.readings))


@query(
    "quality_physics",
    """WITH s AS (SELECT *, pressure - LAG(pressure) OVER w AS dp, speed - LAG(speed) OVER w AS ds, rul - LAG(rul) OVER w AS dr
                  FROM readings WINDOW w AS (ORDER BY event_id)),
            m AS (SELECT AVG(vibration) + 3 * STDDEV_SAMP(vibration) AS cut FROM readings),
            r AS (SELECT 'sensor stuck (temp>150 & vib<0.1)' AS rule, COUNT(*) FILTER (WHERE temperature > 150 AND vibration < 0.1) AS rows FROM s
                  UNION ALL SELECT 'leak or sensor fault', COUNT(*) FILTER (WHERE dp < -10 AND ABS(ds) < 0.5) FROM s
                  UNION ALL SELECT 'possible missed failures', COUNT(*) FILTER (WHERE failure = 0 AND vibration > cut) FROM s, m)
       SELECT rule, rows, rows > 0 AS violated FROM r
       UNION ALL SELECT 'remaining life rises', COUNT(*) FILTER (WHERE dr > 0), COUNT(*) FILTER (WHERE dr > 0) > 0.6 * COUNT(dr) FROM s""",
    using=("readings",),
)
def quality_physics(t):
    return qa.physics_rules(t.readings, ["event_id"])


_READING_COLUMNS = "event_id timestamp machine_id location temperature vibration pressure speed rul failure".split()


@query(
    "quality_expectations",
    " UNION ALL ".join(
        f"""SELECT 'not_null' AS expectation, '{c}' AS "column", AVG(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0 END) < 0.2 AS success,
            ROUND(AVG(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0 END), 6) AS observed FROM readings""" for c in _READING_COLUMNS
    ) + """ UNION ALL SELECT 'between_0_and_200', 'temperature', MIN(temperature) >= 0 AND MAX(temperature) <= 200, ROUND(MAX(temperature), 6) FROM readings
       UNION ALL SELECT 'mostly_non_increasing', 'rul', AVG(CASE WHEN d <= 0 THEN 1.0 ELSE 0 END) >= 0.5, ROUND(AVG(CASE WHEN d <= 0 THEN 1.0 ELSE 0 END), 6)
         FROM (SELECT rul - LAG(rul) OVER (ORDER BY event_id) AS d FROM readings) WHERE d IS NOT NULL
       UNION ALL SELECT 'unique_pair', 'timestamp+machine_id', COUNT(*) = COUNT(DISTINCT (timestamp, machine_id)),
         CAST(COUNT(*) - COUNT(DISTINCT (timestamp, machine_id)) AS DOUBLE) FROM readings
       UNION ALL SELECT 'row_count_between', '*', COUNT(*) BETWEEN 1 AND 5000000, CAST(COUNT(*) AS DOUBLE) FROM readings""",
    using=("readings",),
)
def quality_expectations(t):
    return rounded(qa.expectations(t.readings, ["event_id"]))


@query(
    "quality_dirty_labels",
    """WITH q AS (SELECT QUANTILE_CONT(vibration, 0.2) AS lo, QUANTILE_CONT(vibration, 0.95) AS hi FROM readings)
       SELECT 'failure with low vibration' AS flag, COUNT(*) FILTER (WHERE failure = 1 AND vibration < lo) AS rows FROM readings, q
       UNION ALL SELECT 'no failure with extreme vibration', COUNT(*) FILTER (WHERE failure = 0 AND vibration > hi) FROM readings, q""",
    using=("readings",),
)
def quality_dirty_labels(t):
    return qa.dirty_labels(t.readings)


@query(
    "assoc_highs",
    """WITH q AS (SELECT QUANTILE_CONT(vibration, 0.9) AS v, QUANTILE_CONT(pressure, 0.9) AS p, QUANTILE_CONT(failure, 0.9) AS f FROM readings),
            i AS (SELECT event_id, UNNEST(LIST_FILTER(['location=' || location, CASE WHEN vibration >= v THEN 'vibration=HIGH' END,
                    CASE WHEN pressure >= p THEN 'pressure=HIGH' END, CASE WHEN failure >= f THEN 'failure=HIGH' END], lambda x: x IS NOT NULL)) AS item FROM readings, q),
            b AS (SELECT * FROM i WHERE event_id IN (SELECT event_id FROM i GROUP BY 1 HAVING COUNT(*) >= 2)),
            n AS (SELECT COUNT(DISTINCT event_id) AS total FROM b), c AS (SELECT item, COUNT(*) AS k FROM b GROUP BY 1),
            r AS (SELECT x.item AS antecedent, y.item AS consequent, COUNT(*) AS k FROM b x JOIN b y ON x.event_id = y.event_id AND x.item <> y.item GROUP BY 1, 2),
            s AS (SELECT antecedent, consequent, r.k / total AS support, r.k / ca.k AS confidence, GREATEST(r.k / ca.k, r.k / cc.k) AS max_confidence
                  FROM r JOIN c ca ON ca.item = antecedent JOIN c cc ON cc.item = consequent, n)
       SELECT antecedent, consequent, ROUND(support, 6) AS support, ROUND(confidence, 6) AS confidence, ROUND(max_confidence, 6) AS max_confidence,
              (CONTAINS(antecedent, 'HIGH') OR CONTAINS(consequent, 'HIGH')) AND max_confidence >= 0.7 AS suspicious
       FROM s WHERE support >= 0.05 AND max_confidence >= 0.55""",
    using=("readings",),
)
def assoc_highs(t):
    return rounded(association_of_highs(t.readings, ["location"], ["vibration", "pressure", "failure"]))


@query("quality_kmeans_distance")
def quality_kmeans_distance(t):
    return qa.far_from_centre(t.readings, ["temperature", "vibration", "pressure"])


@query("pca_drift")
def pca_drift(t):
    return rounded(qa.pca_drift(t.readings, ["event_id"], ["temperature", "vibration", "pressure", "speed"]), 4)


@query("iforest_summary")
def iforest_summary(t):
    return rounded(anomaly_summary(t.readings, ["vibration", "pressure", "speed"]))


@query("iforest_rows")
def iforest_rows(t):
    scored = score_rows(t.readings, ["vibration", "pressure", "speed"])
    return rounded(scored.where("anomaly").select("event_id", "vibration", "pressure", "speed", "anomaly_score"))


@query("dbscan_summary")
def dbscan(t):
    return dbscan_summary(t.readings, ["vibration", "speed", "pressure", "temperature", "rul"])


@query(
    "dbscan_noise_points",
    """WITH s AS (SELECT AVG(vibration) AS mv, STDDEV_POP(vibration) AS sv, AVG(pressure) AS mp, STDDEV_POP(pressure) AS sp FROM readings),
            p AS (SELECT event_id, (vibration - mv) / sv AS x, (pressure - mp) / sp AS y FROM readings, s),
            n AS (SELECT a.event_id AS a, b.event_id AS b FROM p a JOIN p b ON b.x BETWEEN a.x - 0.3 AND a.x + 0.3
                  AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 0.09),
            c AS (SELECT a FROM n GROUP BY a HAVING COUNT(*) >= 5)
       SELECT ROUND(x, 6) + 0.0 AS z_vibration, ROUND(y, 6) + 0.0 AS z_pressure, COUNT(*) AS rows FROM p
       WHERE event_id NOT IN (SELECT a FROM n WHERE b IN (SELECT a FROM c)) GROUP BY x, y""",
    using=("readings",),
)
def dbscan_noise(t):
    noise = dbscan_points(t.readings, ["vibration", "pressure"], eps=0.3).where("noise")
    return rounded(noise.select(F.col("z")[0].alias("z_vibration"), F.col("z")[1].alias("z_pressure"), F.col("m").alias("rows")), 6)


@query(
    "knn_outliers",
    """WITH d AS (SELECT a.vec_id AS vec_id, b.vec_id AS other, LIST_DISTANCE(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS distance
                  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
            k AS (SELECT * FROM d QUALIFY ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY distance, other) <= 10),
            m AS (SELECT vec_id, AVG(distance) AS knn_distance FROM k GROUP BY vec_id)
       SELECT vec_id, ROUND(knn_distance, 6) AS knn_distance,
              knn_distance > (SELECT AVG(knn_distance) + 3 * STDDEV_POP(knn_distance) FROM m) AS outlier FROM m""",
)
def knn_outlier_rows(t):
    names = [f"x{i}" for i in range(64)]
    wide = t.embeddings.select("vec_id", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)])
    return rounded(knn_outliers(wide, names, "vec_id", 10))


_GIVEN = {
    "customer": "c_custkey c_name c_nationkey c_mktsegment c_acctbal", "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "events": "event_id ts user_id event_type value props", "nation": "n_nationkey n_name n_regionkey", "region": "r_regionkey r_name",
}


@query("column_kinds", f"""WITH {kinds_sql({t: c.split() for t, c in _GIVEN.items()})} SELECT tab AS "table", col AS "column", kind FROM kinds""")
def kinds(t):
    rows = []
    for name in ("customer", "supplier", "part", "orders", "events", "nation", "region"):
        rows += [(name, column, kind) for column, kind in column_kinds(getattr(t, name)).items()]
    return t.spark.createDataFrame(rows, "`table` string, `column` string, kind string")


def _few(tables: dict[str, str]) -> str:
    """Columns with 2 to 80 values, numbers with 2 to 20."""
    parts = [f"SELECT '{t}' AS tab, '{c}' AS col, ANY_VALUE(TYPEOF({c})) AS ty, COUNT(DISTINCT {c}) AS uniq FROM {t}" for t, cs in tables.items() for c in cs.split()]
    kinds = "'TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT', 'FLOAT', 'DOUBLE'"
    return f"SELECT tab AS table_name, col AS column_name FROM ({' UNION ALL '.join(parts)}) WHERE uniq BETWEEN 2 AND CASE WHEN ty IN ({kinds}) THEN 20 ELSE 80 END"


@query(
    "category_columns",
    _few({**{t: _GIVEN[t] for t in ("customer", "part", "orders", "events")},
          "lineitem": "l_orderkey l_linenumber l_partkey l_suppkey l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate"}),
)
def category_columns(t):
    rows = []
    for name in ("customer", "part", "orders", "events", "lineitem"):
        df = getattr(t, name)
        rows += [(name, c) for c in categories(df, bounded_profile(df, 80))]
    return t.spark.createDataFrame(rows, "table_name string, column_name string")


@query("quality_report")
def quality_report(t):
    # Each check reads the table; the expressions behind it run once.
    report = qa.quality_report(checkpoint(t.readings), ["event_id"])
    return report.select("check", "status", "detail")


@query("quality_report_lines")
def quality_report_lines(t):
    """The fail lines of the full report; quality_fail_lines is bound to the six checks and four columns of its SQL."""
    return qa.fail_lines(qa.quality_report(checkpoint(t.readings), ["event_id"]))


@query(
    "quality_fail_lines",
    """WITH p AS (SELECT event_id, location, temperature, failure FROM readings),
            c AS (SELECT COUNT(*) AS n, COUNT(*) - COUNT(temperature) AS gaps,
                         COUNT(*) FILTER (WHERE temperature = 0) + COUNT(*) FILTER (WHERE failure = 0) + COUNT(*) FILTER (WHERE event_id = 0) AS zeros FROM p)
       SELECT * FROM (
         SELECT 'Quality missing: ' || FORMAT('{:.2f}%', 100.0 * gaps / (4 * n)) || ' missing' AS line FROM c WHERE gaps > 0.05 * 4 * n
         UNION ALL SELECT 'Quality zeros: ' || FORMAT('{:.1f}%', 100.0 * zeros / (3 * n)) || ' zeros' FROM c WHERE zeros > 0.3 * 3 * n
         UNION ALL SELECT 'Quality timestamp: missing') LIMIT 2""",
    using=("readings",),
)
def quality_fail_lines(t):
    small = t.readings.select("event_id", "location", "temperature", "failure")
    cheap = ("missing", "constant", "zeros", "duplicates", "rowcount", "timestamp")
    return qa.fail_lines(qa.quality_report(small, ["event_id"], checks=cheap))
