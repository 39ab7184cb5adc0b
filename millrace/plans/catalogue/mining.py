"""Baskets, rules, clusters, models, imputation and forecasts."""

from pyspark.sql import functions as F

from millrace.functions.cast import moment
from millrace.operators import models as mo
from millrace.operators.baskets import baskets_from_pairs, baskets_from_rows, frequent_itemsets, mine_rules
from millrace.operators.cluster import assign_kmeans, principal_components
from millrace.operators.forecast import daily_last, forecast, forecast_by_series, outlook, seasonal_by_series
from millrace.operators.impute import chained_impute, imputation_preview
from millrace.operators.neighbours import knn, knn_classify
from millrace.plans.catalogue.base import query, rounded
from millrace.session import checkpoint

_PAIRS = """p AS (SELECT DISTINCT l_orderkey AS basket, p_type AS item FROM lineitem JOIN part ON l_partkey = p_partkey),
     n AS (SELECT COUNT(DISTINCT basket) AS total FROM p)"""
_SETS = _PAIRS + """,
     s1 AS (SELECT item AS a, COUNT(*) AS n FROM p GROUP BY 1),
     s2 AS (SELECT x.item AS a, y.item AS b, COUNT(*) AS n FROM p x JOIN p y ON x.basket = y.basket AND x.item < y.item GROUP BY 1, 2),
     s3 AS (SELECT x.item AS a, y.item AS b, z.item AS c, COUNT(*) AS n FROM p x JOIN p y ON x.basket = y.basket AND x.item < y.item
            JOIN p z ON z.basket = y.basket AND y.item < z.item GROUP BY 1, 2, 3),
     sets AS (SELECT [a] AS items, n FROM s1 UNION ALL SELECT [a, b], n FROM s2 UNION ALL SELECT [a, b, c], n FROM s3),
     f AS (SELECT items, sets.n AS n, sets.n / total AS support FROM sets, n WHERE sets.n / total >= {support})"""


def _baskets(t):
    """Part types per order."""
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return baskets_from_pairs(lines, "l_orderkey", "p_type")


@query("baskets", f"WITH {_PAIRS} SELECT basket, item FROM p")
def baskets(t):
    return _baskets(t)


@query(
    "itemsets",
    f"WITH {_SETS.format(support=0.05)} SELECT ARRAY_TO_STRING(items, ', ') AS items, LEN(items) AS size, n, ROUND(support, 6) AS support FROM f",
)
def itemsets(t):
    found, _ = frequent_itemsets(_baskets(t), 0.05)
    return rounded(found.withColumn("items", F.array_join("items", ", ")))


_RULES = """, m AS (SELECT items, support, UNNEST(CASE LEN(items) WHEN 2 THEN [1, 2] ELSE [1, 2, 3, 4, 5, 6] END) AS mask FROM f WHERE LEN(items) >= 2),
     r AS (SELECT support, LIST_FILTER(items, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS ant, LIST_FILTER(items, lambda x, i: (mask >> (i - 1)) & 1 = 0) AS con FROM m),
     j AS (SELECT ARRAY_TO_STRING(ant, ', ') AS antecedent, ARRAY_TO_STRING(con, ', ') AS consequent, r.support AS support,
                  r.support / a.support AS confidence, r.support / a.support / c.support AS lift
           FROM r JOIN f a ON a.items = ant JOIN f c ON c.items = con)"""


@query(
    "rules",
    f"""WITH {_SETS.format(support=0.05)}{_RULES}
        SELECT antecedent, consequent, ROUND(support, 6) AS support, ROUND(confidence, 6) AS confidence, ROUND(lift, 6) AS lift
        FROM j WHERE confidence >= 0.3""",
)
def rules(t):
    return rounded(mine_rules(_baskets(t), 0.05, 0.3, limit=None))


@query(
    "row_bins",
    """WITH m AS (SELECT QUANTILE_CONT(value, 0.5) AS v, QUANTILE_CONT(user_id, 0.5) AS u FROM events)
       SELECT items, COUNT(*) AS n FROM (SELECT CASE WHEN value >= v THEN 'value=HIGH' ELSE 'value=LOW' END || ', ' ||
              CASE WHEN user_id >= u THEN 'user_id=HIGH' ELSE 'user_id=LOW' END AS items FROM events, m) GROUP BY items""",
)
def row_bins(t):
    rows = baskets_from_rows(t.events, ["value", "user_id"])
    return rows.groupBy(F.array_join("items", ", ").alias("items")).agg(F.count("*").alias("n"))


@query(
    "row_bin_rules",
    """WITH m AS (SELECT QUANTILE_CONT(value, 0.5) AS v, QUANTILE_CONT(user_id, 0.5) AS u FROM events),
            b AS (SELECT CASE WHEN value >= v THEN 'value=HIGH' ELSE 'value=LOW' END AS x,
                         CASE WHEN user_id >= u THEN 'user_id=HIGH' ELSE 'user_id=LOW' END AS y FROM events, m),
            n AS (SELECT COUNT(*) AS total FROM b), cx AS (SELECT x, COUNT(*) AS k FROM b GROUP BY x), cy AS (SELECT y, COUNT(*) AS k FROM b GROUP BY y),
            p AS (SELECT x, y, COUNT(*) AS k FROM b GROUP BY x, y)
       SELECT antecedent, consequent, ROUND(s, 6) AS support, ROUND(c, 6) AS confidence, ROUND(l, 6) AS lift FROM (
         SELECT p.x AS antecedent, p.y AS consequent, p.k / total AS s, p.k / cx.k AS c, p.k / cx.k / (cy.k / total) AS l FROM p JOIN cx USING (x) JOIN cy USING (y), n
         UNION ALL SELECT p.y, p.x, p.k / total, p.k / cy.k, p.k / cy.k / (cx.k / total) FROM p JOIN cx USING (x) JOIN cy USING (y), n)
       WHERE s >= 0.15 AND c >= 0.5""",
)
def row_bin_rules(t):
    return rounded(mine_rules(baskets_from_rows(t.events, ["value", "user_id"])))


@query("kmeans")
def kmeans(t):
    out, summary = assign_kmeans(t.readings, ["vibration", "speed", "temperature"], 4)
    return rounded(out.groupBy("cluster_id").agg(
        F.count("*").alias("rows"), F.avg("vibration").alias("vibration"), F.avg("speed").alias("speed"),
        F.lit(summary["silhouette"]).alias("silhouette"),
    ), 4)


@query("kmeans_rows")
def kmeans_rows(t):
    out, _ = assign_kmeans(t.readings, ["vibration", "speed", "temperature"], 4, silhouette=False)
    return out.select("event_id", "cluster_id")


@query("pca")
def pca(t):
    scores, shares = principal_components(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 3)
    spread = scores.agg(*[F.var_samp(f"PC{i}").alias(f"v{i}") for i in (1, 2, 3)])
    rows = F.array(*[F.struct(F.lit(f"PC{i}").alias("component"), F.lit(s).alias("share"), F.col(f"v{i}").alias("variance")) for i, s in enumerate(shares, 1)])
    return rounded(spread.select(F.inline(rows)))


@query("pca_scores")
def pca_scores(t):
    scores, _ = principal_components(t.readings, ["temperature", "vibration", "pressure", "speed"], 3, ["event_id"])
    return rounded(scores.select("event_id", *[F.abs(f"PC{i}").alias(f"PC{i}") for i in (1, 2, 3)]))


_DISTANCE = "LIST_DISTANCE(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query(
    "knn_join",
    f"""SELECT vec_id, neighbour, ROUND(d, 6) AS distance, rank FROM (
          SELECT a.vec_id AS vec_id, b.vec_id AS neighbour, {_DISTANCE} AS d,
                 ROW_NUMBER() OVER (PARTITION BY a.vec_id ORDER BY {_DISTANCE}, b.vec_id) AS rank
          FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE rank <= 5""",
)
def knn_join(t):
    v = F.col("embedding")
    found = knn(t.embeddings, t.embeddings, 5, "vec_id", "vec_id", v, v, skip_same_key=True)
    return rounded(found.select(F.col("query").alias("vec_id"), "neighbour", "distance", "rank"))


@query(
    "knn_classify",
    """WITH d AS (SELECT a.vec_id AS vec_id, b.label AS label, ROW_NUMBER() OVER (PARTITION BY a.vec_id
                  ORDER BY LIST_DISTANCE(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS rank
                  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 5 = 0 AND b.vec_id % 5 <> 0),
            v AS (SELECT vec_id, label, COUNT(*) AS votes FROM d WHERE rank <= 5 GROUP BY 1, 2)
       SELECT vec_id, label AS prediction FROM v QUALIFY ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY votes DESC, label) = 1""",
)
def knn_class(t):
    names = [f"x{i}" for i in range(64)]
    wide = t.embeddings.select("vec_id", "label", *[F.col("embedding")[i].alias(n) for i, n in enumerate(names)])
    return rounded(knn_classify(wide.where("vec_id % 5 <> 0"), wide.where("vec_id % 5 = 0"), names, "label", "vec_id", 5))


@query("iterative_impute")
def iterative_impute(t):
    filled = chained_impute(t.patients, ["bp", "glucose", "age", "weight"])
    return rounded(filled.select("event_id", "bp", "glucose", "age", "weight"), 4)


@query("imputation_preview")
def preview(t):
    filled = chained_impute(t.patients, ["bp", "glucose", "age"])
    return rounded(imputation_preview(t.patients, filled, ["bp", "glucose"], "event_id"), 4)


@query("forecast")
def forecast_sales(t):
    points = daily_last(t.orders, moment(t.orders, "o_orderdate"), F.col("o_totalprice"), F.col("o_orderkey"))
    ahead = forecast(points)
    return rounded(ahead.select(F.date_format("ds", "yyyy-MM-dd").alias("ds"), "yhat", "yhat_lower", "yhat_upper"), 2)


@query(
    "forecast_by_series",
    """WITH p AS (SELECT o_custkey AS series, CAST(o_orderdate AS DATE) AS ds, o_totalprice AS y FROM orders),
            l AS (SELECT series, REGR_SLOPE(y, DATE_DIFF('day', DATE '1970-01-01', ds)) AS a, REGR_INTERCEPT(y, DATE_DIFF('day', DATE '1970-01-01', ds)) AS b,
                         REGR_SXX(y, DATE_DIFF('day', DATE '1970-01-01', ds)) AS sxx, REGR_SYY(y, DATE_DIFF('day', DATE '1970-01-01', ds)) AS syy,
                         COUNT(*) AS n, MAX(ds) AS last FROM p GROUP BY series),
            a AS (SELECT series, n, SQRT(GREATEST(syy - a * a * sxx, 0) / n) AS sigma, a, b, last + CAST(s AS INTEGER) AS ds FROM l, UNNEST(GENERATE_SERIES(1, 7)) u(s) WHERE n >= 3 AND sxx > 0),
            f AS (SELECT series, ds, sigma, b + a * DATE_DIFF('day', DATE '1970-01-01', ds) AS yhat FROM a)
       SELECT series, STRFTIME(ds, '%Y-%m-%d') AS ds, ROUND(yhat, 2) AS yhat, ROUND(yhat - 1.2816 * sigma, 2) AS yhat_lower,
              ROUND(yhat + 1.2816 * sigma, 2) AS yhat_upper FROM f""",
)
def forecast_series(t):
    points = t.orders.select(F.col("o_custkey").alias("series"), F.to_date("o_orderdate").alias("ds"), F.col("o_totalprice").alias("y"))
    found = forecast_by_series(points, "series", 7)
    return rounded(found.withColumn("ds", F.date_format("ds", "yyyy-MM-dd")), 2)


@query("forecast_seasonal_by_series")
def forecast_seasonal_series(t):
    """Daily order values of each nation, carried on by trend, year and week."""
    points = t.sql("SELECT c_nationkey AS nation, CAST(o_orderdate AS DATE) AS ds, SUM(o_totalprice) AS y FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
    found = seasonal_by_series(points, "nation", 30)
    return rounded(found.withColumn("ds", F.date_format("ds", "yyyy-MM-dd")), 2)


@query("forecast_outlook")
def forecast_outlook(t):
    points = daily_last(t.events, moment(t.events, "ts"), F.col("value"), F.col("event_id"))
    return rounded(outlook(points, "value").drop("until"), 3)


def _lines(t):
    """Order-level table for the supervised models; the order key identifies a row."""
    return t.sql(
        """SELECT o.o_orderkey, o.o_totalprice AS revenue, o.o_orderpriority AS priority, c.c_acctbal AS balance, c.c_mktsegment AS segment,
                  COALESCE(l.lines, 0) AS line_count, COALESCE(l.qty, 0) AS qty, COALESCE(l.paid, 0) AS paid,
                  CASE WHEN COALESCE(l.paid, 0) > 150000 THEN 1 ELSE 0 END AS churn
           FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
           LEFT JOIN (SELECT l_orderkey, COUNT(*) AS lines, SUM(l_quantity) AS qty, SUM(l_extendedprice) AS paid FROM lineitem GROUP BY l_orderkey) l
           ON o.o_orderkey = l.l_orderkey"""
    )


_FEATURES = ["balance", "line_count", "qty", "segment", "priority"]

for _model in mo.TASKS:
    if mo.TASKS[_model] not in ("classification", "regression"):
        continue

    @query(f"model_{_model}")
    def _fit(t, model=_model):
        target = "churn" if mo.TASKS[model] == "classification" else "paid"
        columns = [c for c in _FEATURES if model != "StatsmodelsOLS" or c in ("balance", "line_count", "qty")]
        result = mo.run_model(_lines(t), model, "o_orderkey", target, features=columns)
        return rounded(mo.metrics_table(t.spark, [result]), 4)


@query(
    "ols_coefficients",
    """WITH l AS (SELECT l_orderkey, COUNT(*) AS line_count, SUM(l_extendedprice) AS paid FROM lineitem GROUP BY l_orderkey),
            d AS (SELECT o_orderkey, COALESCE(line_count, 0) AS x, COALESCE(paid, 0) AS y FROM orders LEFT JOIN l ON o_orderkey = l_orderkey),
            i AS (SELECT x, y, ROW_NUMBER() OVER (ORDER BY o_orderkey) - 1 AS pos, COUNT(*) OVER () AS n FROM d),
            f AS (SELECT REGR_SLOPE(y, x) AS a, REGR_INTERCEPT(y, x) AS b FROM i WHERE pos < CAST(FLOOR(n * 0.8) AS BIGINT))
       SELECT 'line_count' AS name, ROUND(a, 3) AS coefficient FROM f UNION ALL SELECT 'const', ROUND(b, 3) FROM f""",
)
def ols_coefficients(t):
    fit = mo.run_ols(_lines(t), "paid", "o_orderkey", ["line_count"])
    rows = [(k, float(v)) for k, v in fit["coefficients"].items()]
    return rounded(t.spark.createDataFrame(rows, "name string, coefficient double"), 3)


@query("model_briefing")
def model_briefing(t):
    # Both models read it; the joins run once.
    lines = checkpoint(_lines(t))
    fits = [
        mo.run_model(lines, m, "o_orderkey", target, features=_FEATURES)
        for m, target in (("DecisionTreeClassifier", "churn"), ("LinearRegression", "paid"))
    ]
    return mo.briefing(mo.metrics_table(t.spark, fits))


@query("model_bake_off")
def bake_off(t):
    _, board = mo.bake_off(_lines(t), "telecom_churn", "o_orderkey")
    return rounded(board, 4)


@query("model_search")
def search(t):
    found = mo.search(_lines(t), "churn", "o_orderkey")
    return rounded(mo.metrics_table(t.spark, [found]), 4)
