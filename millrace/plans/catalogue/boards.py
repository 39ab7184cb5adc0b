"""Board datasets and the shaping operators behind them."""

from pyspark.sql import functions as F

from millrace.operators.board import Board, cell_means, correlation_matrix, pinned_view
from millrace.operators.shape import pivot_mean, repeatable_sample, top, totals
from millrace.plans.catalogue.base import query, rounded


def _sales_board(t):
    return Board(t.sales, ["order_id", "sku"], "sales", {"region": "region", "product": "product"})


_BY_PRODUCT = "SELECT product AS label, SUM(revenue) AS value FROM sales GROUP BY product"


@query(
    "board_pulse",
    """SELECT 'sku' AS metric, ROUND(AVG(sku), 4) AS mean FROM sales UNION ALL SELECT 'revenue', ROUND(AVG(revenue), 4) FROM sales
       UNION ALL SELECT 'units', ROUND(AVG(units), 4) FROM sales""",
    using=("sales",),
)
def board_pulse(t):
    return rounded(_sales_board(t).pulse(), 4)


@query(
    "board_pulse_oee",
    """SELECT 'availability' AS metric, ROUND(AVG(availability), 6) AS mean FROM plant
       UNION ALL SELECT 'oee', ROUND(AVG(oee), 6) FROM plant""",
    using=("plant",),
)
def board_pulse_oee(t):
    return rounded(Board(t.plant, ["event_id"], "plant_oee").pulse())


@query(
    "board_volume",
    """SELECT region AS label, ROUND(SUM(revenue), 4) AS value FROM sales GROUP BY region ORDER BY SUM(revenue) DESC, label LIMIT 12""",
    using=("sales",),
)
def board_volume(t):
    return rounded(_sales_board(t).volume(), 4)


@query(
    "board_share",
    """WITH g AS (SELECT region, SUM(revenue) AS v FROM sales GROUP BY region),
            r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY v DESC, region) AS rank FROM g)
       SELECT CASE WHEN rank <= 8 THEN region ELSE 'Other' END AS label, ROUND(SUM(v), 4) AS value, LEAST(rank, 9) AS rank
       FROM r GROUP BY 1, 3""",
    using=("sales",),
)
def board_share(t):
    return rounded(_sales_board(t).share(), 4)


@query(
    "board_scatter",
    """SELECT ROUND(vibration, 6) AS x, ROUND(temperature, 6) AS y, CAST(failure AS VARCHAR) AS colour FROM readings
       WHERE vibration IS NOT NULL AND temperature IS NOT NULL ORDER BY MD5(event_id || '|42'), event_id LIMIT 3500""",
    using=("readings",),
)
def board_scatter(t):
    return rounded(Board(t.readings, ["event_id"], "predictive_maintenance").scatter())


@query(
    "board_series",
    """WITH d AS (SELECT CAST(timestamp AS DATE) AS day, vibration AS v FROM readings),
            c AS (SELECT UNNEST(GENERATE_SERIES((SELECT MIN(day) FROM d), (SELECT MAX(day) FROM d), INTERVAL 1 DAY)) AS day)
       SELECT STRFTIME(c.day, '%Y-%m-%d') AS period, ROUND(COALESCE(SUM(v), 0), 6) AS value, COUNT(v) AS n
       FROM c LEFT JOIN d ON CAST(c.day AS DATE) = d.day GROUP BY c.day""",
    using=("readings",),
)
def board_series(t):
    out = Board(t.readings, ["event_id"], "predictive_maintenance").over_time()
    return rounded(out.select(F.date_format("period", "yyyy-MM-dd").alias("period"), "value", "n"))


@query(
    "board_topn",
    """SELECT product AS label, ROUND(SUM(revenue), 4) AS value FROM sales GROUP BY product ORDER BY SUM(revenue) DESC, label LIMIT 10""",
    using=("sales",),
)
def board_topn(t):
    return rounded(_sales_board(t).top_groups(), 4)


@query(
    "board_pareto",
    """WITH g AS (SELECT region AS label, SUM(revenue) AS value FROM sales GROUP BY region),
            p AS (SELECT label, value FROM g WHERE value > 0 ORDER BY value DESC, label LIMIT 20)
       SELECT label, ROUND(value, 4) AS value, ROW_NUMBER() OVER w AS rank,
              ROUND(100 * SUM(value) OVER w / (SELECT SUM(value) FROM p), 4) AS cum_pct,
              ROUND(100 * SUM(value) OVER w / (SELECT SUM(value) FROM g WHERE value > 0), 4) AS pct_of_all
       FROM p WINDOW w AS (ORDER BY value DESC, label ROWS UNBOUNDED PRECEDING)""",
    using=("sales",),
)
def board_pareto(t):
    return rounded(_sales_board(t).pareto(), 4)


@query(
    "board_hist",
    """WITH s AS (SELECT MIN(value) AS lo, MAX(value) AS hi, LEAST(40, GREATEST(10, CAST(FLOOR(SQRT(COUNT(*))) AS INT))) AS bins FROM events),
            b AS (SELECT LEAST(CAST(FLOOR((value - lo) / ((hi - lo) / bins)) AS INT), bins - 1) AS bin FROM events, s)
       SELECT CAST(bin AS BIGINT) AS bin, ROUND(lo + bin * ((hi - lo) / bins), 6) AS lo, ROUND(lo + (bin + 1) * ((hi - lo) / bins), 6) AS hi,
              COUNT(*) AS n FROM b, s GROUP BY bin, s.lo, s.hi, s.bins""",
)
def board_hist(t):
    return rounded(Board(t.events, ["event_id"], "generic").hist())


@query(
    "board_heatmap",
    """SELECT STRFTIME(timestamp, '%Y-%m') AS row, location AS col, ROUND(AVG(vibration), 6) AS value FROM readings GROUP BY 1, 2""",
    using=("readings",),
)
def board_heatmap(t):
    v = F.col("vibration")
    return rounded(cell_means(t.readings, F.date_format("timestamp", "yyyy-MM"), F.col("location"), v))


@query(
    "board_heatmap_months",
    """SELECT STRFTIME(order_date, '%Y-%m') AS row, channel AS col, ROUND(AVG(revenue), 7) AS value FROM order_sales GROUP BY 1, 2""",
    using=("order_sales",),
)
def board_heatmap_months(t):
    return rounded(Board(t.order_sales, ["order_id"], "generic").heatmap(), 7)


_CORR = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "board_corr",
    " UNION ALL ".join(
        f"SELECT '{a}' AS row, '{b}' AS col, ROUND(CORR({a}, {b}), 6) + 0.0 AS value FROM lineitem" for a in _CORR for b in _CORR
    ),
)
def board_corr(t):
    return rounded(correlation_matrix(t.lineitem, _CORR))


@query(
    "pinned_view",
    "SELECT p_name AS x, ROUND(AVG(p_retailprice), 6) AS y FROM part GROUP BY p_name",
)
def pinned(t):
    return rounded(pinned_view(t.part, "p_name", "p_retailprice"))


@query(
    "pivot_mean",
    """SELECT location AS row, ROUND(AVG(vibration) FILTER (WHERE failure = 0), 6) AS "0",
              ROUND(AVG(vibration) FILTER (WHERE failure = 1), 6) AS "1" FROM readings GROUP BY location""",
    using=("readings",),
)
def pivot(t):
    return rounded(pivot_mean(t.readings, F.col("location"), F.col("failure"), F.col("vibration")))


@query(
    "top_k",
    "SELECT p_brand AS label, CAST(COUNT(*) AS DOUBLE) AS value FROM part GROUP BY 1 ORDER BY value DESC, label LIMIT 12",
)
def top_k(t):
    return top(totals(t.part, "p_brand"), 12)


@query("head_preview", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def head_preview(t):
    return t.orders.orderBy("o_orderkey").limit(100).select("o_orderkey", "o_custkey", "o_totalprice")


@query(
    "repeatable_sample",
    """SELECT * FROM orders ORDER BY MD5(o_orderkey || '|' || o_custkey || '|42'), o_orderkey, o_custkey LIMIT 1500""",
)
def sample(t):
    return repeatable_sample(t.orders, 1500, ["o_orderkey", "o_custkey"])
