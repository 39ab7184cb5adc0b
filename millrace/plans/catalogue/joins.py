"""Joins, read-only SQL and table sources."""

from pyspark.sql import functions as F

from millrace.operators.joins import join_many, join_totals, join_two
from millrace.operators.shape import append
from millrace.plans.catalogue.base import query, rounded, with_derived
from millrace.plans.sql_lab import Workspace, run_sql, summarize


def _keyed(t):
    """Customers and suppliers by nation; accounts in the red have lost their nation."""
    buyers = t.customer.select(
        F.expr("CASE WHEN c_acctbal < 0 THEN NULL ELSE c_nationkey END").alias("nation"),
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"),
    )
    sellers = t.supplier.select(
        F.expr("CASE WHEN s_acctbal < 0 THEN NULL ELSE s_nationkey END").alias("nation"),
        F.col("s_suppkey").alias("seller"), F.col("s_acctbal").alias("balance"),
    )
    return buyers, sellers


_KEYED = """
WITH b AS (SELECT CASE WHEN c_acctbal < 0 THEN NULL ELSE c_nationkey END AS nation, c_custkey AS id,
                  c_acctbal AS balance FROM customer),
     s AS (SELECT CASE WHEN s_acctbal < 0 THEN NULL ELSE s_nationkey END AS nation, s_suppkey AS seller,
                  s_acctbal AS balance FROM supplier)
"""

for _how, _sql in {"inner": "JOIN", "left": "LEFT JOIN", "right": "RIGHT JOIN", "outer": "FULL JOIN"}.items():
    _key = {"right": "o.o_custkey", "outer": "COALESCE(c.c_custkey, o.o_custkey)"}.get(_how, "c.c_custkey")

    @query(
        f"join_{_how}",
        f"""SELECT CAST({_key} AS BIGINT) AS custkey, c.c_name AS c_name, o.o_orderkey AS o_orderkey,
                   o.o_totalprice AS o_totalprice
            FROM (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') c
            {_sql} (SELECT * FROM orders WHERE o_orderstatus <> 'P') o ON c.c_custkey = o.o_custkey""",
    )
    def _join(t, how=_how):
        left = t.customer.where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("custkey"), "c_name")
        right = t.orders.where("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("custkey"), "o_orderkey", "o_totalprice")
        return join_two(left, right, how, on=["custkey"])[0]


@query(
    "join_null_keys",
    _KEYED + """SELECT CAST(b.nation AS BIGINT) AS nation, COUNT(*) AS pairs,
        ROUND(SUM(b.balance), 2) AS balance_l, ROUND(SUM(s.balance), 2) AS balance_r
        FROM b JOIN s ON b.nation IS NOT DISTINCT FROM s.nation GROUP BY b.nation""",
)
def join_null_keys(t):
    buyers, sellers = _keyed(t)
    return rounded(join_totals(buyers, sellers, ["nation"], {"l.balance": "balance_l", "r.balance": "balance_r"}), 2)


@query(
    "join_auto_key",
    """SELECT c_nationkey AS nationkey, c_custkey, s_suppkey FROM customer
       JOIN (SELECT s_nationkey, s_suppkey FROM supplier WHERE s_acctbal > 9000) ON c_nationkey = s_nationkey""",
)
def join_auto_key(t):
    left = t.customer.select(F.col("c_nationkey").alias("nationkey"), "c_custkey")
    right = t.supplier.where("s_acctbal > 9000").select(F.col("s_nationkey").alias("nationkey"), "s_suppkey")
    return rounded(join_two(left, right, spread=True)[0])


@query(
    "join_different_names",
    """SELECT n_nationkey, n_name, n_regionkey, r_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
def join_different_names(t):
    return rounded(join_two(t.nation, t.region, "inner", left_on="n_regionkey", right_on="r_regionkey")[0])


@query(
    "join_name_clash",
    """SELECT CAST(a.nation AS BIGINT) AS nation, a.name AS name_l, b.name AS name_r
       FROM (SELECT n_nationkey AS nation, n_name AS name FROM nation) a
       LEFT JOIN (SELECT s_nationkey AS nation, s_name AS name FROM supplier) b ON a.nation = b.nation""",
)
def join_name_clash(t):
    a = t.nation.select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("name"))
    b = t.supplier.select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"))
    return rounded(join_two(a, b, "left", on=["nation"])[0])


@query(
    "join_empty_right",
    "SELECT n_nationkey, n_name, CAST(NULL AS VARCHAR) AS note FROM nation",
)
def join_empty_right(t):
    empty = t.nation.where("n_nationkey < 0").select("n_nationkey", F.lit(None).cast("string").alias("note"))
    return rounded(join_two(t.nation.select("n_nationkey", "n_name"), empty, "left", on=["n_nationkey"])[0])


@query(
    "join_chain",
    """SELECT n_name, COUNT(*) AS lines, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
       LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
)
def join_chain(t):
    steps = [
        {"left": "lineitem", "right": "orders", "how": "inner", "left_on": "l_orderkey", "right_on": "o_orderkey"},
        {"left": "_result", "right": "customer", "how": "left", "left_on": "o_custkey", "right_on": "c_custkey"},
        {"left": "_result", "right": "nation", "how": "left", "left_on": "c_nationkey", "right_on": "n_nationkey"},
    ]
    tables = {n: getattr(t, n) for n in ("lineitem", "orders", "customer", "nation")}
    joined, _ = join_many(tables, steps)
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return rounded(joined.groupBy("n_name").agg(F.count("*").alias("lines"), F.sum(revenue).alias("revenue")), 2)


@query(
    "append_tables",
    """SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer
       UNION ALL SELECT s_name, s_acctbal, NULL FROM supplier""",
)
def append_tables(t):
    a = t.customer.select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = t.supplier.select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return append(a, b)


def sql_query(name: str, spark_sql: str, check: str | None = None, digits: int = 6):
    """A statement for the SQL surface; the check is the same text unless the dialects differ."""

    @query(name, check or spark_sql)
    def _run(t):
        used = [n for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events") if n in spark_sql]
        return rounded(run_sql(t.spark, spark_sql, {n: getattr(t, n) for n in used}), digits)


sql_query(
    "sql_filter_case",
    """WITH big AS (SELECT o_custkey, MAX(o_totalprice) AS top FROM orders GROUP BY o_custkey)
       SELECT c_custkey, c_mktsegment, CASE WHEN top > 400000 THEN 'large' WHEN top > 100000 THEN 'medium' ELSE 'small' END AS size
       FROM customer JOIN big ON c_custkey = o_custkey
       WHERE c_acctbal > (SELECT AVG(c_acctbal) FROM customer)""",
)
sql_query(
    "sql_groupby",
    """SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(AVG(l_quantity), 6) AS avg_qty,
              ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue
       FROM lineitem GROUP BY l_returnflag, l_linestatus ORDER BY revenue DESC""",
)
sql_query(
    "sql_window",
    """SELECT o_custkey, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place,
              ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last3
       FROM orders""",
)
sql_query(
    "sql_setops",
    """SELECT * FROM ((SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier)
       EXCEPT (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)
       UNION ALL (SELECT r_regionkey FROM region)) u""",
)
sql_query(
    "sql_cube",
    """SELECT l_returnflag, l_linestatus, COUNT(*) AS n, COUNT(DISTINCT l_partkey) AS parts,
              COUNT(*) FILTER (WHERE l_discount > 0.05) AS discounted
       FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""",
)
sql_query(
    "sql_rollup_sets",
    """SELECT c_mktsegment, c_nationkey, COUNT(*) AS n, ROUND(SUM(c_acctbal), 2) AS balance
       FROM customer GROUP BY GROUPING SETS ((c_mktsegment, c_nationkey), (c_mktsegment), ())""",
)
sql_query(
    "sql_semi_anti",
    """SELECT c.c_custkey, 'buyer' AS kind FROM customer c LEFT SEMI JOIN orders o ON c.c_custkey = o.o_custkey
       UNION ALL SELECT c.c_custkey, 'idle' AS kind FROM customer c LEFT ANTI JOIN orders o ON c.c_custkey = o.o_custkey""",
    """SELECT c_custkey, 'buyer' AS kind FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)
       UNION ALL SELECT c_custkey, 'idle' AS kind FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""",
)
sql_query(
    "sql_order_limit",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5",
)
sql_query(
    "sql_functions",
    """SELECT o_orderpriority, upper(substring(o_orderpriority, 3)) AS label, year(o_orderdate) AS y, month(o_orderdate) AS m,
              COUNT(*) AS n, ROUND(AVG(sqrt(abs(o_totalprice))), 6) AS root, MAX(length(o_orderstatus)) AS len
       FROM orders GROUP BY o_orderpriority, upper(substring(o_orderpriority, 3)), year(o_orderdate), month(o_orderdate)""",
)
sql_query(
    "sql_pivot",
    """SELECT * FROM (SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem)
       PIVOT (ROUND(AVG(l_quantity), 6) FOR l_linestatus IN ('O' AS open, 'F' AS filled))""",
    """SELECT l_returnflag, ROUND(AVG(l_quantity) FILTER (WHERE l_linestatus = 'O'), 6) AS open,
              ROUND(AVG(l_quantity) FILTER (WHERE l_linestatus = 'F'), 6) AS filled
       FROM lineitem GROUP BY l_returnflag""",
)
sql_query(
    "sql_json_list",
    """SELECT event_type, COUNT(*) AS n, ROUND(AVG(CAST(get_json_object(props, '$.k') AS DOUBLE)), 6) AS mean_k,
              SUM(size(filter(array(value, value * 2), x -> x > 50))) AS over
       FROM events GROUP BY event_type""",
    """SELECT event_type, COUNT(*) AS n, ROUND(AVG(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS mean_k,
              CAST(SUM(len(list_filter([value, value * 2], lambda x: x > 50))) AS BIGINT) AS over
       FROM events GROUP BY event_type""",
)
sql_query(
    "sql_asof",
    """SELECT event_id, last_order FROM (
         SELECT event_id, user_id, at, MAX(struct(order_at, okey)) OVER (PARTITION BY user_id ORDER BY at, event_id
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW).okey AS last_order
         FROM (SELECT user_id, event_id, date_format(ts, 'MM-dd') AS at, NULL AS order_at, NULL AS okey FROM events
               UNION ALL SELECT o_custkey, -1, date_format(o_orderdate, 'MM-dd'), date_format(o_orderdate, 'MM-dd'), o_orderkey FROM orders))
       WHERE event_id >= 0""",
    """SELECT event_id, (SELECT MAX(struct_pack(a := strftime(o_orderdate, '%m-%d'), k := o_orderkey)).k FROM orders
              WHERE o_custkey = user_id AND strftime(o_orderdate, '%m-%d') <= strftime(ts, '%m-%d')) AS last_order
       FROM events""",
)
sql_query(
    "sql_group_average",
    """SELECT event_type, AVG(value) AS avg_value, COUNT(*) AS n FROM events GROUP BY event_type ORDER BY avg_value DESC""",
    """SELECT event_type, ROUND(AVG(value), 6) AS avg_value, COUNT(*) AS n FROM events GROUP BY event_type""",
)

sql_query(
    "sql_full_right",
    """SELECT COALESCE(c_nationkey, s_nationkey) AS nation, COUNT(c_custkey) AS customers, COUNT(s_suppkey) AS suppliers, r_name AS region
       FROM (SELECT * FROM customer WHERE c_acctbal > 9000) c FULL JOIN (SELECT * FROM supplier WHERE s_acctbal > 5000) s ON c_nationkey = s_nationkey
       RIGHT JOIN (SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) n ON n_nationkey = COALESCE(c_nationkey, s_nationkey)
       GROUP BY COALESCE(c_nationkey, s_nationkey), r_name""",
)
sql_query(
    "sql_cross_theta",
    """SELECT a.n_name AS one, b.n_name AS two, r_name FROM nation a JOIN nation b ON a.n_regionkey < b.n_regionkey AND a.n_nationkey > b.n_nationkey
       CROSS JOIN region WHERE r_regionkey = b.n_regionkey""",
)
sql_query(
    "sql_lateral",
    """SELECT n_name, best.c_custkey, best.c_acctbal FROM nation, LATERAL (SELECT c_custkey, c_acctbal FROM customer
       WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 2) best""",
)
sql_query(
    "sql_unpivot",
    """SELECT l_returnflag, measure, ROUND(SUM(v), 4) AS total FROM (SELECT l_returnflag, l_discount, l_tax FROM lineitem)
       UNPIVOT (v FOR measure IN (l_discount, l_tax)) GROUP BY l_returnflag, measure""",
)
sql_query(
    "sql_range_frame",
    """SELECT o_orderkey, SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 500 PRECEDING AND 500 FOLLOWING) AS near
       FROM orders""",
    """SELECT o_orderkey, ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 500 PRECEDING AND 500 FOLLOWING), 2) AS near
       FROM orders""",
    2,
)


def _summary_check(table: str, columns: dict[str, str]) -> str:
    parts = []
    for name, kind in columns.items():
        avg, std = (f"AVG({name})", f"STDDEV_SAMP({name})") if kind in ("bigint", "int", "double") else ("NULL", "NULL")
        parts.append(
            f"SELECT '{name}' AS column_name, '{kind}' AS column_type, ROUND(CAST({avg} AS DOUBLE), 4) AS avg, ROUND(CAST({std} AS DOUBLE), 4) AS std, COUNT({name}) AS count, "
            f"ROUND(100.0 * (COUNT(*) - COUNT({name})) / COUNT(*), 4) AS null_percentage FROM {table}"
        )
    return " UNION ALL ".join(parts)


@query("sql_summarize", with_derived(_summary_check("patients", {"event_id": "bigint", "patient_id": "bigint", "age": "double", "bp": "double"}), ("patients",)))
def sql_summarize(t):
    found = summarize(t.patients.select("event_id", "patient_id", "age", "bp"))
    return rounded(found.drop("min", "max", "approx_unique"), 4)


@query(
    "joined_workspace",
    """SELECT n_name, COUNT(*) AS customers, ROUND(SUM(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
)
def joined_workspace(t):
    """A join becomes the table `joined`, and SQL goes on from there."""
    work = Workspace(t.spark, {"customer": t.customer, "nation": t.nation})
    work.join("customer", "nation", "inner", left_on="c_nationkey", right_on="n_nationkey")
    return rounded(work.sql("SELECT n_name, COUNT(*) AS customers, SUM(c_acctbal) AS balance FROM joined GROUP BY n_name"), 2)
