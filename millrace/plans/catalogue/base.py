"""Registry of the queries, the given tables, and tables derived from them.

A derived table is one SELECT that both engines read the same way, so a query and its check start from equal
rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import tune

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)

DERIVED = {
    # Order lines with the names the sales pack expects.
    "sales": """
        SELECT l.l_orderkey AS order_id, o.o_custkey AS customer_id, l.l_partkey AS sku, n.n_name AS region,
               o.o_orderdate AS order_date, l.l_extendedprice * (1 - l.l_discount) AS revenue,
               l.l_quantity AS units, p.p_brand AS product
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
        JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
        JOIN part p ON l.l_partkey = p.p_partkey""",
    # One row per order; units are missing for orders without lines.
    "order_sales": """
        SELECT o.o_orderkey AS order_id, o.o_custkey AS customer_id, o.o_orderdate AS order_date,
               o.o_totalprice AS revenue, u.units AS units, o.o_orderpriority AS channel
        FROM orders o LEFT JOIN (SELECT l_orderkey, SUM(l_quantity) AS units FROM lineitem GROUP BY l_orderkey) u
        ON o.o_orderkey = u.l_orderkey""",
    # Sensor readings; the temperature probe of sign-up events is offline.
    "readings": """
        SELECT event_id, ts AS timestamp, 'M' || CAST(user_id AS STRING) AS machine_id, event_type AS location,
               CASE WHEN event_type = 'signup' THEN NULL
                    ELSE 60 + CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) * 0.6 END AS temperature,
               value / 50 AS vibration,
               20 + value / 4 + CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) / 10 AS pressure,
               1000 + CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) AS speed,
               10000000 - event_id + value AS rul,
               CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS failure
        FROM events""",
    "patients": """
        SELECT event_id, user_id AS patient_id, CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) AS age,
               CASE WHEN event_type = 'error' THEN NULL ELSE 80 + value / 5 END AS bp,
               70 + CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) AS glucose,
               50 + value / 4 AS weight,
               CASE WHEN event_type = 'click' THEN 1.7 ELSE 150 + value / 10 END AS height,
               CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS readmission
        FROM events""",
    "students": """
        SELECT c_custkey AS student_id, c_acctbal / 100 AS math_score,
               CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN NULL ELSE 50 + c_nationkey END AS attendance,
               c_mktsegment AS course
        FROM customer""",
    "subscribers": """
        SELECT c_custkey AS subscriber_id, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS churn,
               c_nationkey + 1 AS tenure, c_acctbal / 100 AS arpu, c_acctbal AS data_usage, c_mktsegment AS plan
        FROM customer""",
    "loans": """
        SELECT o_orderkey AS application_id, o_totalprice AS loan_amount, c_acctbal AS income,
               CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS default_flag, 300 + c_nationkey * 20 AS credit_score
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "stock": """
        SELECT p_partkey AS sku, CAST(p_size * 10 AS DOUBLE) AS inventory,
               CASE WHEN p_brand = 'Brand#1' THEN 0 ELSE p_retailprice / 100 END AS demand,
               CAST(p_size AS DOUBLE) AS lead_time, p_size + 2 AS shipments, p_type AS warehouse
        FROM part""",
    "meters": """
        SELECT event_id, ts AS timestamp, value AS load, 220 + value / 100 AS voltage,
               CASE WHEN event_type = 'view' THEN NULL ELSE value / 20 END AS current
        FROM events""",
    "fields": """
        SELECT event_id, ts AS timestamp, value AS moisture,
               CASE WHEN event_type = 'view' THEN NULL ELSE CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) END AS rainfall,
               4 + CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) / 20 AS ph, value * 2 AS crop_yield
        FROM events""",
    "staff": """
        SELECT c_custkey AS employee_id, c_acctbal AS salary, c_mktsegment AS department,
               CASE WHEN c_acctbal < 0 THEN 1 WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE 0 END AS attrition
        FROM customer""",
    "plant": """
        SELECT event_id, ts AS date, 'A' || CAST(user_id AS STRING) AS asset_id, value AS downtime_minutes,
               CASE WHEN event_type = 'error' THEN 3 ELSE 0 END AS scrap,
               value / 500 AS availability, value / 600 AS oee
        FROM events""",
}


class Tables:
    """The parquet tables of one folder and the derived tables, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name in DERIVED:
            return self.sql(DERIVED[name])
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        for name in TABLES:
            if name in text:
                getattr(self, name).createOrReplaceTempView(name)
        return self.spark.sql(text)

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None, using: tuple[str, ...] = ()):
    """Register a query. ``using`` names derived tables put in front of the check as CTEs."""

    def register(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Tables(tune(spark), folder))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = with_derived(sql, using)
        return build

    return register


def with_derived(sql: str, using: tuple[str, ...]) -> str:
    if not using:
        return sql.strip()
    ctes = ", ".join(f"{n} AS ({DERIVED[n].strip()})" for n in using)
    body = sql.strip()
    joiner = ", " + body[len("WITH ") :] if body.upper().startswith("WITH ") else " " + body
    return f"WITH {ctes}{joiner}"


def kinds_sql(tables: dict[str, list[str]]) -> str:
    """CTEs ending in ``kinds`` (tab, pos, col, n, kind): the kind of every column, from its type, name and values."""
    parts = [
        f"SELECT '{table}' AS tab, {pos} AS pos, '{column}' AS col, ANY_VALUE(TYPEOF({column})) AS ty, COUNT(*) AS n, COUNT({column}) AS known, "
        f"COUNT(DISTINCT {column}) AS uniq, COUNT(*) FILTER (WHERE TRY_CAST(CAST({column} AS VARCHAR) AS DOUBLE) NOT IN (0, 1)) AS other, "
        f"COUNT(TRY_CAST(CAST({column} AS VARCHAR) AS TIMESTAMP)) AS times FROM {table}"
        for table, columns in tables.items()
        for pos, column in enumerate(columns)
    ]
    return f"""facts AS ({" UNION ALL ".join(parts)}),
        judged AS (SELECT *, known > 0 AND ((uniq / known > 0.85 AND uniq > 5) OR (uniq = known AND known > 3)) AS unique_like FROM facts),
        kinds AS (SELECT tab, pos, col, n, uniq, CASE WHEN ty = 'BOOLEAN' THEN 'boolean' WHEN ty LIKE 'TIMESTAMP%' OR ty = 'DATE' THEN 'date'
            WHEN ty <> 'VARCHAR' THEN CASE WHEN uniq BETWEEN 1 AND 2 AND other = 0 THEN 'boolean'
                WHEN REGEXP_MATCHES(col, 'id|key|code|sku|uuid') OR unique_like THEN 'id_like' ELSE 'number' END
            WHEN times >= GREATEST(3, n // 2) AND (times / n >= 0.85 OR (times / n >= 0.6 AND REGEXP_MATCHES(col, 'date|time'))) THEN 'date'
            WHEN REGEXP_MATCHES(col, 'id|key|uuid|customer|order|asset|machine') AND (unique_like OR SUFFIX(col, '_id')) THEN 'id_like'
            ELSE 'text' END AS kind FROM judged)"""


def rounded(df: DataFrame, digits: int = 6, special: dict[str, int] | None = None) -> DataFrame:
    """Round doubles and widen small types, so that two engines give equal values."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            # Adding 0.0 turns a negative zero into zero.
            c = F.round(c.cast("double"), (special or {}).get(field.name, digits)) + F.lit(0.0)
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        out.append(c.alias(field.name))
    return df.select(*out)
