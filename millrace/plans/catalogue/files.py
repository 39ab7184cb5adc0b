"""Registered queries that write files to the scratch folder and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.operators import clean as cl
from millrace.operators.kpis import kpi_table
from millrace.plans.catalogue.base import query, rounded
from millrace.session import checkpoint_dir
from millrace.sources import tabular as tab


def _scratch(t, name: str) -> str:
    return f"{checkpoint_dir(t.spark).rstrip('/')}/{uuid.uuid4().hex}-{name}"


@query("read_csv", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment, ROUND(c_acctbal, 2) AS c_acctbal FROM customer")
def read_csv(t):
    path, source = _scratch(t, "customer.csv"), t.customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_acctbal")
    tab.write_csv(source, path)
    return rounded(tab.read_table(t.spark, path, source.schema), 2)


@query(
    "read_tsv",
    """SELECT p_brand, p_type, COUNT(*) AS parts, ROUND(AVG(p_size), 6) AS size, ROUND(AVG(p_retailprice), 6) AS price FROM part GROUP BY p_brand, p_type""",
)
def read_tsv(t):
    """Columns are typed by their content."""
    path = _scratch(t, "part.tsv")
    t.part.write.option("header", True).option("sep", "\t").csv(path)
    read = tab.read_table(t.spark, path)
    return rounded(read.groupBy("p_brand", "p_type").agg(F.count("*").alias("parts"), F.avg("p_size").alias("size"), F.avg("p_retailprice").alias("price")))


@query("read_json", "SELECT event_id, event_type, ROUND(value, 6) AS value, props FROM events")
def read_json(t):
    path, source = _scratch(t, "events.json"), t.events.select("event_id", "event_type", "value", "props")
    source.write.json(path)
    return rounded(tab.read_table(t.spark, path, source.schema))


@query(
    "session_round_trip",
    """SELECT 'customer' AS name, COUNT(*) AS rows, ROUND(SUM(c_acctbal), 2) AS total FROM customer
       UNION ALL SELECT 'orders', COUNT(*), ROUND(SUM(o_totalprice), 2) FROM orders""",
)
def session_round_trip(t):
    """Saved tables are read back with their types; an empty one is left out."""
    tables = {"customer": t.customer, "orders": t.orders, "nothing": t.nation.where("n_nationkey < 0")}
    saved = tab.save_tables(tables, _scratch(t, "session"))
    values = {"customer": "c_acctbal", "orders": "o_totalprice"}
    out = None
    for name, df in tab.load_tables(t.spark, saved).items():
        one = df.agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.sum(values[name]).alias("total"))
        out = one if out is None else out.unionByName(one)
    return rounded(out, 2)


@query(
    "kpi_csv",
    """SELECT 'Rows' AS kpi, ROUND(CAST(COUNT(*) AS DOUBLE), 4) AS value FROM supplier UNION ALL SELECT 'Cols', CAST(2 AS DOUBLE)
       UNION ALL SELECT 'Missing%', 0.0 FROM supplier HAVING COUNT(*) > 0 UNION ALL SELECT 'Mean_s_suppkey', ROUND(AVG(s_suppkey), 4) FROM supplier
       UNION ALL SELECT 'Mean_s_acctbal', ROUND(AVG(s_acctbal), 4) FROM supplier""",
)
def kpi_csv(t):
    path = _scratch(t, "kpis.csv")
    tab.write_kpis(kpi_table(t.supplier.select("s_suppkey", "s_acctbal")), path)
    return rounded(t.spark.read.option("header", True).schema("kpi string, value double").csv(path), 4)


@query("messy_columns", "SELECT s_suppkey AS code, s_name AS name, ROUND(s_acctbal, 6) AS balance FROM supplier")
def messy_columns(t):
    """Blanks in names, a repeated name, an empty row and an empty column go."""
    columns = ["s_suppkey AS ` code`", "s_name AS `name `", "s_acctbal AS balance", "s_nationkey AS ` balance`", "CAST(NULL AS STRING) AS hollow"]
    one = t.supplier.selectExpr(*columns)
    nothing = t.spark.range(3).selectExpr("CAST(NULL AS LONG)", "CAST(NULL AS STRING)", "CAST(NULL AS DOUBLE)", "CAST(NULL AS LONG)", "CAST(NULL AS STRING)")
    return rounded(cl.drop_empty_columns(cl.drop_empty_rows(cl.tidy_names(one.union(nothing)))))
