"""Read-only SQL over named tables."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

from py4j.java_gateway import is_instance_of
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.cast import number
from millrace.functions.names import is_number, quoted
from millrace.operators.joins import join_many, join_two

# Built-in functions that call any Java method.
REFUSED = {"java_method", "reflect", "try_reflect"}


def view_name(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9_]", "_", name)


def register(tables: Mapping[str, DataFrame]) -> list[str]:
    for name, df in tables.items():
        df.createOrReplaceTempView(view_name(name))
    return [view_name(n) for n in tables]


def _items(seq) -> Iterator:
    for i in range(seq.size()):
        yield seq.apply(i)


def _walk(spark: SparkSession, plan) -> Iterator[tuple[str, object]]:
    """(class name, node) of every plan and expression of a parsed statement, subqueries included."""
    base = "org.apache.spark.sql.catalyst."
    is_a = lambda node, kind: is_instance_of(spark.sparkContext._gateway, node, base + kind)
    todo = [plan]
    while todo:
        node = todo.pop()
        yield node.getClass().getSimpleName(), node
        todo.extend(_items(node.children()))
        if is_a(node, "plans.QueryPlan"):
            todo.extend(_items(node.expressions()))
            # Common table expressions stand beside the children.
            todo.extend(x for x in _items(node.innerChildren()) if is_a(x, "plans.QueryPlan"))
        elif is_a(node, "expressions.SubqueryExpression"):
            todo.append(node.plan())


def check_read_only(spark: SparkSession, query: str) -> None:
    """Refuse what is not one query over registered views and built-in functions. Nothing is run or even analysed."""
    try:
        # Only a query can stand in parentheses.
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(f"SELECT * FROM (\n{query}\n)")
    except Exception as problem:
        raise ValueError(f"not a query: {problem}") from problem
    names, functions, known = set(), set(), set()
    for kind, node in _walk(spark, plan):
        if kind == "UnresolvedRelation":
            names.add(".".join(_items(node.multipartIdentifier())).lower())
        elif kind in ("UnresolvedFunction", "UnresolvedTableValuedFunction", "UnresolvedTVFAliases"):
            parts = node.nameParts() if kind == "UnresolvedFunction" else node.name()
            functions.add(".".join(_items(parts)).lower())
        elif kind == "UnresolvedWith":
            known.update(pair._1().lower() for pair in _items(node.cteRelations()))
        elif kind in ("PythonUDF", "ScalaUDF", "UnresolvedIdentifier", "PlanWithUnresolvedIdentifier", "ExpressionWithUnresolvedIdentifier"):
            raise ValueError(f"{kind} is not allowed")
    views = {t.name.lower() for t in spark.catalog.listTables() if t.isTemporary}
    if strange := names - views - known:
        raise ValueError(f"not a registered table: {', '.join(sorted(strange))}")
    builtin = {r.function.lower() for r in spark.sql("SHOW SYSTEM FUNCTIONS").collect()}
    if wrong := functions & REFUSED or functions - builtin:
        raise ValueError(f"function not allowed: {', '.join(sorted(wrong))}")


def run_sql(spark: SparkSession, query: str, tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Run one query over `tables` and the views registered before; anything else is refused unexecuted."""
    text = (query or "").strip().rstrip(";").strip()
    if not text:
        raise ValueError("empty SQL")
    register(tables or {})
    check_read_only(spark, text)
    try:
        return spark.sql(text)
    except Exception as problem:
        raise ValueError(f"not a query over the named tables: {problem}") from problem


class Workspace:
    """Named tables and the one in use; a join adds its result as `joined` and puts it in use."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame] | None = None):
        self.spark, self.tables, self.active = spark, {}, None
        for name, df in (tables or {}).items():
            self.add(name, df)

    def add(self, name: str, df: DataFrame) -> DataFrame:
        self.tables[name] = df
        self.active = name
        register({name: df})
        return df

    def join(self, left: str, right: str, how: str = "inner", **keys) -> DataFrame:
        return self.add("joined", join_two(self.tables[left], self.tables[right], how, **keys)[0])

    def join_chain(self, steps) -> DataFrame:
        return self.add("joined", join_many(self.tables, steps)[0])

    def listing(self) -> list[tuple[str, int, bool]]:
        """(name, columns, in use) of every table."""
        return [(n, len(df.columns), n == self.active) for n, df in self.tables.items()]

    def working(self) -> DataFrame:
        return self.tables[self.active]

    def sql(self, query: str) -> DataFrame:
        return run_sql(self.spark, query)


def summarize(df: DataFrame) -> DataFrame:
    """One row per column: column_name, column_type, min, max (as text), approx_unique, avg, std, count, null_percentage."""
    aggs, rows = [F.count("*").alias("n")], []
    for i, field in enumerate(df.schema.fields):
        c = F.col(quoted(field.name))
        x = number(df, field.name) if is_number(field.dataType) else F.lit(None).cast("double")
        aggs += [F.min(c).cast("string").alias(f"lo{i}"), F.max(c).cast("string").alias(f"hi{i}"), F.approx_count_distinct(c).alias(f"d{i}"),
                 F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"), F.count(c).alias(f"k{i}")]
        rows.append(F.struct(
            F.lit(field.name).alias("column_name"), F.lit(field.dataType.simpleString()).alias("column_type"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"),
            F.col(f"d{i}").alias("approx_unique"), F.col(f"m{i}").alias("avg"), F.col(f"s{i}").alias("std"), F.col(f"k{i}").alias("count"),
            F.when(F.col("n") > 0, (F.col("n") - F.col(f"k{i}")) / F.col("n") * 100).alias("null_percentage"),
        ))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def example_queries(table: str) -> list[str]:
    t = view_name(table)
    return [
        f"SELECT * FROM {t} LIMIT 20",
        f"SELECT machine_id, AVG(temperature) AS avg_temp, AVG(vibration) AS avg_vib FROM {t} "
        "GROUP BY machine_id ORDER BY avg_vib DESC",
        f"SELECT machine_id, COUNT(*) AS n, AVG(rul) AS avg_rul FROM {t} GROUP BY machine_id",
    ]
