"""Star build and the value-of-losses estimate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.cast import moment, number
from millrace.functions.names import quoted, resolve


def star(df: DataFrame, entity: str, facts: Sequence[str], date: str | None = None) -> dict[str, DataFrame]:
    """One fact table (sums at date x entity grain) and its dimension tables.

    A sum over missing values only stays missing. The dimensions come from the fact table's keys, so the
    source is grouped once.
    """
    facts = [f for f in facts if f in df.columns]
    if entity not in df.columns or not facts:
        raise ValueError("pick an entity column and at least one numeric fact")
    day = [F.to_date(moment(df, date)).alias("date_key")] if date else []
    # An entity that is missing is an entity of its own, spelled as text like any other.
    name = F.coalesce(F.col(quoted(entity)).cast("string"), F.lit("nan")).alias("entity_key")
    fact = df.groupBy(*day, name).agg(
        *[F.sum(number(df, f)).alias(f) for f in facts], F.count("*").alias("fact_rows")
    )
    out = {"fact": fact}
    if date:
        days = fact.select("date_key").where("date_key is not null").distinct()
        out["date_dim"] = days.select(
            "date_key",
            F.year("date_key").alias("year"),
            F.month("date_key").alias("month"),
            F.dayofmonth("date_key").alias("day"),
            F.date_format("date_key", "EEEE").alias("weekday"),
        )
    out["entity_dim"] = fact.select("entity_key").distinct().withColumn("entity_role", F.lit(entity))
    return out


# Columns that carry lost time, lost units and revenue.
HOUR_HINTS = (
    ("downtime_hours", "down_hours", "lost_hours", "idle_hours"),
    ("downtime_minutes", "downtime_min", "down_min", "stop_minutes", "idle_min", "duration_min"),
    ("downtime", "down_time", "idle_time", "lost_time"),
)
UNIT_HINTS = ("scrap", "reject_count", "rejects", "defect_qty", "loss_qty", "waste_qty")
REVENUE_HINTS = ("revenue", "sales", "amount", "gmv", "net_sales", "total")
LOSS_DOMAINS = ("plant_oee", "quality", "generic", "predictive_maintenance")
REVENUE_DOMAINS = ("sales", "forecasting", "generic")


def _by_role(roles: Mapping[str, str], columns, *wanted: str) -> str | None:
    return next((col for w in wanted for col, role in roles.items() if role == w and col in columns), None)


def money_impact(
    df: DataFrame,
    usd_per_hour: float = 0.0,
    usd_per_unit: float = 0.0,
    roles: Mapping[str, str] | None = None,
    domain: str = "generic",
) -> DataFrame:
    """Price lost hours, lost units and revenue in one aggregation. Lost time in minutes is converted."""
    roles = roles or {}
    hours_col = units_col = revenue_col = None
    if domain in LOSS_DOMAINS:
        hours_col = _by_role(roles, df.columns, "downtime", "loss")
        for hints in HOUR_HINTS:
            hours_col = hours_col or resolve(df.columns, *hints)
        units_col = _by_role(roles, df.columns, "scrap", "defect", "qty") or resolve(df.columns, *UNIT_HINTS)
    if domain in REVENUE_DOMAINS:
        revenue_col = _by_role(roles, df.columns, "revenue", "metric") or resolve(df.columns, *REVENUE_HINTS)

    def total(name: str | None, wanted: bool = True):
        return F.coalesce(F.sum(number(df, name)), F.lit(0.0)) if name and wanted else F.lit(0.0)

    sums = df.agg(
        total(hours_col, usd_per_hour > 0).alias("time_total"),
        total(units_col, usd_per_unit > 0).alias("qty_loss"),
        total(revenue_col).alias("revenue_total"),
        F.count("*").alias("rows"),
    )
    named_minutes = "min" in (hours_col or "").lower()
    minutes = F.lit(named_minutes) | (F.col("time_total") > 24 * F.greatest(F.col("rows"), F.lit(1)))
    priced = sums.select(
        F.when(minutes, F.col("time_total") / 60.0).otherwise(F.col("time_total")).alias("hours"),
        "qty_loss",
        "revenue_total",
        (minutes & F.lit("hour" not in (hours_col or "").lower()) & F.lit(bool(hours_col))).alias("minutes_assumed"),
    )
    zero = F.lit(0.0)
    revenue_usd = F.col("revenue_total") if domain in ("sales", "forecasting") else zero
    usd = priced.select(
        "*",
        (F.greatest("hours", zero) * max(usd_per_hour, 0.0)).alias("downtime_usd"),
        (F.greatest("qty_loss", zero) * max(usd_per_unit, 0.0)).alias("qty_usd"),
        revenue_usd.alias("revenue_usd"),
    )
    return usd.withColumn("total_usd", F.col("downtime_usd") + F.col("qty_usd") + F.col("revenue_usd")).withColumn(
        "ok",
        (F.col("total_usd") > 0) | (F.col("hours") > 0) | (F.col("qty_loss") > 0) | (F.col("revenue_total") > 0),
    )
