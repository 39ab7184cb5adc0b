"""Batch work over stored records: top actions, weekly briefs, latest mapping versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.windows import first_seen, latest

# Actions that fill a short list, and those of an owner without any finding.
DEFAULT_ACTIONS = [
    "Review the KPIs and pin the weakest metric on the board.",
    "Send the weekly pack once mail is set up.",
    "Save a named column mapping so the next file maps by itself.",
]
NO_FINDINGS = [
    "Run the cleaning and the quality checks.",
    "Pin the weakest KPI on the board.",
    "Send the weekly pack once mail is set up.",
]


def top_actions(findings: DataFrame, owners: DataFrame, limit: int = 3) -> DataFrame:
    """(owner, rank, action): the first distinct findings per owner, filled up with defaults.

    ``findings`` has (owner, priority, seq, text); texts that differ in blanks or case only count once.
    """
    known = findings.where("text is not null and trim(text) <> ''").select("owner", "priority", "seq", F.trim("text").alias("text"))
    distinct = first_seen(known, "text", ["priority", "seq"], ["owner"])
    per_owner = Window.partitionBy("owner").orderBy("priority", "seq")
    # The row number limit is applied before the shuffle, so an owner with very many findings stays cheap.
    short = distinct.withColumn("n", F.row_number().over(per_owner)).where(F.col("n") <= limit).select("owner", "n", "text")
    has = short.select("owner").distinct().withColumn("has", F.lit(True))
    fill = owners.select("owner").distinct().join(has, "owner", "left").select(
        "owner",
        F.explode(F.transform(
            F.when(F.col("has"), F.array(*[F.lit(x) for x in DEFAULT_ACTIONS])).otherwise(F.array(*[F.lit(x) for x in NO_FINDINGS])),
            lambda text, i: F.struct((F.lit(1000) + i).alias("n"), text.alias("text")),
        )).alias("d"),
    ).select("owner", "d.n", "d.text")
    # At most limit + 3 rows per owner.
    both = first_seen(short.unionByName(fill), "text", ["n"], ["owner"])
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("owner").orderBy("n")))
    return ranked.where(F.col("rank") <= limit).select("owner", "rank", F.col("text").alias("action"))


def impact_line(impact: DataFrame) -> DataFrame:
    """The money estimate as a finding."""
    qty = F.when(F.col("qty_loss") != 0, F.format_string(", %.0f qty", "qty_loss")).otherwise("")
    text = F.concat(F.format_string("Price the loss: ~$%,.0f (%.1f h downtime/loss", "total_usd", "hours"), qty, F.lit(")."))
    return impact.where("ok and total_usd > 0").select(text.alias("text"))


def weekly_briefs(jobs: DataFrame, sessions: DataFrame, day: str) -> DataFrame:
    """(user_id, email, brief, last_run) for every enabled weekly job with an address.

    ``sessions`` has (user_id, created_at, session_id, actions array, impact, kpis array of name and value);
    the newest one per user counts.
    """
    due = jobs.where((F.col("enabled")) & (F.col("job_type") == "weekly_report") & (F.coalesce("email", F.lit("")) != ""))
    newest = latest(sessions, ["created_at", "session_id"], ["user_id"])
    joined = due.select("user_id", "email").join(newest, "user_id", "left")
    empty_actions, empty_kpis = F.array(F.lit("No actions yet")), F.array(F.struct(F.lit("No KPIs").alias("name"), F.lit("-").alias("value")))
    actions = F.slice(F.when(F.size("actions") > 0, F.col("actions")).otherwise(empty_actions), 1, 3)
    kpis = F.slice(F.when(F.size("kpis") > 0, F.col("kpis")).otherwise(empty_kpis), 1, 5)
    body = F.concat(
        F.lit(f"Weekly brief\nDate: {day}\n\nTop 3 actions:\n"),
        F.array_join(F.transform(actions, lambda a, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), a)), "\n"),
        F.lit("\n\nImpact: "), F.coalesce("impact", F.lit("N/A")), F.lit("\n\nKPI summary:\n"),
        F.array_join(F.transform(kpis, lambda k: F.concat(F.lit("  - "), k["name"], F.lit(": "), k["value"])), "\n"),
    )
    return joined.select("user_id", "email", body.alias("brief"), F.lit(day).alias("last_run"))


def latest_versions(records: DataFrame, keys: Sequence[str] = ("user_id", "name"), order_by: Sequence[str] = ("updated_at",)) -> DataFrame:
    """The newest version of every saved record of an append-only table."""
    return latest(records, order_by, keys)
