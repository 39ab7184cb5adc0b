"""One-pass column profile and the rules that read column kinds from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.cast import as_number, as_time
from millrace.functions.names import is_number, is_time, normalise, quoted, resolve

UNIQUE_LIKE = 0.85  # share of distinct values above which a column identifies rows


def distinct_counts(df: DataFrame) -> DataFrame:
    """(i, distinct): exact number of values per column position.

    Columns are turned into (position, value) pairs, which shuffle once, combined on the map side. One
    count(distinct) per column in a single aggregation would expand every row by all columns and is far slower.
    """
    values = F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.col(quoted(f.name)).cast("string").alias("v"))
            for i, f in enumerate(df.schema.fields)
        ]
    )
    pairs = df.select(F.explode(values).alias("p")).select("p.*").where("v is not null").distinct()
    return pairs.groupBy("i").agg(F.count("*").alias("distinct"))


def column_profile(df: DataFrame, exact: bool = True, times: bool = True, rough: float = 0.05) -> DataFrame:
    """One row per column: an aggregation over the table, plus one for exact distinct counts."""
    aggs = [F.count("*").alias("rows")]
    for i, field in enumerate(df.schema.fields):
        c = F.col(quoted(field.name))
        number = as_number(c, field.dataType)
        zeros = F.count_if(number == 0) if is_number(field.dataType) else F.lit(0).cast("long")
        outside = ~number.isin(0.0, 1.0) if is_number(field.dataType) else F.lit(True)
        parsed = F.lit(0).cast("long")
        if is_time(field.dataType):
            parsed = F.count(c)
        elif times and isinstance(field.dataType, T.StringType):
            parsed = F.count(as_time(c, field.dataType))
        aggs += [
            F.count(c).alias(f"n{i}"),
            zeros.alias(f"z{i}"),
            F.coalesce(F.min(c).eqNullSafe(F.max(c)), F.lit(True)).alias(f"c{i}"),
            (F.count_if(c.isNotNull() & outside) == 0).alias(f"b{i}"),
            parsed.alias(f"t{i}"),
        ]
        if not exact:
            aggs.append(F.approx_count_distinct(c, rough).alias(f"d{i}"))
    one = df.agg(*aggs)
    rows = [
        F.struct(
            F.lit(i).alias("i"),
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("type"),
            F.col("rows"),
            F.col(f"n{i}").alias("non_null"),
            (F.lit(0).cast("long") if exact else F.col(f"d{i}")).alias("rough"),
            F.col(f"z{i}").alias("zeros"),
            F.col(f"c{i}").alias("constant"),
            F.col(f"b{i}").alias("binary"),
            F.col(f"t{i}").alias("parsed_times"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    flat = one.select(F.inline(F.array(*rows)))
    distinct = F.col("rough")
    if exact:
        # One row per column on both sides.
        flat = flat.join(F.broadcast(distinct_counts(df)), "i", "left")
        distinct = F.coalesce("distinct", F.lit(0).cast("long"))
    return flat.select(
        "column", "type", "rows", "non_null", distinct.alias("distinct"), "zeros", "constant", "binary", "parsed_times"
    )


def profile_rows(df: DataFrame, exact: bool = True, times: bool = True, rough: float = 0.05) -> dict[str, dict]:
    """The profile as a driver-side mapping; one small row per column."""
    return {r["column"]: r.asDict() for r in column_profile(df, exact, times, rough).collect()}


def _counted(df: DataFrame, profile: dict, names: Sequence[str]) -> dict[str, dict]:
    """The profile with exact distinct counts of these columns."""
    if names:
        exact = {r["i"]: r["distinct"] for r in distinct_counts(df.select(*[F.col(quoted(n)) for n in names])).collect()}
        for i, n in enumerate(names):
            profile[n]["distinct"] = exact.get(i, 0)
    return profile


def bounded_profile(df: DataFrame, limit: int = 80, times: bool = False) -> dict[str, dict]:
    """The profile for decisions of the kind "at most ``limit`` values".

    All columns are sketched; only those that may be within the limit are counted exactly, so columns with many
    values are never shuffled.
    """
    profile = profile_rows(df, exact=False, times=times)
    return _counted(df, profile, [n for n, p in profile.items() if p["distinct"] <= 2 * limit + 20])


def kinds_profile(df: DataFrame) -> dict[str, dict]:
    """The profile for kinds of columns, which ask for few values and for a share of distinct ones above UNIQUE_LIKE.

    All columns are sketched with a deviation of 1 %; those within five deviations of the share, or of few values, are
    counted exactly.
    """
    profile = profile_rows(df, exact=False, rough=0.01)
    return _counted(df, profile, [n for n, p in profile.items() if p["distinct"] <= 100 or abs(p["distinct"] / max(p["non_null"], 1) - UNIQUE_LIKE) <= 0.05])


def kind_of(field: T.StructField, stats: dict) -> str:
    """date, number, text, id_like or boolean. The storage type decides before any content test."""
    name, dtype = normalise(field.name), field.dataType
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if is_time(dtype):
        return "date"
    rows, known, distinct = stats["rows"], stats["non_null"], stats["distinct"]
    unique_like = known > 0 and ((distinct / known > UNIQUE_LIKE and distinct > 5) or (distinct == known and known > 3))
    if is_number(dtype):
        if 0 < distinct <= 2 and stats["binary"]:
            return "boolean"
        named = any(k in name for k in ("id", "key", "code", "sku", "uuid"))
        return "id_like" if named or unique_like else "number"
    rate = stats["parsed_times"] / rows if rows else 0.0
    time_named = "date" in name or "time" in name
    if stats["parsed_times"] >= max(3, rows // 2) and (rate >= 0.85 or (rate >= 0.6 and time_named)):
        return "date"
    named = any(k in name for k in ("id", "key", "uuid", "customer", "order", "asset", "machine"))
    if named and (unique_like or name.endswith("_id")):
        return "id_like"
    return "text"


def column_kinds(df: DataFrame, profile: dict | None = None) -> dict[str, str]:
    profile = profile or kinds_profile(df)
    return {f.name: kind_of(f, profile[f.name]) for f in df.schema.fields}


def chart_numbers(df: DataFrame) -> list[str]:
    """Numeric columns fit to plot: identifiers are left out."""
    out = []
    for field in df.schema.fields:
        low = field.name.lower()
        if is_number(field.dataType) and low not in ("id", "index") and not low.endswith("_id"):
            out.append(field.name)
    return out


def categories(df: DataFrame, profile: dict, max_unique: int = 80) -> list[str]:
    """Columns with 2..max_unique values; numeric ones only up to 20."""
    out = []
    for field in df.schema.fields:
        distinct = profile[field.name]["distinct"]
        top = 20 if is_number(field.dataType) else max_unique
        if 1 < distinct <= min(top, max_unique):
            out.append(field.name)
    return out


def chart_categories(df: DataFrame, profile: dict, max_unique: int = 40) -> list[str]:
    out = []
    for field in df.schema.fields:
        stats = profile[field.name]
        if is_time(field.dataType) or not 2 <= stats["distinct"] <= max_unique:
            continue
        if stats["distinct"] < max(stats["rows"], 1) * 0.9:
            out.append(field.name)
    return out


def date_columns(df: DataFrame) -> list[str]:
    """Columns that read as dates: >=60 % parse, >=3 distinct, years 1970-2100, span of an hour or more."""
    found = [f.name for f in df.schema.fields if is_time(f.dataType)]
    texts = [f for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return found
    aggs = []
    for i, field in enumerate(texts):
        c = F.col(quoted(field.name))
        t = as_time(c, field.dataType)
        aggs += [
            F.count(c).alias(f"n{i}"),
            F.count(t).alias(f"t{i}"),
            F.approx_count_distinct(t).alias(f"d{i}"),
            F.min(t).alias(f"lo{i}"),
            F.max(t).alias(f"hi{i}"),
        ]
    row = df.agg(*aggs).first()
    rated = []
    for i, field in enumerate(texts):
        known, parsed, lo, hi = row[f"n{i}"], row[f"t{i}"], row[f"lo{i}"], row[f"hi{i}"]
        if not known or parsed / known < 0.6 or row[f"d{i}"] < 3:
            continue
        if 1970 <= lo.year and hi.year <= 2100 and (hi - lo).total_seconds() >= 3600:
            rated.append((parsed / known, field.name))
    return found + [name for _, name in sorted(rated, reverse=True)]


def date_column(df: DataFrame, role: str | None = None) -> str | None:
    dates = date_columns(df)
    if role in dates:
        return role
    return dates[0] if dates else None


def time_name(columns) -> str | None:
    return resolve(columns, "timestamp", "date", "time", "datetime")
