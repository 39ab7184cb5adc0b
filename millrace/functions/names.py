"""Column lookup by name hints and by type. Works on metadata only."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def resolve(columns, *names: str) -> str | None:
    """First exact match over all hints (case folded), then the first substring match."""
    folded = {}
    for column in columns:
        folded.setdefault(str(column).lower(), column)
    hints = [n.lower() for n in names]
    exact = next((folded[h] for h in hints if h in folded), None)
    if exact is not None:
        return exact
    return next((real for h in hints for low, real in folded.items() if h in low), None)


def normalise(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", str(name).strip().lower()).strip("_")


def is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_time(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType))


def _typed(df: DataFrame, test) -> list[str]:
    return [f.name for f in df.schema.fields if test(f.dataType)]


def numeric_columns(df: DataFrame) -> list[str]:
    """Integer, float and decimal columns; booleans are not numbers here."""
    return _typed(df, is_number)


def string_columns(df: DataFrame) -> list[str]:
    return _typed(df, lambda t: isinstance(t, T.StringType))


def time_columns(df: DataFrame) -> list[str]:
    return _typed(df, is_time)


def quoted(name: str) -> str:
    """Column name safe to pass to F.col."""
    return "`" + name.replace("`", "``") + "`"
