"""Lenient casts: unreadable input becomes NULL, NaN becomes NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.names import is_number, is_time, quoted

# Spellings that stand for a missing value, matched exactly.
NULL_SENTINELS = ["", "NA", "N/A", "null", "NULL", "None", "-", "--"]

# A plain cast would also accept Java suffixes such as 1d or 2f.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

# Shape of a text -> format it is parsed with; None is the ISO form. Parsing is tried only on a text of the right
# shape, because every failed attempt costs an exception.
TIME_SHAPES = {
    r"^\d{4}-\d{1,2}(-\d{1,2}([ T].*)?)?$": None,
    r"^\d{4}/\d{2}/\d{2}$": "yyyy/MM/dd",
    r"^\d{2}/\d{2}/\d{4}$": "MM/dd/yyyy",
    r"^\d{2}-[A-Za-z]{3}-\d{4}$": "dd-MMM-yyyy",
    r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}$": "MM/dd/yyyy HH:mm:ss",
    r"^\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}$": "yyyy/MM/dd HH:mm:ss",
}


def as_number(column: Column, dtype: T.DataType) -> Column:
    """Double value of a column of the given type."""
    if isinstance(dtype, T.StringType):
        return F.when(column.rlike(NUMBER_PATTERN), F.trim(column).try_cast("double"))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(column), column.cast("double"))
    if is_number(dtype) or isinstance(dtype, T.BooleanType):
        return column.cast("double")
    return F.lit(None).cast("double")


def number(df: DataFrame, name: str) -> Column:
    return as_number(F.col(quoted(name)), df.schema[name].dataType)


def as_time(column: Column, dtype: T.DataType) -> Column:
    """UTC timestamp of a column; numbers are never read as dates."""
    if is_time(dtype):
        return column.cast("timestamp")
    if isinstance(dtype, T.StringType):
        text = F.trim(column)
        found = F.lit(None).cast("timestamp")
        for shape, layout in reversed(TIME_SHAPES.items()):
            parsed = F.try_to_timestamp(text, F.lit(layout)) if layout else F.try_to_timestamp(text)
            found = F.when(text.rlike(shape), parsed).otherwise(found)
        return found
    return F.lit(None).cast("timestamp")


def moment(df: DataFrame, name: str) -> Column:
    return as_time(F.col(quoted(name)), df.schema[name].dataType)


def nan_to_null(df: DataFrame) -> DataFrame:
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(
        *[
            F.when(~F.isnan(quoted(c)), F.col(quoted(c))).alias(c) if c in floating else F.col(quoted(c))
            for c in df.columns
        ]
    )


def ratio(top: Column, bottom: Column) -> Column:
    """Division that gives NULL on a zero divisor."""
    return F.try_divide(top, bottom)
