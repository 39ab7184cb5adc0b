"""Readers and writers for table files."""

from __future__ import annotations

import io
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.cast import moment
from millrace.operators.clean import cast_texts


def read_text_table(
    spark: SparkSession, path: str, sep: str = ",", schema: T.StructType | None = None, multi_line: bool = False
) -> DataFrame:
    """CSV with a header. Without a schema the columns are typed by their content in one aggregation.

    Files are split among the tasks unless `multi_line` says that quoted values hold line breaks; then one task reads a file.
    """
    reader = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", multi_line)
    if schema is not None:
        return reader.schema(schema).csv(path)
    return cast_texts(reader.csv(path))[0]


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = False) -> DataFrame:
    """Read a file or folder by its extension; a ``timestamp`` column is parsed, unreadable values become NULL.

    JSON has one object, or one array of objects, on each line; `multi_line` reads records that go over several lines.
    """
    low = path.lower().rstrip("/")
    if low.endswith((".xlsx", ".xls", ".xlsm")):
        return read_excel(spark, path, schema)
    if low.endswith(".json"):
        reader = spark.read.option("multiLine", multi_line)
        return (reader.schema(schema) if schema is not None else reader).json(path)
    if low.endswith(".parquet"):
        return spark.read.parquet(path)
    df = read_text_table(spark, path, "\t" if low.endswith(".tsv") else ",", schema, multi_line)
    if "timestamp" in df.columns and not low.endswith(".tsv"):
        df = df.withColumn("timestamp", moment(df, "timestamp"))
    return df


def read_excel(spark: SparkSession, path: str, schema: T.StructType | None) -> DataFrame:
    """First sheet of every workbook under a path. Needs a schema and an Excel library on the executors."""
    if schema is None:
        raise ValueError("workbooks are read on the executors; pass the schema of the sheet")
    names = [f.name for f in schema.fields]

    def sheets(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            for content in batch["content"]:
                yield pd.read_excel(io.BytesIO(content))[names]

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(sheets, schema)


def save_tables(tables: Mapping[str, DataFrame | None], folder: str) -> dict[str, str]:
    """Write the tables of a session; empty ones are left out."""
    saved = {}
    for key, df in tables.items():
        if df is not None and df.columns and not df.isEmpty():
            saved[key] = f"{folder.rstrip('/')}/{key}.parquet"
            df.write.mode("overwrite").parquet(saved[key])
    return saved


def load_tables(spark: SparkSession, saved: Mapping[str, str]) -> dict[str, DataFrame]:
    return {key: spark.read.parquet(path) for key, path in saved.items()}


def write_csv(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(folder)


def write_kpis(kpis: DataFrame, folder: str) -> None:
    """KPI rows as CSV; an empty list is written as one row ``(none)``."""
    text = kpis.select("kpi", F.col("value").cast("string").alias("value"))
    if text.isEmpty():
        text = kpis.sparkSession.createDataFrame([("(none)", "")], "kpi string, value string")
    write_csv(text, folder)
