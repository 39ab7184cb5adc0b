"""From documents to a training mix, in five stages over whole tables.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's
docs. The first four return the columns of documents without the rows they turn down. The last also says how many words
of a document the mix takes, 0 rows being left out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontaminate, mixing, neardup, quality, secrets
from millrace.llm.queries import table
from millrace.session import checkpoint_dir, drop_folder, temporary_tables


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.only_good(docs, table(spark, sf_dir)("labels"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    table(spark, sf_dir)
    return neardup.without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a twentieth or more of benchmark passages go."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir)("benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a secret go."""
    table(spark, sf_dir)
    return secrets.without_secrets(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: doc_id, size, source_size, target, taken."""
    table(spark, sf_dir)
    return mixing.mix(docs).where("taken > 0")


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", source_mix),
]

# The classifier is fitted in floating point, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        with temporary_tables(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(f"{folder}/{number}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{number}")
        if number:
            drop_folder(spark, f"{folder}/{number - 1}")
    return docs
