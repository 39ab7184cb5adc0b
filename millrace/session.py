"""Session settings and the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every operator relies on. ANSI stays on, so casts use the try_ family.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, for sessions whose workers don't have it installed."""
    root = Path(__file__).resolve().parent
    packed = Path(tempfile.mkdtemp(prefix="millrace-package-")) / "millrace.zip"
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(packed))
    return spark


def build_session(app: str = "millrace", master: str | None = None, extra: dict | None = None, shipped: bool = False) -> SparkSession:
    """A session with this package's settings. `shipped` sends the package to the executors."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **(extra or {})}.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate()) if shipped else builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session somebody else started."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only in local mode."""
    sc = spark.sparkContext
    known = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-checkpoint-"))
    return sc.getCheckpointDir()


# Folders of the tables written inside `temporary_tables` blocks, innermost last.
_MADE: list[list[str]] = []


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder in whatever file system its path names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Delete the checkpoint tables written inside the block when it ends.

    Write or collect results inside the block: what still reads those tables cannot be run after it.
    """
    _MADE.append([])
    try:
        yield
    finally:
        for folder in _MADE.pop():
            drop_folder(spark, folder)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage: write the table to the checkpoint folder and read it back.

    The table stays until the folder is cleared, or until the `temporary_tables` block it was written in ends. Unlike a checkpointed RDD the written table has a known size, so Spark may still broadcast it when it is
    small, and reads only the columns asked for.
    """
    folder = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    if _MADE:
        _MADE[-1].append(folder)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
