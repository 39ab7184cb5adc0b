import os
import subprocess
import sys

import pytest

from millrace.session import checkpoint, temporary_tables

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

CODE = """
import sys
sys.path.insert(0, {root!r})
from millrace import build_session
from millrace.operators.anomaly import anomaly_summary
spark = build_session("shipped", "local[1]", {{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2",
    "spark.checkpoint.dir": sys.argv[1], "spark.driver.host": "127.0.0.1"}}, shipped=True)
df = spark.range(60).selectExpr("CAST(id AS DOUBLE) AS a", "CAST(id * id AS DOUBLE) AS b")
assert anomaly_summary(df, ["a", "b"]).first()["rows"] == 60
spark.stop()
"""


def test_workers_without_the_package(tmp_path):
    """Workers started in another folder get the package from the session."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"SPARK_LOCAL_IP": "127.0.0.1"}
    subprocess.run([sys.executable, "-c", CODE.format(root=ROOT), str(tmp_path / "shared")], cwd=tmp_path, env=env, check=True, timeout=300)


def test_temporary_tables_go_at_the_end(spark):
    df = spark.range(20)
    kept = checkpoint(df)
    with temporary_tables(spark):
        outer = checkpoint(df)
        with pytest.raises(ZeroDivisionError), temporary_tables(spark):
            inner = checkpoint(df)
            assert inner.count() == 20
            raise ZeroDivisionError
        assert outer.count() == kept.count() == 20
        files = [p.removeprefix("file:") for df in (outer, inner, kept) for p in df.inputFiles()[:1]]
        assert [os.path.exists(f) for f in files] == [True, False, True]
    assert [os.path.exists(f) for f in files] == [False, False, True]
