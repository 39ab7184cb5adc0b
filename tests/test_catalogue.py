"""Every registered query with a check gives the rows DuckDB gives on the whole tables."""

import pytest
from compare import DATA, compare, connect

from millrace.plans.catalogue import CHECKS, QUERIES

FOLDER = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = connect(FOLDER)
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_equals_check(spark, duck, name):
    assert compare(QUERIES[name](spark, FOLDER), duck, CHECKS[name]) is None


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
