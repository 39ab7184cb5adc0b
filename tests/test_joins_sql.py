import pandas as pd
import pytest

from pyspark.sql import functions as F

from millrace.operators import joins
from millrace.operators.joins import join_many, join_totals, join_two, suggest_keys
from millrace.plans.sql_lab import Workspace, example_queries, run_sql


def frames(spark):
    left = pd.DataFrame({"k": [1, 2, 2, None, 5], "v": ["a", "b", "c", "d", "e"]})
    right = pd.DataFrame({"k": [2, None, None, 7], "v": ["x", "y", "z", "w"]})
    schema = "k double, v string"
    fix = lambda d: [tuple(None if pd.isna(x) else x for x in r) for r in d.itertuples(index=False)]
    return left, right, spark.createDataFrame(fix(left), schema), spark.createDataFrame(fix(right), schema)


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_same_as_pandas_merge(spark, how):
    left, right, l, r = frames(spark)
    want = left.merge(right, how=how, on=["k"], suffixes=("_l", "_r"))
    got, meta = join_two(l, r, how, on=["k"])
    assert got.columns == list(want.columns) == meta["columns"]
    key = lambda rows: sorted(str([None if pd.isna(x) else x for x in row]) for row in rows)
    assert key([tuple(x) for x in got.collect()]) == key(want.itertuples(index=False, name=None))


def test_sql_nulls_on_request(spark):
    _, _, l, r = frames(spark)
    assert join_two(l, r, "inner", on=["k"], null_safe=False)[0].count() == 2


def test_empty_right_and_log(spark):
    _, _, l, _ = frames(spark)
    empty = spark.createDataFrame([], "k double, note string")
    out, log = join_many({"a": l, "b": empty}, [{"left": "a", "right": "b", "how": "left", "on": ["k"]}], count_rows=True)
    assert out.count() == 5 and out.where("note is not null").count() == 0
    assert log[0]["rows"].get["result_rows"] == 5 and log[0]["keys"] == ["k"]


def test_keys(spark):
    a = spark.createDataFrame([], "zone string, machine_id string, x int")
    b = spark.createDataFrame([], "machine_id string, zone string, y int")
    assert suggest_keys(a, b) == ["machine_id", "zone"]
    with pytest.raises(ValueError):
        join_two(a, spark.createDataFrame([], "q int"))
    with pytest.raises(ValueError):
        join_two(a, b, "cross")


@pytest.fixture
def loads(spark):
    return {"my table": spark.createDataFrame([(1, 2.0), (2, 3.0)], "id int, load double")}


def test_gate_accepts_queries(spark, loads):
    assert run_sql(spark, "SELECT load FROM my_table ORDER BY load DESC;", loads).collect()[0]["load"] == 3.0
    assert run_sql(spark, "WITH t AS (SELECT * FROM my_table) SELECT * FROM t LIMIT 1", loads).count() == 1
    assert len(example_queries("my table")) == 3


@pytest.mark.parametrize(
    "text",
    [
        "", "DROP TABLE my_table", "CREATE TABLE x AS SELECT 1", "SET spark.sql.ansi.enabled=false",
        "WITH t AS (SELECT * FROM my_table) INSERT INTO my_table SELECT * FROM t",
        "FROM my_table INSERT INTO my_table SELECT *", "SELECT 1; SELECT 2",
        "SELECT * FROM parquet.`/root/testdata/sf0.001/nation.parquet`",
        "SELECT java_method('java.lang.System', 'setProperty', 'zz', '1') FROM my_table",
        "SELECT * FROM my_table WHERE id IN (SELECT reflect('java.lang.Math', 'abs', 1))",
        "WITH t AS (SELECT try_reflect('java.lang.System', 'exit', 0) AS x) SELECT x FROM t",
        "SELECT id FROM my_table ORDER BY (SELECT MAX(java_method('java.lang.Math', 'abs', id)) FROM my_table)",
        "SELECT no_such_function(id) FROM my_table", "SELECT * FROM other_table", "SELECT * FROM spark_catalog.default.my_table",
        "SELECT * FROM IDENTIFIER('my_table')",
    ],
)
def test_gate_refuses(spark, loads, text):
    with pytest.raises(ValueError):
        run_sql(spark, text, loads)


def test_gate_refuses_own_functions(spark, loads):
    spark.udf.register("twice", lambda x: 2 * x, "int")
    with pytest.raises(ValueError):
        run_sql(spark, "SELECT twice(id) FROM my_table", loads)


def test_workspace(spark, loads):
    work = Workspace(spark, {**loads, "names": spark.createDataFrame([(1, "x")], "id int, name string")})
    assert work.active == "names" and work.join("my table", "names", "left", on=["id"]).count() == 2
    assert work.active == "joined" and ("joined", 3, True) in work.listing() and work.working().columns == ["id", "load", "name"]
    assert work.sql("SELECT COUNT(name) AS n FROM joined").first()["n"] == 1


def test_totals_of_a_join_make_no_pairs(spark):
    left = spark.range(3000).selectExpr("CASE WHEN id % 3 > 0 THEN id % 3 END AS k", "id * 0.5D AS v")
    right = spark.range(2000).selectExpr("CASE WHEN id % 4 > 0 THEN id % 4 END AS k", "id * 1.0D AS v")
    for null_safe in (True, False):
        joined, _ = join_two(left, right, on=["k"], null_safe=null_safe)
        want = joined.groupBy("k").agg(F.count("*").alias("pairs"), F.sum("v_l").alias("a"), F.sum("v_r").alias("b"))
        got = join_totals(left, right, ["k"], {"l.v": "a", "r.v": "b"}, null_safe=null_safe)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


@pytest.mark.parametrize("how,sent", [("inner", 1000), ("left", 1000), ("left", 0)])
def test_a_spread_join_deals_a_key_over_tasks(spark, monkeypatch, how, sent):
    monkeypatch.setattr(joins, "SPREAD_ROWS", 1000)
    monkeypatch.setattr(joins, "SPREAD_SENT", sent)
    left = spark.range(400).selectExpr("CASE WHEN id % 5 > 0 THEN id % 2 END AS k", "id AS a")
    right = spark.range(60).selectExpr("CASE WHEN id % 7 > 0 THEN id % 2 * 3 END AS k", "id AS b")
    plain, _ = join_two(left, right, how, on=["k"])
    spread, _ = join_two(left, right, how, on=["k"], spread=True)
    assert sorted(map(tuple, spread.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
    if sent:
        assert spread.groupBy(F.spark_partition_id().alias("p"), "k").count().where("k = 0").count() > 2
