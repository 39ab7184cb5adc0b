from pyspark.sql import functions as F

from millrace.llm.sieve import Sieve


def test_holds_every_value_and_few_others(spark):
    values = spark.range(0, 4000).select(F.xxhash64("id").alias("v"))
    sieve = Sieve(values)
    asked = spark.range(0, 40_000).select("id", sieve.may_hold(F.xxhash64("id")).alias("held"))
    passed = {r.id for r in asked.where("held").collect()}
    assert set(range(4000)) <= passed and len(passed) < 6000


def test_empty_and_missing(spark):
    nothing = Sieve(spark.range(0).select(F.xxhash64("id").alias("v")))
    some = spark.createDataFrame([(1,), (None,)], "v long")
    assert some.where(nothing.may_hold(F.col("v"))).count() == 0
    assert some.where(Sieve(some.where("v = 1")).may_hold(F.col("v"))).where("v = 1").count() == 1
