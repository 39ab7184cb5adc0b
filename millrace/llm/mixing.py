"""Mix sources to target weights with hash-threshold histograms.

Every document has a fixed hash. A source's budget becomes a threshold: documents below it are taken. The threshold
comes from sums of words by (source, hash bucket): the bucket in which the running sum passes the budget is the only
one cut again, twelve bits at a time, until it is one hash value. Nothing is sorted but the bucket sums, at most 4,096
for each source and round. A budget over a source's size means whole passes first; the threshold then applies to the
last pass, so thresholds of larger budgets hold those of smaller ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import checkpoint

SIZE = r"[^\x20\x09-\x0D]+"
BITS, STEP = 60, 12


def source_targets(totals: DataFrame, weights: tuple[int, ...], share: float, ceiling: int) -> DataFrame:
    """(source, size) -> target: share of all sizes dealt by weight, none above ceiling times its source's size.

    Handing the excess on until none is above has a closed form: with the sources ordered by size per weight, a
    source stops at its ceiling if it would at the level left over by all before it.
    """
    cycle = F.array(*[F.lit(w) for w in weights])
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    t = totals.withColumn("rank", rank).withColumn("weight", F.element_at(cycle, ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("size") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    t = t.select(
        "*",
        (F.lit(share) * F.sum("size").over(everything)).alias("pot"),
        F.sum("weight").over(everything).alias("all_weight"),
        F.coalesce(F.sum("size").over(before), F.lit(0)).alias("size_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("weight_before"),
    )
    full = ceiling * F.col("size") * (F.col("all_weight") - F.col("weight_before")) <= F.col("weight") * (F.col("pot") - ceiling * F.col("size_before"))
    t = t.withColumn("full", full)
    gone = F.when(F.col("full"), F.col("size")).otherwise(0)
    gone_weight = F.when(F.col("full"), F.col("weight")).otherwise(0)
    level = F.col("weight") * (F.col("pot") - ceiling * F.sum(gone).over(everything)) / F.nullif(F.col("all_weight") - F.sum(gone_weight).over(everything), F.lit(0))
    return t.select("source", "size", F.when(F.col("full"), (ceiling * F.col("size")).cast("double")).otherwise(level).alias("target"))


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, left) -> the hash at which the running sum of words passes `left`: columns source, cut, rest, tied."""
    rows = sized.join(budgets.withColumnRenamed("source", "its"), F.col("source").eqNullSafe(F.col("its"))).drop("its")
    for shift in range(BITS - STEP, -1, -STEP):
        bucket = F.shiftright("hash", shift)
        sums = rows.groupBy("source", "left", bucket.alias("bucket")).agg(F.sum("size").alias("held"))
        upto = F.sum("held").over(Window.partitionBy("source").orderBy("bucket"))
        edge = sums.withColumn("upto", upto).where((F.col("upto") >= F.col("left")) & (F.col("upto") - F.col("held") < F.col("left")))
        edge = checkpoint(edge.select(F.col("source").alias("its"), "bucket", "held", (F.col("left") - F.col("upto") + F.col("held")).alias("rest")))
        if shift:
            inside = F.col("source").eqNullSafe(F.col("its")) & (bucket == F.col("bucket"))
            rows = checkpoint(rows.drop("left").join(edge, inside).select("source", "hash", "size", F.col("rest").alias("left")))
    return edge.select("its", F.col("bucket").alias("cut"), "rest", F.col("held").alias("tied"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, ceiling: int = 2, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of `docs` (doc_id, text, source).

    `taken` counts the words the mix takes from the row: size for each whole pass, and in the last pass all of it
    below the threshold and nothing above. The row at the threshold gives just the words still missing, so a source
    misses its target by less than one word; rows that share that hash (repeated ids) give in proportion.

    Missing text: size 0. Missing source: a source of its own, last. Missing id: hashed as an empty id. An empty table
    gives an empty result; a source without words has target 0. The hash depends on the id alone, so reruns agree.
    """
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sized = checkpoint(
        docs.select(
            "doc_id",
            "source",
            F.coalesce(F.regexp_count("text", F.lit(SIZE)), F.lit(0)).cast("long").alias("size"),
            F.conv(F.substring(F.md5(name), 1, BITS // 4), 16, 10).cast("long").alias("hash"),
        )
    )
    totals = sized.groupBy("source").agg(F.sum("size").alias("size"))
    plan = source_targets(totals, weights, share, ceiling)
    words = F.floor("target").cast("long")
    passes = F.when(F.col("size") > 0, F.floor(words / F.col("size"))).otherwise(0).cast("long")
    plan = checkpoint(plan.withColumn("passes", passes).withColumn("left", words - passes * F.col("size")))
    cuts = thresholds(sized, plan.where("left > 0").select("source", "left"))
    per_source = plan.withColumnsRenamed({"source": "of", "size": "source_size"})
    per_source = checkpoint(per_source.join(cuts, F.col("of").eqNullSafe(F.col("its")), "left").drop("its", "left"))
    last = F.when(F.col("hash") < F.col("cut"), F.col("size")).when(F.col("hash") == F.col("cut"), F.floor(F.col("size") * F.col("rest") / F.col("tied")))
    taken = F.col("passes") * F.col("size") + F.coalesce(last, F.lit(0))
    joined = sized.join(per_source, F.col("source").eqNullSafe(F.col("of")), "left")
    return joined.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))
