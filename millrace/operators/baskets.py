"""Baskets, frequent itemsets up to three items, and association rules.

Counting follows count distribution: every task counts all candidates over its own baskets with matrix products and emits one
number per candidate, so neither item pairs nor baskets are shuffled. Beyond TILE frequent items, or more candidate triples
than may be sent, the pairs and triples of each basket are counted by aggregations instead. Items, pairs, candidates and
results are tables; none of them passes through the driver beyond those bounds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.cast import number
from millrace.functions.names import quoted
from millrace.operators.ordering import row_index
from millrace.operators.quantiles import exact_quantiles
from millrace.session import checkpoint

# Items counted by matrices: a task's counts have TILE x TILE cells.
TILE = 2048
CELLS = 4_000_000
# Candidate triples that may be sent to every task, 24 bytes each.
MOST_SENT = 500_000
MIN_BASKETS = 8


def baskets_from_pairs(df: DataFrame, txn: str, item: str) -> DataFrame:
    """Distinct (basket, item) pairs; missing and blank items are left out."""
    text = F.col(quoted(item)).cast("string")
    pairs = df.select(F.col(quoted(txn)).alias("basket"), text.alias("item"))
    return pairs.where("basket is not null and item is not null and trim(item) <> ''").distinct()


def baskets_from_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One basket per row: each column as HIGH (at or above its median) or LOW."""
    medians = exact_quantiles(df, {n: number(df, n) for n in columns}, [0.5])
    tags = []
    for n in columns:
        if medians[n][0] is not None:
            x = number(df, n)
            tags.append(F.when(x >= medians[n][0], F.lit(f"{n}=HIGH")).when(x.isNotNull(), F.lit(f"{n}=LOW")))
    items = F.array_compact(F.array(*tags))
    return df.select(items.alias("items")).where(F.size("items") > 0)


@dataclass
class _Short:
    """Baskets cut down to frequent items as positions, ascending; the items with their counts; both as written tables."""

    baskets: DataFrame  # items array<int>
    items: DataFrame  # pos, item, n
    width: int  # number of items
    total: int  # number of baskets


def _short_baskets(baskets: DataFrame, min_support: float) -> _Short:
    """Takes either distinct (basket, item) pairs or rows with an ``items`` array without repeats.

    The frequent items number no more than mean basket size / min_support. They stay a table; only up to TILE of them are
    put into the plan, to number the items of rows in place.
    """
    if "items" in baskets.columns:
        total = baskets.count()
        pairs = baskets.select(F.explode("items").alias("item"))
    else:
        total = baskets.agg(F.count_distinct("basket").alias("n")).first()["n"]
        pairs = baskets
    counts = pairs.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") / F.lit(max(total, 1)) >= min_support)
    items = checkpoint(row_index(counts, ["item"], "pos").select(F.col("pos").cast("int").alias("pos"), "item", "n"))
    width = items.count()
    if "items" in baskets.columns and width <= TILE:
        index = F.create_map(*[e for r in items.collect() for e in (F.lit(r["item"]), F.lit(r["pos"]))])
        found = F.array_compact(F.transform("items", lambda x: index[x])) if width else F.array().cast("array<int>")
        short = baskets.select(F.array_sort(found).alias("items"))
    else:
        if "items" in baskets.columns:
            numbered = checkpoint(baskets.select("items").withColumn("basket", F.monotonically_increasing_id()))
            baskets = numbered.select("basket", F.explode("items").alias("item"))
        # After the join a basket holds frequent items only, so its set is short whatever the basket's size was.
        short = baskets.join(items, "item").groupBy("basket").agg(F.array_sort(F.collect_set("pos")).alias("items")).select("items")
    return _Short(checkpoint(short.where(F.size("items") > 1)), items, width, total)


def _pairs(short: _Short) -> DataFrame:
    """(i, j, n): baskets that hold both items, i < j."""
    if short.width > TILE:
        first = short.baskets.select("items", F.posexplode("items").alias("at", "i"))
        both = first.select("i", F.explode(F.slice("items", F.col("at") + 2, F.size("items"))).alias("j"))
        return both.groupBy("i", "j").agg(F.count("*").alias("n"))
    width = short.width

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for batch in batches:
            for m in _matrices(batch["items"], width):
                total += m.T @ m
        i, j = np.nonzero(np.triu(total, 1))
        yield pd.DataFrame({"i": i, "j": j, "n": total[i, j].astype("int64")})

    return short.baskets.mapInPandas(count, "i int, j int, n bigint").groupBy("i", "j").agg(F.sum("n").alias("n"))


def _triples(short: _Short, pairs: DataFrame, least: Column, most_sent: int) -> DataFrame:
    """(i, j, k, n) of the frequent triples. Candidates are a self-join of the frequent pairs.

    Up to `most_sent` of them are sent to the tasks and counted there; more are counted from the baskets' own triples whose
    first two items are a frequent pair.
    """
    one = pairs.select("i", "j")
    two, three = one.select("i", F.col("j").alias("k")), one.select(F.col("i").alias("j"), F.col("j").alias("k"))
    candidates = checkpoint(one.join(two, "i").where("j < k").join(three, ["j", "k"]).select("i", "j", "k"))
    n = candidates.count() if short.width <= TILE else most_sent + 1
    if n > most_sent:
        first = short.baskets.where(F.size("items") > 2).select("items", F.posexplode("items").alias("at", "i"))
        rest = first.select("i", F.slice("items", F.col("at") + 2, F.size("items")).alias("items"))
        second = rest.select("i", "items", F.posexplode("items").alias("at", "j")).join(one, ["i", "j"])
        each = second.select("i", "j", F.explode(F.slice("items", F.col("at") + 2, F.size("items"))).alias("k"))
        return each.groupBy("i", "j", "k").agg(F.count("*").alias("n")).where(least)
    width = short.width
    table = candidates.orderBy("i", "j", "k").toArrow()
    sent = candidates.sparkSession.sparkContext.broadcast(np.array([table[c].to_numpy() for c in "ijk"], dtype=np.int64).reshape(3, -1))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, y, z = sent.value
        total = np.zeros(len(x), dtype=np.int64)
        for batch in batches:
            for m in _matrices(batch["items"], width):
                bits = m.astype(bool)
                step = max(1, CELLS // max(len(bits), 1))
                for s in range(0, len(x), step):
                    e = s + step
                    total[s:e] += (bits[:, x[s:e]] & bits[:, y[s:e]] & bits[:, z[s:e]]).sum(axis=0)
        hit = np.nonzero(total)[0]
        yield pd.DataFrame({"i": x[hit], "j": y[hit], "k": z[hit], "n": total[hit]})

    counted = short.baskets.mapInPandas(count, "i int, j int, k int, n bigint")
    return counted.groupBy("i", "j", "k").agg(F.sum("n").alias("n")).where(least)


def _matrices(items: pd.Series, width: int) -> Iterator[np.ndarray]:
    """0/1 matrices (basket x item) in slices of bounded size."""
    step = max(1, CELLS // max(width, 1))
    for start in range(0, len(items), step):
        part = items.iloc[start : start + step]
        m = np.zeros((len(part), width), dtype=np.float32)
        m[np.repeat(np.arange(len(part)), [len(x) for x in part]), np.concatenate([np.asarray(x, dtype=np.int64) for x in part])] = 1.0
        yield m


def frequent_itemsets(source: DataFrame, min_support: float = 0.15, max_k: int = 3, most_sent: int = MOST_SENT) -> tuple[DataFrame, int]:
    """(items, size, n, support) of every frequent set of one to three items, and the basket count."""
    if max_k not in (2, 3):
        raise ValueError(f"sets of up to 2 or 3 items are counted, got {max_k}")
    short = _short_baskets(source, min_support)
    least = F.col("n") / F.lit(max(short.total, 1)) >= min_support
    pairs = checkpoint(_pairs(short).where(least))
    sets = [short.items.select(F.array("pos").alias("at"), "n"), pairs.select(F.array("i", "j").alias("at"), "n")]
    if max_k == 3:
        sets.append(_triples(short, pairs, least, most_sent).select(F.array("i", "j", "k").alias("at"), "n"))
    every = checkpoint(reduce(DataFrame.unionByName, sets).select("n", F.size("at").alias("size"), *[F.get("at", F.lit(i)).alias(f"p{i}") for i in range(max_k)]))
    # Positions back to names, one join for each place.
    for i in range(max_k):
        every = every.join(short.items.select(F.col("pos").alias(f"p{i}"), F.col("item").alias(f"i{i}")), f"p{i}", "left")
    names = F.array_compact(F.array(*[F.col(f"i{i}") for i in range(max_k)]))
    return every.select(names.alias("items"), "size", "n", (F.col("n") / F.lit(short.total)).alias("support")), short.total


def rules_from_itemsets(itemsets: DataFrame, min_confidence: float = 0.5, limit: int | None = 40) -> DataFrame:
    """Every antecedent => consequent split of every frequent set, strongest lift first."""
    parts = itemsets.where("size >= 2").select("items", "support", "size", F.explode(_splits()).alias("mask"))
    side = lambda bit: F.expr(f"filter(items, (x, i) -> (shiftright(mask, i) & 1) = {bit})")
    split = parts.select("support", side(1).alias("ant"), side(0).alias("con"))
    known = itemsets.select("items", F.col("support").alias("part_support"))
    left = known.select(F.col("items").alias("ant"), F.col("part_support").alias("ant_support"))
    right = known.select(F.col("items").alias("con"), F.col("part_support").alias("con_support"))
    rules = split.join(left, "ant").join(right, "con").select(
        F.array_join("ant", ", ").alias("antecedent"),
        F.array_join("con", ", ").alias("consequent"),
        "support",
        (F.col("support") / F.col("ant_support")).alias("confidence"),
        (F.col("support") / F.col("ant_support") / F.col("con_support")).alias("lift"),
    )
    rules = rules.where(F.col("confidence") >= min_confidence)
    order = [F.desc("lift"), F.desc("confidence"), F.desc("support"), "antecedent", "consequent"]
    return rules.orderBy(*order).limit(limit) if limit else rules


def _splits():
    """Bit masks that choose the antecedent of a set of two or three items."""
    return F.when(F.col("size") == 2, F.sequence(F.lit(1), F.lit(2))).otherwise(F.sequence(F.lit(1), F.lit(6)))


def mine_rules(
    source: DataFrame, min_support: float = 0.15, min_confidence: float = 0.5, max_k: int = 3, limit: int | None = 40
) -> DataFrame:
    """Association rules of (basket, item) pairs or ``items`` rows; refuses fewer than eight baskets."""
    itemsets, total = frequent_itemsets(source, min_support, max_k)
    if total < MIN_BASKETS:
        raise ValueError(f"too few baskets: {total}, need {MIN_BASKETS}")
    return rules_from_itemsets(itemsets, min_confidence, limit)


def association_of_highs(
    df: DataFrame,
    texts: Sequence[str],
    numbers: Sequence[str],
    min_support: float = 0.05,
    min_confidence: float = 0.55,
) -> DataFrame:
    """Pair rules among category values and values at or above the column's 90th percentile.

    Baskets need two items, the table twenty baskets. One row per direction.
    """
    schema = "antecedent string, consequent string, support double, confidence double, max_confidence double, suspicious boolean"
    cuts = exact_quantiles(df, {n: number(df, n) for n in numbers}, [0.9])
    tags = [F.when(F.col(quoted(n)).isNotNull(), F.concat(F.lit(f"{n}="), F.col(quoted(n)).cast("string"))) for n in texts]
    tags += [F.when(number(df, n) >= cuts[n][0], F.lit(f"{n}=HIGH")) for n in numbers if cuts[n][0] is not None]
    if len(tags) < 2:
        return df.sparkSession.createDataFrame([], schema)
    rows = checkpoint(df.select(F.array_compact(F.array(*tags)).alias("items")).where(F.size("items") >= 2))
    # Items of a frequent pair are frequent themselves, so no other is counted with others.
    found, total = frequent_itemsets(rows, min_support, 2)
    if total < 20:
        return df.sparkSession.createDataFrame([], schema)
    found = checkpoint(found)
    single = found.where("size = 1").select(F.col("items")[0].alias("item"), F.col("n").alias("times"))
    pairs = found.where("size = 2").select(F.col("items")[0].alias("a"), F.col("items")[1].alias("b"), "n", "support")
    pairs = pairs.join(single.withColumnsRenamed({"item": "a", "times": "n_a"}), "a").join(single.withColumnsRenamed({"item": "b", "times": "n_b"}), "b")
    sides = pairs.select("a", "b", "support", (F.col("n") / F.col("n_a")).alias("ab"), (F.col("n") / F.col("n_b")).alias("ba"))
    strong = F.greatest("ab", "ba")
    kept = sides.where(strong >= min_confidence)
    directions = F.array(
        F.struct(F.col("a").alias("antecedent"), F.col("b").alias("consequent"), F.col("ab").alias("confidence")),
        F.struct(F.col("b").alias("antecedent"), F.col("a").alias("consequent"), F.col("ba").alias("confidence")),
    )
    odd = (F.col("a").contains("HIGH") | F.col("b").contains("HIGH")) & (strong >= 0.7)
    flat = kept.select("support", strong.alias("max_confidence"), odd.alias("suspicious"), F.explode(directions).alias("d"))
    return flat.select("d.antecedent", "d.consequent", "support", "d.confidence", "max_confidence", "suspicious")
