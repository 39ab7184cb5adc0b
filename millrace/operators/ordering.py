"""Order-sensitive work over tables that have no small partition key.

A table is dealt out by ranges of its full sort key and written in that order, each row with the number of its range and
its place there. A scan over the sizes of the ranges gives the position of every row. A trailing frame needs the last rows
before its range too: ranges hand their tails on to the ranges behind. The number of ranges follows that of the rows;
neither cut points nor sizes go through the driver. With a unique sort key, a value or an entity that holds a third of the
rows is spread over many ranges.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.names import quoted
from millrace.session import checkpoint

ROWS_PER_RANGE = 250_000
# Ranges whose sizes are summed in one task; more are summed in blocks, and then the blocks.
RANGES_PER_BLOCK = 4096
# Ranges that are a task each; more are cut out of as many tasks, or of tasks of ROWS_PER_RANGE rows.
MOST_TASKS = 400
# A row's id is the number of its partition, shifted, plus its place there.
_PLACE_BITS = 33
_RANGE, _PLACE, _NUMBER, _SIZE, _START, _AT, _OWN = (f"__{n}" for n in ("range", "place", "number", "size", "start", "at", "own"))


def _ascending(names: Sequence[str]) -> list[Column]:
    return [F.col(quoted(n)).asc_nulls_first() for n in names]


@dataclass
class Ranges:
    """A written table of (range, place) beside the rows, and (range, number, size, start) of the ranges that have rows.

    Numbers count the ranges with rows from 0 along the sort key; start is the number of rows before.
    """

    rows: DataFrame
    sizes: DataFrame

    def placed(self) -> DataFrame:
        """All rows with the number, size and start of their range, and their position."""
        return self.rows.join(self.sizes, _RANGE).withColumn(_AT, F.col(_START) + F.col(_PLACE))


def _scanned(sizes: DataFrame, ranges: int) -> DataFrame:
    """Running number and sum of the rows before, over (range, size)."""
    before = Window.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    sums = lambda w, n, size: (F.coalesce(F.sum(n).over(w), F.lit(0)), F.coalesce(F.sum(size).over(w), F.lit(0)))
    if ranges <= RANGES_PER_BLOCK:
        number, start = sums(before, F.lit(1), _SIZE)
        return sizes.select(_RANGE, number.alias(_NUMBER), _SIZE, start.alias(_START))
    sizes = sizes.withColumn("block", F.floor(F.col(_RANGE) / RANGES_PER_BLOCK))
    number, start = sums(Window.partitionBy("block").orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1), F.lit(1), _SIZE)
    blocks = sizes.groupBy("block").agg(F.count("*").alias("n"), F.sum(_SIZE).alias("s"))
    n, s = sums(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1), F.col("n"), F.col("s"))
    blocks = blocks.select("block", n.alias("n"), s.alias("s"))
    inner = sizes.select("block", _RANGE, _SIZE, number.alias(_NUMBER), start.alias(_START))
    return inner.join(blocks, "block").select(_RANGE, (F.col(_NUMBER) + F.col("n")).alias(_NUMBER), _SIZE, (F.col(_START) + F.col("s")).alias(_START))


def ranged(df: DataFrame, order_by: Sequence[str], ranges: int, rows_per_range: int | None = None) -> Ranges:
    """Deal `df` out by ranges of `order_by` (missing values first) and write it in that order."""
    # Every task reports to the driver, so their number must not follow that of small ranges.
    each = rows_per_range or ROWS_PER_RANGE
    tasks = min(ranges, max(MOST_TASKS, math.ceil(ranges * each / ROWS_PER_RANGE)))
    # Columns are written under plain names, those without a type not at all.
    plain = [f"c{i}" for i in range(len(df.columns))]
    untyped = {p for p, f in zip(plain, df.schema.fields) if isinstance(f.dataType, T.NullType)}
    place = {name: p for name, p in zip(df.columns, plain)}
    keys = _ascending([place[n] for n in order_by if place[n] not in untyped])
    kept = df.toDF(*plain).select(*[p for p in plain if p not in untyped])
    dealt = kept.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys) if keys else kept
    written = checkpoint(dealt.withColumn("id", F.monotonically_increasing_id()))
    columns = [F.lit(None).alias(n) if p in untyped else F.col(p).alias(n) for p, n in zip(plain, df.columns)]
    task, place = F.shiftright("id", _PLACE_BITS), F.col("id").bitwiseAND((1 << _PLACE_BITS) - 1)
    if tasks < ranges and keys:
        inner = F.floor(place / each)
        rows = written.select(*columns, (F.shiftleft(task, _PLACE_BITS) + inner).alias(_RANGE), (place - inner * each).alias(_PLACE))
    else:
        rows = written.select(*columns, task.alias(_RANGE), place.alias(_PLACE))
    sizes = rows.groupBy(_RANGE).agg(F.count("*").alias(_SIZE))
    return Ranges(rows, checkpoint(_scanned(sizes, ranges)))


def range_count(rows: int, rows_per_range: int | None) -> int:
    return max(1, math.ceil(rows / (rows_per_range or ROWS_PER_RANGE)))


def row_index(
    df: DataFrame, order_by: Sequence[str], name: str = "row_index", rows_per_range: int | None = None
) -> DataFrame:
    """Dense 0-based position of every row along ``order_by`` (which should end in a unique column)."""
    ranges = range_count(df.count(), rows_per_range)
    if ranges == 1:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*_ascending(order_by))).cast("long") - 1)
    return ranged(df, order_by, ranges, rows_per_range).placed().select(*[F.col(quoted(c)) for c in df.columns], F.col(_AT).alias(name))


def trailing(
    df: DataFrame,
    columns: Mapping[str, Callable[[WindowSpec], Column]],
    back: int,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    rows_per_range: int | None = None,
) -> DataFrame:
    """Add columns that look at the current row and up to ``back`` rows before it.

    ``columns`` maps a new name to a function of the window (ordered, without a frame).
    """
    partition_by, order_by = list(partition_by), list(order_by)
    groups = [quoted(c) for c in partition_by]

    def apply(frame: DataFrame, window: WindowSpec) -> DataFrame:
        return frame.withColumns({name: make(window) for name, make in columns.items()})

    if groups:
        sizes = df.groupBy(*groups).agg(F.count("*").alias("n"))
        if (sizes.agg(F.max("n")).first()[0] or 0) <= 4 * (rows_per_range or ROWS_PER_RANGE):
            return apply(df, Window.partitionBy(*groups).orderBy(*_ascending(order_by)))
    ranges = range_count(df.count(), rows_per_range)
    if ranges == 1:
        return apply(df, Window.partitionBy(F.lit(0), *groups).orderBy(*_ascending(order_by)))

    cut = ranged(df, partition_by + order_by, ranges, rows_per_range)
    placed = cut.placed()
    tails = placed.where(F.col(_PLACE) >= F.col(_SIZE) - back)
    if (cut.sizes.agg(F.min(_SIZE)).first()[0] or 0) >= back:
        tails = tails.withColumn(_NUMBER, F.col(_NUMBER) + 1)
    else:  # a range may need the tails of several short ones
        after = tails.withColumn(_NUMBER, F.explode(F.sequence(F.col(_NUMBER) + 1, F.col(_NUMBER) + back)))
        behind = cut.sizes.select(_NUMBER, F.col(_START).alias("__theirs"))
        tails = after.join(behind, _NUMBER).where(F.col(_AT) >= F.col("__theirs") - back)
    shown = [F.col(quoted(c)) for c in df.columns] + [F.col(_NUMBER), F.col(_AT)]
    both = placed.select(*shown, F.lit(True).alias(_OWN)).unionByName(tails.select(*shown, F.lit(False).alias(_OWN)))
    return apply(both, Window.partitionBy(_NUMBER, *groups).orderBy(_AT)).where(_OWN).drop(_OWN, _NUMBER, _AT)
