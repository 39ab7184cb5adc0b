"""Exact quantiles (linear interpolation) without gathering a column in one task.

Each round brackets every wanted rank with a mergeable sketch and counts the rows below and inside the
bracket. Only a bracket that is proven small is handed to the exact aggregate.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMALL = 200_000
ACCURACY = 10_000


@dataclass
class _Target:
    column: str
    prob: float
    position: float
    low: float
    high: float
    below: int
    inside: int

    @property
    def settled(self) -> bool:
        return self.low == self.high


def exact_quantiles(
    df: DataFrame, columns: Mapping[str, Column], probs: Sequence[float], small: int = SMALL, min_values: int = 1
) -> dict[str, list[float | None]]:
    """``{name: [quantile, ...]}`` of the known values; None below ``min_values`` of them."""
    if not columns:
        return {}
    data = df.select(*[c.cast("double").alias(n) for n, c in columns.items()])
    names = list(columns)
    stats = data.agg(
        *[
            F.struct(F.count(_q(n)).alias("n"), F.min(_q(n)).alias("lo"), F.max(_q(n)).alias("hi")).alias(n)
            for n in names
        ]
    ).first()
    result: dict[str, list[float | None]] = {n: [None] * len(probs) for n in names}
    filled = [n for n in names if stats[n]["n"] >= max(1, min_values)]
    direct = [n for n in filled if stats[n]["n"] <= small]
    if direct:
        row = data.agg(*[F.percentile(_q(n), F.array(*[F.lit(float(p)) for p in probs])).alias(n) for n in direct]).first()
        result.update({n: list(row[n]) for n in direct})
    targets = [
        _Target(n, p, p * (stats[n]["n"] - 1), stats[n]["lo"], stats[n]["hi"], 0, stats[n]["n"])
        for n in filled
        if n not in direct
        for p in probs
    ]
    _narrow(data, targets, small)
    for name in {t.column for t in targets}:
        found = {t.prob: t.low for t in targets if t.column == name}
        result[name] = [found[p] for p in probs]
    return result


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _inside(t: _Target) -> Column:
    x = _q(t.column)
    return F.when(x.between(t.low, t.high), x)


def _narrow(data: DataFrame, targets: list[_Target], small: int) -> None:
    wide = [t for t in targets if not t.settled and t.inside > small]
    while wide:
        margin = 2.0 / ACCURACY
        sketches = []
        for i, t in enumerate(wide):
            at = (t.position - t.below) / t.inside
            ends = [max(0.0, at - margin), min(1.0, at + margin)]
            sketches.append(F.percentile_approx(_inside(t), ends, ACCURACY).alias(f"t{i}"))
        row = data.agg(*sketches).first()
        counts = []
        for i, t in enumerate(wide):
            low, high = row[f"t{i}"]
            counts.append(F.count_if(_q(t.column) < low).alias(f"b{i}"))
            counts.append(F.count_if(_q(t.column).between(low, high)).alias(f"n{i}"))
        sizes = data.agg(*counts).first()
        for i, t in enumerate(wide):
            (low, high), below, inside = row[f"t{i}"], sizes[f"b{i}"], sizes[f"n{i}"]
            covered = below <= t.position and t.position <= below + inside - 1
            if covered and (inside < t.inside or low == high):
                t.low, t.high, t.below, t.inside = low, high, below, inside
            else:
                # The sketch could not split this bracket further: halve it by value instead.
                _halve(data, t)
        wide = [t for t in wide if not t.settled and t.inside > small]
    rest = [t for t in targets if not t.settled]
    if rest:
        exact = [
            F.percentile(_inside(t), (t.position - t.below) / max(t.inside - 1, 1)).alias(f"t{i}")
            for i, t in enumerate(rest)
        ]
        row = data.agg(*exact).first()
        for i, t in enumerate(rest):
            t.low = t.high = row[f"t{i}"]


def _halve(data: DataFrame, t: _Target) -> None:
    """Split one bracket at its middle; both halves start and end on values that occur."""
    x, middle = _q(t.column), t.low + (t.high - t.low) / 2
    row = data.agg(
        F.count_if(x.between(t.low, middle)).alias("left"),
        F.max(F.when(x.between(t.low, middle), x)).alias("left_end"),
        F.min(F.when((x > middle) & (x <= t.high), x)).alias("right_start"),
    ).first()
    offset = t.position - t.below
    if offset <= row["left"] - 1:
        t.high, t.inside = row["left_end"], row["left"]
    elif offset >= row["left"]:
        t.low, t.below, t.inside = row["right_start"], t.below + row["left"], t.inside - row["left"]
    else:
        # The wanted position lies between the two halves.
        share = offset - (row["left"] - 1)
        t.low = t.high = row["left_end"] + share * (row["right_start"] - row["left_end"])
