"""DBSCAN on a grid, exact, without comparing all pairs.

Cells are so narrow that two points of one cell are always within eps. A cell with enough points is therefore
all core and needs no distances. Only points of thin cells (fewer than ``min_points``) are compared, against
the few cells around them, so the work grows linearly even when one cell holds most rows. Equal points are
merged first and carry a weight. With many columns the cells around a point are found by their first coordinates
alone, as all combinations of steps would be too many; the distance then decides as before.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.cast import number
from millrace.functions.names import numeric_columns
from millrace.session import checkpoint

MAX_OFFSETS = 700  # combinations of cell steps that are listed
MAX_LEVELS = 60


def standardised(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct complete points, scaled to mean 0 and population deviation 1, with their weight ``m``."""
    data = df.select(*[number(df, n).alias(f"x{i}") for i, n in enumerate(columns)]).na.drop()
    aggs = []
    for i in range(len(columns)):
        aggs += [F.avg(f"x{i}").alias(f"m{i}"), F.stddev_pop(f"x{i}").alias(f"s{i}")]
    row = data.agg(*aggs).first()
    merged = data.groupBy(*data.columns).agg(F.count("*").alias("m"))
    z = [(F.col(f"x{i}") - F.lit(row[f"m{i}"])) / F.lit(row[f"s{i}"] or 1.0) for i in range(len(columns))]
    return merged.select(F.array(*z).alias("z"), "m")


def _sum_squares(parts: Sequence[Column]) -> Column:
    # Written out by coordinate, as functions over arrays are not compiled.
    total = F.lit(0.0)
    for part in parts:
        total = total + part * part
    return total


def _distance2(a: str, b: str, dims: int) -> Column:
    return _sum_squares([F.col(a)[i] - F.col(b)[i] for i in range(dims)])


def _gap2(dims: int) -> Column:
    """Squared distance of the boxes (lo, hi) and (r_lo, r_hi)."""
    at = lambda n, i: F.col(n)[i]
    return _sum_squares([F.greatest(at("lo", i) - at("r_hi", i), at("r_lo", i) - at("hi", i), F.lit(0.0)) for i in range(dims)])


def _offsets(dims: int) -> list[tuple[int, ...]]:
    """Steps of the first cell coordinates, as many as can be listed, whose boxes can hold a point within eps."""
    reach = math.ceil(math.sqrt(dims))
    listed = max(1, min(dims, int(math.log(MAX_OFFSETS, 2 * reach + 1))))
    out = []
    for step in itertools.product(range(-reach, reach + 1), repeat=listed):
        gap = sum(max(abs(s) - 1, 0) ** 2 for s in step)
        if gap <= dims + 1e-9:
            out.append(step)
    return out


def _head(cell: str | Column, offsets: list[tuple[int, ...]]) -> Column:
    """The coordinates that the steps cover."""
    return F.slice(cell, 1, len(offsets[0]))


def _around(cell: Column, offsets: list[tuple[int, ...]]) -> Column:
    steps = F.array(*[F.array(*[F.lit(s).cast("long") for s in step]) for step in offsets])
    return F.explode(F.transform(steps, lambda s: F.zip_with(_head(cell, offsets), s, lambda a, b: a + b)))


def _cells(points: DataFrame, width: float) -> DataFrame:
    return points.withColumn("cell", F.transform("z", lambda v: F.floor(v / width)))


def dbscan_points(
    df: DataFrame, columns: Sequence[str] | None = None, eps: float = 0.8, min_points: int = 5
) -> DataFrame:
    """Distinct points as (z, m, cell, dense, core, noise); ``m`` counts the equal rows."""
    columns = list(columns or numeric_columns(df))
    dims = len(columns)
    if not dims:
        raise ValueError("no numeric columns")
    points = _cells(standardised(df, columns), eps / math.sqrt(dims))
    weights = points.groupBy("cell").agg(F.sum("m").alias("cell_rows"))
    points = checkpoint(points.join(weights, "cell").withColumn("dense", F.col("cell_rows") >= min_points))

    offsets, limit = _offsets(dims), eps * eps
    thin = points.where(~F.col("dense")).select("z", "m", "cell")
    reach = thin.select(F.col("z").alias("tz"), _around(F.col("cell"), offsets).alias("head"))
    near = points.select(_head("cell", offsets).alias("head"), "z", "m", "dense").join(reach, "head").where(_distance2("z", "tz", dims) <= limit)
    counted = near.groupBy("tz").agg(F.sum("m").alias("around"), F.max("dense").alias("by_dense"))
    judged = checkpoint(
        thin.join(counted, thin["z"] == counted["tz"]).select(
            "z", "m", "cell", (F.col("around") >= min_points).alias("core"), "by_dense"
        )
    )
    # A point that is neither core nor next to a dense cell may still touch a core point of a thin cell.
    open_points = judged.where("not core and not by_dense").select(F.col("z").alias("tz"), _around(F.col("cell"), offsets).alias("head"))
    touched = (
        judged.where("core").select("z", _head("cell", offsets).alias("head")).join(open_points, "head")
        .where(_distance2("z", "tz", dims) <= limit).select("tz").distinct()
    )
    rest = judged.join(touched, judged["z"] == touched["tz"], "left").select(
        "z", "m", "cell", F.lit(False).alias("dense"), "core",
        (~F.col("core") & ~F.col("by_dense") & F.col("tz").isNull()).alias("noise"),
    )
    dense = points.where("dense").select(
        "z", "m", "cell", "dense", F.lit(True).alias("core"), F.lit(False).alias("noise")
    )
    return checkpoint(dense.unionByName(rest))


def _labelled(points: DataFrame, labels: DataFrame) -> DataFrame:
    return points.join(labels, points["cell"] == labels["node"]).drop("node")


def _thin_links(points: DataFrame, labels: DataFrame, offsets, limit: float, dims: int) -> DataFrame:
    """Links from core points of thin cells to core cells around them that have another label."""
    core = _labelled(points.where("core"), labels).select("cell", _head("cell", offsets).alias("head"), "z", "dense", "label", "main")
    found = None
    # One of the two is outside of the main component.
    for thin, others in (("not main", "true"), ("main", "not main")):
        reach = core.where("not dense").where(thin).select(
            F.col("cell").alias("a"), F.col("z").alias("tz"), F.col("label").alias("a_label"), _around(F.col("cell"), offsets).alias("head")
        )
        near = core.where(others).join(reach, "head").where((F.col("a_label") != F.col("label")) & (_distance2("z", "tz", dims) <= limit))
        part = near.select("a", F.col("cell").alias("b")).distinct()
        found = part if found is None else found.unionByName(part)
    return found


def _boxes(dense: DataFrame, width: float, level: int, dims: int) -> DataFrame:
    """Bounding box and one real point for every sub-cell of the given level."""
    fine = width / 2**level
    keyed = dense.select("cell", "z", F.transform("z", lambda v: F.floor(v / fine)).alias("sub"))
    aggs = [F.min("z").alias("rep")]
    for d in range(dims):
        aggs += [F.min(F.col("z")[d]).alias(f"lo{d}"), F.max(F.col("z")[d]).alias(f"hi{d}")]
    grouped = keyed.groupBy("cell", "sub").agg(*aggs)
    return grouped.select(
        "cell", "sub", "rep",
        F.array(*[F.col(f"lo{d}") for d in range(dims)]).alias("lo"),
        F.array(*[F.col(f"hi{d}") for d in range(dims)]).alias("hi"),
        F.transform("sub", lambda v: F.floor(v / 2)).alias("parent"),
    )


def _main(labels: DataFrame) -> DataFrame:
    """(node, label, main): whether the label is that of the most nodes."""
    most = labels.groupBy("label").agg(F.count("*").alias("n")).agg(F.max_by("label", F.struct("n", "label")).alias("most"))
    return checkpoint(labels.crossJoin(F.broadcast(most)).select("node", "label", (F.col("label") == F.col("most")).alias("main")))


def _merged(labels: DataFrame, found: DataFrame) -> DataFrame:
    """Labels after the components of linked nodes become one."""
    names = labels.select("node", "label")
    ends = found.join(names.toDF("a", "a_label"), "a").join(names.toDF("b", "b_label"), "b")
    parts = components(names.select(F.col("label").alias("node")).distinct(), ends.select(F.col("a_label").alias("a"), F.col("b_label").alias("b")).distinct())
    return _main(names.join(parts.toDF("label", "whole"), "label").select("node", F.col("whole").alias("label")))


def cell_labels(points: DataFrame, offsets, eps: float, width: float, dims: int) -> DataFrame:
    """(node, label, main): the component of every core cell.

    One point of each cell links most cells with those next to them. What is left are pairs of cells of different components:
    points of thin cells are compared, and boxes decide pairs of dense cells; the open ones are split into smaller boxes.
    """
    limit, core = eps * eps, points.where("core")
    dense = points.where("dense").select("cell", "z")
    boxes = checkpoint(_boxes(dense, width, 0, dims))
    one = checkpoint(boxes.select("cell", "rep").unionByName(core.where("not dense").groupBy("cell").agg(F.min("z").alias("rep"))))
    beside = [o for o in offsets if max(map(abs, o)) <= 1]
    left = one.select(F.col("cell").alias("a"), F.col("rep").alias("a_rep"), _around(F.col("cell"), beside).alias("head"))
    right = one.select(F.col("cell").alias("b"), F.col("rep").alias("b_rep"), _head("cell", beside).alias("head"))
    links = left.join(right, "head").where((F.col("a") < F.col("b")) & (_distance2("a_rep", "b_rep", dims) <= limit))
    labels = _main(components(one.select(F.col("cell").alias("node")), links.select("a", "b").distinct()))

    known = _labelled(boxes, labels)
    left = known.where("not main").select(F.col("cell").alias("a"), "sub", "rep", "lo", "hi", F.col("label").alias("a_label"), _around(F.col("cell"), offsets).alias("head"))
    right = known.select(F.col("cell").alias("b"), "label", "main", _head("cell", offsets).alias("head"), *[F.col(n).alias("r_" + n) for n in ("sub", "rep", "lo", "hi")])
    pairs = left.join(right, "head").where((F.col("a_label") != F.col("label")) & (F.col("main") | (F.col("a") < F.col("b"))))
    thin = _thin_links(points, labels, offsets, limit, dims)
    for level in range(1, MAX_LEVELS):
        judged = checkpoint(
            pairs.where(_gap2(dims) <= limit).select("a", "b", "sub", "r_sub", (_distance2("rep", "r_rep", dims) <= limit).alias("linked"))
        )
        found = judged.where("linked").select("a", "b").distinct()
        found = checkpoint(found.unionByName(thin) if level == 1 else found)
        if not found.isEmpty():
            labels = _merged(labels, found)
        names = labels.select("node", "label")
        open_pairs = checkpoint(
            judged.where("not linked").join(names.toDF("a", "a_label"), "a").join(names.toDF("b", "b_label"), "b")
            .where("a_label != b_label").select("a", "b", "sub", "r_sub")
        )
        if open_pairs.isEmpty():
            break
        cells = open_pairs.select(F.explode(F.array("a", "b")).alias("cell")).distinct()
        boxes = _boxes(dense.join(cells, "cell", "left_semi"), width, level, dims)
        left = boxes.select(F.col("cell").alias("a"), F.col("parent").alias("sub"), F.col("sub").alias("n_sub"), "rep", "lo", "hi")
        right = boxes.select(
            F.col("cell").alias("b"), F.col("parent").alias("r_sub"), F.col("sub").alias("n_r_sub"),
            F.col("rep").alias("r_rep"), F.col("lo").alias("r_lo"), F.col("hi").alias("r_hi"),
        )
        pairs = open_pairs.join(left, ["a", "sub"]).join(right, ["b", "r_sub"]).select(
            "a", "b", F.col("n_sub").alias("sub"), F.col("n_r_sub").alias("r_sub"), "rep", "lo", "hi", "r_rep", "r_lo", "r_hi"
        )
    return labels


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label): smallest reachable node, by label passing with pointer jumping."""
    both = checkpoint(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    )
    labels = checkpoint(nodes.select("node", F.col("node").alias("label")))
    while True:
        passed = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("offer"))
        better = labels.join(passed, labels["node"] == passed["a"], "left").select(
            "node", F.col("label").alias("old"), F.least("label", F.coalesce("offer", "label")).alias("label")
        )
        hop = labels.select(F.col("node").alias("via"), F.col("label").alias("hop"))
        jumped = better.join(hop, better["label"] == hop["via"], "left").select(
            "node", "old", F.least("label", F.coalesce("hop", "label")).alias("label")
        )
        jumped = checkpoint(jumped)
        labels = jumped.select("node", "label")
        if jumped.where(F.col("old") != F.col("label")).isEmpty():
            return labels


def dbscan_summary(
    df: DataFrame, columns: Sequence[str] | None = None, eps: float = 0.8, min_points: int = 5
) -> DataFrame:
    """Rows, noise rows and cluster count."""
    columns = list(columns or numeric_columns(df))
    dims = len(columns)
    points = dbscan_points(df, columns, eps, min_points)
    width, offsets = eps / math.sqrt(dims), _offsets(dims)
    clusters = cell_labels(points, offsets, eps, width, dims).agg(F.count_distinct("label").alias("clusters")).first()["clusters"]
    return points.agg(
        F.coalesce(F.sum("m"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(F.col("noise"), F.col("m")).otherwise(0)), F.lit(0)).alias("noise_points"),
        F.lit(clusters).cast("long").alias("clusters"),
    )
