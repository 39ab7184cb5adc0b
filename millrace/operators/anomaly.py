"""Isolation forest: trees grow in parallel on small samples, every row is scored where it lies."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.cast import number
from millrace.functions.names import numeric_columns, quoted
from millrace.operators.quantiles import exact_quantiles
from millrace.operators.trees import mixed, salts
from millrace.session import checkpoint

TREES = 100
SAMPLE = 256
TREE_SCHEMA = "tree int, node int, feature int, cut double, path double"


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a random binary tree of n points."""
    if n <= 1:
        return 0.0
    if n <= 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def grow(points: np.ndarray, depth_limit: int, seed: int) -> list[tuple]:
    """One tree as (node, feature, cut, path) rows; children of node i are 2i+1 and 2i+2."""
    rng = np.random.default_rng(seed)
    nodes, todo = [], [(0, 0, points)]
    while todo:
        node, depth, part = todo.pop()
        open_features = np.nonzero(part.max(axis=0) > part.min(axis=0))[0] if len(part) else []
        if depth >= depth_limit or len(part) <= 1 or not len(open_features):
            nodes.append((node, -1, 0.0, depth + average_path(len(part))))
            continue
        feature = int(rng.choice(open_features))
        column = part[:, feature]
        cut = float(rng.uniform(column.min(), column.max()))
        nodes.append((node, feature, cut, 0.0))
        todo.append((2 * node + 1, depth + 1, part[column <= cut]))
        todo.append((2 * node + 2, depth + 1, part[column > cut]))
    return nodes


@functools.lru_cache(16)
def _average_paths(most: int) -> np.ndarray:
    return np.array([average_path(n) for n in range(most + 1)])


def forest_here(points: np.ndarray, trees: int = TREES, size: int = SAMPLE, seed: int = 42) -> Forest:
    """A forest over rows at hand, its trees grown side by side, level by level; column and cut of a node follow a hash of tree and node."""
    n = len(points)
    size = min(size, n)
    depth = math.ceil(math.log2(size))
    row = np.arange(n) if size == n else None
    row = np.concatenate([np.random.default_rng(seed + t).choice(n, size, replace=False) if row is None else row for t in range(trees)])
    forest = Forest([], trees, size, depth)
    salt, paths = [salts([2 * (seed * 1_000_003 + t) + k for t in range(trees)]) for k in (0, 1)], _average_paths(size)
    tree, node = np.arange(trees), np.zeros(trees, np.int64)  # of the nodes of a level
    slot = np.repeat(np.arange(trees), size)
    for level in range(depth + 1):
        starts = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
        tree, node, slot = tree[slot[starts]], node[slot[starts]], np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(slot))))
        part = points[row]
        low, high = np.minimum.reduceat(part, starts), np.maximum.reduceat(part, starts)
        spread = high > low
        some = spread.any(1) & (level < depth)
        forest.path[tree, node] = np.where(some, 0.0, level + paths[np.diff(np.append(starts, len(slot)))])
        if not some.any():
            break
        u, v = ((mixed(node, s[tree]) >> np.uint64(11)).astype(float) / 2.0**53 for s in salt)
        feature = np.argmax(np.cumsum(spread, 1) > np.floor(u * spread.sum(1))[:, None], 1)
        each = np.arange(len(tree))
        cut = low[each, feature] + v * (high - low)[each, feature]
        forest.feature[tree[some], node[some]], forest.cut[tree[some], node[some]] = feature[some], cut[some]
        right = part[np.arange(len(row)), feature[slot]] > cut[slot]
        going = np.flatnonzero(some[slot])
        order = going[np.argsort(2 * slot[going] + right[going], kind="stable")]
        slot, row = 2 * slot[order] + right[order], row[order]
        tree, node = np.repeat(tree, 2), (2 * node[:, None] + [1, 2]).ravel()
        # Children that get no row of the sample.
        forest.path[tree[np.repeat(some, 2)], node[np.repeat(some, 2)]] = level + 1
    return forest


def _samples(data: DataFrame, rows: int, trees: int, size: int, seed: int) -> DataFrame:
    """At most ``size`` rows per tree, drawn from the whole table by the hash ``_u`` of each row.

    A row offers itself to a tree of its own choice, several times when the table has fewer rows than the trees need, so
    the draw follows the rows alone and not how they are spread over tasks. Twice the rows needed offer themselves.
    """
    turns = max(1, math.ceil(2.0 * trees * size / max(rows, 1)))
    share = min(1.0, 2.0 * trees * size / max(rows * turns, 1))
    offer = F.transform(
        F.sequence(F.lit(0), F.lit(turns - 1)),
        lambda t: F.when(F.pmod(F.xxhash64("_u", t, F.lit(seed)), F.lit(1 << 40)) < F.lit(int(share * (1 << 40))), F.pmod(F.xxhash64("_u", t, F.lit(seed + 1)), F.lit(trees))),
    )
    spread = data.withColumn("tree", F.explode(F.array_distinct(F.array_compact(offer)).cast("array<int>")))
    order = Window.partitionBy("tree").orderBy(F.xxhash64("_u", "tree", F.lit(seed)), *[c for c in data.columns if c != "_u"])
    return spread.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= size).drop("_r", "_u")


class Forest:
    """Trees as arrays indexed by (tree, node)."""

    def __init__(self, rows, trees: int, size: int, depth: int):
        nodes = 2 ** (depth + 1) - 1
        self.feature = np.full((trees, nodes), -1, dtype=np.int32)
        self.cut = np.zeros((trees, nodes))
        self.path = np.zeros((trees, nodes))
        for r in rows:
            self.feature[r["tree"], r["node"]] = r["feature"]
            self.cut[r["tree"], r["node"]] = r["cut"]
            self.path[r["tree"], r["node"]] = r["path"]
        self.depth, self.scale = depth, average_path(size)

    def scores(self, points: np.ndarray) -> np.ndarray:
        total, rows = np.zeros(len(points)), np.arange(len(points))
        # For few rows many trees are walked together; their paths are added in one order either way.
        beside = max(1, 20_000 // max(len(points), 1))
        for first in range(0, len(self.feature), beside):
            feature, cut, path = (a[first : first + beside] for a in (self.feature, self.cut, self.path))
            tree = np.arange(len(feature))[:, None]
            at = np.zeros((len(feature), len(points)), dtype=np.int64)
            for _ in range(self.depth):
                f = feature[tree, at]
                step = 2 * at + 1 + (points[rows, np.maximum(f, 0)] > cut[tree, at])
                at = np.where(f >= 0, step, at)
            for found in path[tree, at]:
                total += found
        return 2.0 ** (-total / len(self.feature) / max(self.scale, 1e-12))


def fit_forest(df: DataFrame, columns: Sequence[str], trees: int = TREES, size: int = SAMPLE, seed: int = 42) -> Forest:
    # All columns make the hash of a row, so equal points of different rows are drawn apart.
    whole = F.xxhash64(*[F.col(quoted(f.name)) for f in df.schema.fields if "map" not in f.dataType.simpleString()])
    data = df.select(*[number(df, n).alias(f"x{i}") for i, n in enumerate(columns)], whole.alias("_u")).na.drop()
    rows = data.count()
    size = max(2, min(size, rows))
    depth = math.ceil(math.log2(size))
    names = [f"x{i}" for i in range(len(columns))]

    def one_tree(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        nodes = grow(group[names].to_numpy(float), depth, seed + int(key[0]))
        out = pd.DataFrame(nodes, columns=["node", "feature", "cut", "path"])
        out.insert(0, "tree", int(key[0]))
        return out

    grown = _samples(data, rows, trees, size, seed).groupBy("tree").applyInPandas(one_tree, TREE_SCHEMA)
    # At most trees * (2 * size - 1) nodes.
    return Forest(grown.collect(), trees, size, depth)


def anomaly_score(forest: Forest, columns: Sequence[Column]) -> Column:
    @F.pandas_udf("double")
    def score(frame: pd.DataFrame) -> pd.Series:
        points = frame.to_numpy(float)
        full = ~np.isnan(points).any(axis=1)
        out = np.full(len(points), np.nan)
        if full.any():
            out[full] = forest.scores(points[full])
        return pd.Series(out).where(full, None)

    return score(F.struct(*[c.alias(f"x{i}") for i, c in enumerate(columns)]))


def _scored(df: DataFrame, columns: Sequence[str], contamination: float, seed: int):
    """The table with scores, the scores alone as a written table, and the score above which a row is anomalous."""
    forest = fit_forest(df, columns, seed=seed)
    scored = df.withColumn("anomaly_score", anomaly_score(forest, [number(df, n) for n in columns]))
    # The cut takes several passes; they read eight bytes per row instead of scoring again.
    scores = checkpoint(scored.select("anomaly_score"))
    cut = exact_quantiles(scores, {"s": F.col("anomaly_score")}, [1.0 - contamination])["s"][0]
    return scored, scores, F.lit(cut).cast("double")


def score_rows(df: DataFrame, columns: Sequence[str] | None = None, contamination: float = 0.08, seed: int = 42):
    """Every row with ``anomaly_score`` and ``anomaly`` (incomplete rows get neither).

    Rows above the (1 - contamination) quantile of the scores are anomalies.
    """
    scored, _, cut = _scored(df, list(columns or numeric_columns(df)), contamination, seed)
    return scored.withColumn("anomaly", F.col("anomaly_score") > cut)


def anomaly_summary(df: DataFrame, columns: Sequence[str] | None = None, contamination: float = 0.08) -> DataFrame:
    _, scores, cut = _scored(df, list(columns or numeric_columns(df)), contamination, 42)
    anomalies = F.count_if(F.col("anomaly_score") > cut)
    known = F.count("anomaly_score")
    return scores.agg(known.alias("rows"), anomalies.alias("anomalies"), F.try_divide(anomalies, known).alias("rate"))
