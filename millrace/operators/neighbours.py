"""Exact k nearest neighbours of many points, by a tree of pivots.

The points of a cell are split among some of their own as pivots, and each part again, until a cell has few points or they are
all the same. Every node keeps the smallest and largest distance of its points to its pivot. A query first meets the points of the
cells whose pivots are nearest on the way down: the k-th distance found there bounds the true one. Then it goes down again and
leaves out every node that the triangle inequality puts beyond the bound, on each level, before the nodes below are looked at.

The tree is sent to all tasks; when it would grow beyond MOST_SENT bytes its last cells stay larger. Cells that stand together
are sent as one chunk, and a query goes once to each chunk that it may visit, whatever the number of its cells there: vectors that
rule nothing out are sent once for CHUNK points. A cell of more points is cut, so one crowded cell is many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import checkpoint

FAN = 32  # pivots of a cell that is split
LEAF = 512  # points of a cell that is not split any more
CHUNK = 32_768  # points, and at most half of the queries, that meet in one task
SLAB = 2048  # queries whose cells are looked up at a time
MOST_SENT = 64_000_000


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T
    return np.sqrt(np.maximum(square, 0.0))


def _closest(a: np.ndarray, b: np.ndarray, take: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, distance) of the `take` nearest rows of b for each row of a, ties to the smaller row of b.

    Products rule out what is surely farther; the rest is measured by differences, free of cancellation.
    """
    middle = b.mean(0)  # products lose less near the origin
    near = b - middle
    sb = (near * near).sum(1)
    out, slab = [], max(16, min(1024, 4_000_000 // len(b)))
    for s in range(0, len(a), slab):
        part = a[s : s + slab] - middle
        sa = (part * part).sum(1)
        square = sa[:, None] + sb[None, :] - 2.0 * part @ near.T
        slack = 1e-10 * (sa + sb.max())
        limit = np.partition(square, take - 1, axis=1)[:, take - 1] + slack
        rows, columns = np.nonzero(square <= limit[:, None])
        d, step = np.empty(len(rows)), max(1, 4_000_000 // a.shape[1])
        for i in range(0, len(rows), step):
            gap = a[s + rows[i : i + step]] - b[columns[i : i + step]]
            d[i : i + step] = np.sqrt((gap * gap).sum(1))
        order = np.lexsort((columns, d, rows))
        rows, columns, d = rows[order], columns[order], d[order]
        kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < take
        out.append((rows[kept] + s, columns[kept], d[kept]))
    return tuple(np.concatenate(x) for x in zip(*out))


@dataclass
class PivotTree:
    """Nodes by number, 0 being the root; a node's children stand one after another."""

    pivot: list[np.ndarray] = field(default_factory=list)
    low: list[float] = field(default_factory=lambda: [0.0])
    high: list[float] = field(default_factory=lambda: [math.inf])
    rows: list[int] = field(default_factory=lambda: [0])
    first: list[int] = field(default_factory=lambda: [0])
    children: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, pivots: np.ndarray) -> None:
        self.first[node], self.children[node] = len(self.first), len(pivots)
        for p in pivots:
            self.pivot.append(p)
            for column, value in ((self.low, 0.0), (self.high, 0.0), (self.rows, 0), (self.first, 0), (self.children, 0)):
                column.append(value)

    def below(self, node: int) -> np.ndarray:
        return np.arange(self.first[node], self.first[node] + self.children[node])

    def at(self, nodes: np.ndarray) -> np.ndarray:
        """Pivots of nodes other than the root."""
        return np.stack([self.pivot[i - 1] for i in nodes.tolist()])

    def leaves(self, node: int) -> np.ndarray:
        """The cells under a node."""
        out, todo = [], [node]
        while todo:
            n = todo.pop()
            todo += self.below(n).tolist()
            if not self.children[n]:
                out.append(n)
        return np.array(sorted(out))

    def nearest(self, v: np.ndarray, least: int) -> list[np.ndarray]:
        """For each vector the cells with the nearest pivots that hold at least `least` points together.

        A vector follows the nearest pivots down to the last node of so many points, and takes as many of its cells as that needs.
        """
        node, rows = np.zeros(len(v), np.int64), np.array(self.rows)
        todo = np.arange(len(v)) if self.children[0] else np.empty(0, np.int64)
        while len(todo):
            going = []
            for n in np.unique(node[todo]).tolist():
                some = todo[node[todo] == n]
                to = self.first[n] + _distances(v[some], self.at(self.below(n))).argmin(1)
                enough = rows[to] >= least
                node[some[enough]] = to[enough]
                going.append(some[enough])
            todo = np.concatenate(going)
            todo = todo[np.array(self.children)[node[todo]] > 0]
        out: list = [None] * len(v)
        for n in np.unique(node).tolist():
            some, under = np.flatnonzero(node == n), self.leaves(n)
            if len(under) == 1:
                for i in some.tolist():
                    out[i] = under
                continue
            order = np.argsort(_distances(v[some], self.at(under)), axis=1, kind="stable")
            needed = (np.cumsum(rows[under][order], 1) < least).sum(1) + 1
            for i, o, m in zip(some.tolist(), order, needed.tolist()):
                out[i] = under[o[:m]]
        return out

    def within(self, v: np.ndarray, bound: np.ndarray, roots: Sequence[int] = (0,), end: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row of v, cell): the cells under `roots` that may hold a point no farther than the bound; nodes marked in `end` count as cells."""
        low, high, first, children = (np.array(x) for x in (self.low, self.high, self.first, self.children))
        last = children == 0 if end is None else end | (children == 0)
        query, node = np.tile(np.arange(len(v)), len(roots)), np.repeat(np.array(roots, np.int64), len(v))
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        while len(query):
            stop = last[node]
            ends.append((query[stop], node[stop]))
            query, node = query[~stop], node[~stop]
            order = np.argsort(node, kind="stable")
            query, node = query[order], node[order]
            found: list[tuple[np.ndarray, np.ndarray]] = []
            nodes, start = np.unique(node, return_index=True)
            for n, some in zip(nodes.tolist(), np.split(query, start[1:])):
                below = np.arange(first[n], first[n] + children[n])
                d = _distances(v[some], self.at(below))
                limit = bound[some][:, None] + 1e-6 * (1.0 + d)
                # Points of a child are no farther from its pivot than from those beside it, so half the gap bounds them too.
                i, j = np.nonzero((d - high[below] <= limit) & (low[below] - d <= limit) & ((d - d.min(1)[:, None]) / 2 <= limit))
                found.append((some[i], below[j]))
            query, node = (np.concatenate(x) for x in zip(*found)) if found else (query[:0], node[:0])
        return tuple(np.concatenate(x) for x in zip(*ends)) if ends else (query, node)

    def chunks(self, size: int) -> tuple[list[list[int]], np.ndarray]:
        """Nodes that are sent as one, of up to `size` points together unless one cell has more, and the chunk of every cell and of these nodes (-1: others)."""
        out: list[list[int]] = []
        todo = [[0]]
        while todo:
            held = 0
            for n in todo.pop():
                if self.rows[n] > size and self.children[n]:
                    todo.append(self.below(n).tolist())
                elif held and held + self.rows[n] <= size:
                    out[-1].append(n)
                    held += self.rows[n]
                else:
                    out.append([n])
                    held = self.rows[n]
        chunk = np.full(len(self.rows), -1)
        for i, nodes in enumerate(out):
            for n in nodes:
                chunk[self.leaves(n)] = i
                chunk[n] = i
        return out, chunk


def _grown(points: DataFrame, fan: int, leaf: int) -> tuple[PivotTree, DataFrame]:
    """The tree over `points` (key, v), and the points with `cell` and `dist`, the distance to the cell's pivot."""
    spark, tree = points.sparkSession, PivotTree()
    placed = points.select("key", "v", "apart", F.lit(0).alias("cell"), F.lit(0.0).alias("dist"))
    tree.rows[0] = placed.count()
    split, level = [0] if tree.rows[0] > leaf else [], 0
    while split:
        level += 1
        big = spark.createDataFrame([(n,) for n in split], "cell int")
        first = Window.partitionBy("cell").orderBy(F.xxhash64("key", F.lit(41 + level)), "key")
        drawn = placed.join(big, "cell").withColumn("r", F.row_number().over(first)).where(F.col("r") <= fan).select("cell", "v")
        pivots: dict[int, list] = {}
        for r in drawn.collect():  # at most `fan` for each cell, of which MOST_SENT bounds the number
            pivots.setdefault(r["cell"], []).append(r["v"])
        for n, some in pivots.items():
            unique = np.unique(np.array(some, float), axis=0)
            if len(unique) > 1:
                tree.split(n, unique)
        sent = spark.sparkContext.broadcast(tree)

        @F.pandas_udf("cell int, dist double")
        def moved(cell: pd.Series, dist: pd.Series, v: pd.Series) -> pd.DataFrame:
            t, cell, dist = sent.value, cell.to_numpy().copy(), dist.to_numpy().copy()
            for n in np.unique(cell).tolist():
                if t.children[n]:
                    some = np.flatnonzero(cell == n)
                    d = _distances(np.stack(v.iloc[some].to_numpy()).astype(float), t.at(t.below(n)))
                    to = d.argmin(1)
                    cell[some], dist[some] = t.first[n] + to, d[np.arange(len(some)), to]
            return pd.DataFrame({"cell": cell.astype("int32"), "dist": dist})

        placed = checkpoint(placed.withColumn("_p", moved("cell", "dist", "v")).select("key", "v", "apart", "_p.cell", "_p.dist"))
        grown = [i for n in split for i in tree.below(n).tolist()]
        for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("dist").alias("a"), F.max("dist").alias("b")).collect():
            if r["cell"]:
                tree.rows[r["cell"]], tree.low[r["cell"]], tree.high[r["cell"]] = r["n"], r["a"], r["b"]
        split = [i for i in grown if tree.rows[i] > leaf and tree.high[i] > 0]
        if len(tree.pivot) and (len(tree.pivot) + fan * len(split)) * 8 * len(tree.pivot[0]) > MOST_SENT:
            split = []
    return tree, placed


@dataclass
class Search:
    """What a search has built: its tree, its points by chunk, and `sent`, the chunks that each query visits."""

    tree: PivotTree
    placed: DataFrame
    sent: DataFrame
    kept: int
    chunk: int
    schema: str

    def visited(self) -> int:
        """Pairs of query and point that are compared when the cells are visited."""
        return _meet(self, self.sent, count=True).agg(F.sum("distance")).first()[0] or 0


def _meet(ready: Search, sent: DataFrame, whole: bool = True, count: bool = False) -> DataFrame:
    """(query, neighbour, distance): the nearest points of each chunk for `sent` (key, v, apart, bound, chunk, cell), none beyond the bound.

    A query meets the points of its cell, or with cell -1 of all cells of the chunk that its bound does not rule out. A chunk of
    more than `ready.chunk` points is cut into parts; without `whole` only the first is met. `count` gives a row for
    each task, whose distance is the number of pairs compared.
    """
    spark, tree, placed, kept = ready.placed.sparkSession, ready.tree, ready.placed, ready.kept
    roots, _ = tree.chunks(ready.chunk)
    visits = {r["chunk"]: r["n"] for r in sent.groupBy("chunk").agg(F.count("*").alias("n")).collect()}  # one row for each chunk
    # A chunk that many queries visit serves them in several blocks, so no task holds all of them.
    # Few queries go in smaller blocks, so that every core has some.
    held = min(2 * ready.chunk, max(ready.chunk // 4, math.ceil(sum(visits.values()) / (2 * spark.sparkContext.defaultParallelism)), 1))
    dealt = [(c, max(1, math.ceil(sum(tree.rows[i] for i in roots[c]) / ready.chunk)), max(1, math.ceil(n / held))) for c, n in visits.items()]
    deal = F.broadcast(spark.createDataFrame(dealt or [(-1, 1, 1)], "chunk int, parts int, blocks int"))
    part, block = F.pmod(F.xxhash64("key"), "parts").cast("int"), F.pmod(F.xxhash64("key", F.lit(7)), "blocks").cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    stored = placed.join(deal, "chunk").select("chunk", part.alias("part"), "key", "v", "apart", "cell", every("blocks").alias("block"))
    parts = every("parts") if whole else F.lit(0)
    sent = sent.join(deal, "chunk").select("chunk", parts.alias("part"), "key", "v", "apart", "bound", "cell", block.alias("block"))
    sent_tree, roots = spark.sparkContext.broadcast(tree), spark.sparkContext.broadcast(roots)

    def match(group_key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query": [], "neighbour": [], "distance": []})
        right = right.sort_values(["cell", "key"])
        a, b = (np.stack(side["v"].to_numpy()).astype(float) for side in (left, right))
        bound, keys = left["bound"].to_numpy() * (1 + 1e-9) + 1e-12, (left["key"].to_numpy(), right["key"].to_numpy())
        groups = left["apart"].to_numpy(), right["apart"].to_numpy()
        cells, first = np.unique(right["cell"].to_numpy(), return_index=True)
        last = np.append(first[1:], len(b))
        given = left["cell"].to_numpy()
        pairs, whole_rows, compared, out = [], [], 0, []
        if given[0] >= 0:
            pairs.append((np.arange(len(a)), given))
        else:
            t, under = sent_tree.value, roots.value[group_key[0]]
            for s in range(0, len(a), SLAB):
                query, node = t.within(a[s : s + SLAB], left["bound"].to_numpy()[s : s + SLAB], under)
                rows = np.where(np.isin(node, cells), (last - first)[np.minimum(np.searchsorted(cells, node), len(cells) - 1)], 0).sum()
                # Queries that visit most points are compared with all at once.
                if 4 * rows >= len(a[s : s + SLAB]) * len(b):
                    whole_rows.append(np.arange(s, min(len(a), s + SLAB)))
                else:
                    pairs.append((query + s, node))

        def nearest(some: np.ndarray, start: int, stop: int) -> None:
            nonlocal compared
            compared += len(some) * (stop - start)
            # One group of points after another, as a query skips those of its own.
            for g in np.unique(groups[0][some]).tolist():
                mine = some[groups[0][some] == g]
                points = np.arange(start, stop) if g is None or g < 0 else start + np.flatnonzero(groups[1][start:stop] != g)
                if len(points) and not count:
                    # Rows of equal distance go by key, also those beyond one cell.
                    points = points[np.argsort(keys[1][points], kind="stable")]
                    i, j, d = _closest(a[mine], b[points], min(kept, len(points)))
                    near = d <= bound[mine][i]
                    out.append((mine[i[near]], points[j[near]], d[near]))

        for some in whole_rows:
            nearest(some, 0, len(b))
        if pairs:
            query, node = (np.concatenate(x) for x in zip(*pairs))
            order = np.argsort(node, kind="stable")
            nodes, start = np.unique(node[order], return_index=True)
            for n, some in zip(nodes.tolist(), np.split(query[order], start[1:])):
                c = np.searchsorted(cells, n)
                if c < len(cells) and cells[c] == n:
                    nearest(some, first[c], last[c])
        if count:
            return pd.DataFrame({"query": keys[0][:1], "neighbour": keys[1][:1], "distance": [float(compared)]})
        if not out:
            return pd.DataFrame({"query": [], "neighbour": [], "distance": []})
        i, j, d = (np.concatenate(x) for x in zip(*out))
        order = np.lexsort((keys[1][j], d, i))
        i, j, d = i[order], j[order], d[order]
        near = np.arange(len(i)) - np.searchsorted(i, i) < kept
        return pd.DataFrame({"query": keys[0][i[near]], "neighbour": keys[1][j[near]], "distance": d[near]})

    by = ["chunk", "part", "block"]
    # Rows are few for the work they make, so their size must not decide how many tasks share it.
    tiles = sum(p * b for _, p, b in dealt)
    tasks = max(1, min(tiles, max(4 * spark.sparkContext.defaultParallelism, tiles // 8)))
    return sent.repartition(tasks, *by).groupBy(*by).cogroup(stored.repartition(tasks, *by).groupBy(*by)).applyInPandas(match, ready.schema)


def _prepared(q: DataFrame, p: DataFrame, kept: int, fan: int, leaf: int, chunk: int, apart: bool) -> Search:
    schema = f"query {q.schema['key'].dataType.simpleString()}, neighbour {p.schema['key'].dataType.simpleString()}, distance double"
    tree, placed = _grown(p, fan, leaf)
    sent_tree = p.sparkSession.sparkContext.broadcast(tree)
    # With groups apart more points are looked at first, so that enough of the others are among them.
    least = 4 * kept + 16 if apart else kept
    roots, chunk_of = tree.chunks(chunk)
    end = np.zeros(len(tree.rows), bool)
    end[[n for nodes in roots for n in nodes]] = True

    @F.pandas_udf("array<int>")
    def nearest(v: pd.Series) -> pd.Series:
        found = sent_tree.value.nearest(np.stack(v.to_numpy()).astype(float), least) if len(v) else []
        return pd.Series([x.astype("int32") for x in found])

    @F.pandas_udf("array<int>")
    def within(v: pd.Series, bound: pd.Series) -> pd.Series:
        out: list = []
        points = np.stack(v.to_numpy()).astype(float) if len(v) else np.empty((0, 1))
        for s in range(0, len(points), SLAB):
            query, node = sent_tree.value.within(points[s : s + SLAB], bound.to_numpy()[s : s + SLAB], (0,), end)
            both = np.unique(query * len(roots) + chunk_of[node])
            rows = np.searchsorted(both // len(roots), np.arange(1, len(points[s : s + SLAB])))
            out += np.split((both % len(roots)).astype("int32"), rows)
        return pd.Series(out)

    @F.pandas_udf("int")
    def chunked(cell: pd.Series) -> pd.Series:
        return pd.Series(chunk_of[cell.to_numpy()].astype("int32"))

    infinite = F.lit(float("inf"))
    ready = Search(tree, checkpoint(placed.withColumn("chunk", chunked("cell"))), placed, kept, chunk, schema)
    start = q.select("key", "v", "apart", infinite.alias("bound"), F.explode(nearest("v")).alias("cell"))
    first = _meet(ready, checkpoint(start.withColumn("chunk", chunked("cell"))), whole=False)
    # A few cells of a query give at most `kept` distances each; the bound is the k-th of them.
    distances = F.sort_array(F.collect_list("distance"))
    bounds = checkpoint(first.groupBy(F.col("query").alias("key")).agg(F.get(distances, F.lit(kept - 1)).alias("bound")))
    known = q.join(bounds, "key", "left").select("key", "v", "apart", F.coalesce("bound", infinite).alias("bound"))
    sent = known.select("key", "v", "apart", "bound", F.explode(within("v", "bound")).alias("chunk")).withColumn("cell", F.lit(-1))
    ready.sent = checkpoint(sent)
    return ready


def knn(
    queries: DataFrame,
    points: DataFrame,
    k: int,
    query_key: str,
    point_key: str,
    query_vector: Column,
    point_vector: Column,
    skip_same_key: bool = False,
    fan: int = FAN,
    leaf: int = LEAF,
    chunk: int = CHUNK,
    apart: str | None = None,
) -> DataFrame:
    """(query, neighbour, distance, rank): the k nearest points of every query; ties go to the smaller key. Keys are unique.

    With `apart`, a column of small whole numbers of both tables, a query passes over the points that have its own value.
    """
    ready = search(queries, points, k + 1 if skip_same_key else k, query_key, point_key, query_vector, point_vector, fan, leaf, chunk, apart)
    if ready is None:
        kinds = [f.schema[c].dataType.simpleString() for f, c in ((queries, query_key), (points, point_key))]
        return points.sparkSession.createDataFrame([], f"query {kinds[0]}, neighbour {kinds[1]}, distance double, rank int")
    found = _meet(ready, ready.sent)
    if skip_same_key:
        found = found.where(F.col("query") != F.col("neighbour"))
    order = Window.partitionBy("query").orderBy("distance", "neighbour")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(
    queries: DataFrame, points: DataFrame, kept: int, query_key: str, point_key: str, query_vector: Column, point_vector: Column,
    fan: int = FAN, leaf: int = LEAF, chunk: int = CHUNK, apart: str | None = None,
) -> Search | None:
    """The tree of the points and the chunks each query visits for its `kept` nearest; None without points."""
    group = (F.col(apart) if apart else F.lit(-1)).cast("int").alias("apart")
    side = lambda f, key, v: f.select(F.col(key).alias("key"), v.cast("array<double>").alias("v"), group).where("v is not null")
    q, p = side(queries, query_key, query_vector), side(points, point_key, point_vector)
    return _prepared(q, p, kept, fan, leaf, chunk, apart is not None) if not p.isEmpty() else None


def knn_classify(
    train: DataFrame, test: DataFrame, features: Sequence[str], label: str, key: str, k: int = 5, apart: str | None = None
) -> DataFrame:
    """(key, prediction): majority label of the k nearest training rows, the smallest label on ties.

    With `apart` only rows with another value of that column count, so one search serves all folds.
    """
    vector = F.array(*[F.col(f"`{n}`").cast("double") for n in features])
    found = knn(test, train, k, key, key, vector, vector, apart=apart)
    labels = train.select(F.col(f"`{key}`").alias("neighbour"), F.col(f"`{label}`").alias("label"))
    votes = found.join(labels, "neighbour").groupBy("query", "label").agg(F.count("*").alias("votes"))
    best = F.min(F.struct((-F.col("votes")).alias("rank"), F.col("label").alias("label"))).alias("best")
    return votes.groupBy("query").agg(best).select(F.col("query").alias(key), F.col("best.label").alias("prediction"))


def knn_outliers(df: DataFrame, features: Sequence[str], key: str, k: int = 10, deviations: float = 3.0) -> DataFrame:
    """Mean distance to the k nearest rows, flagged beyond mean + deviations * std of that distance."""
    vector = F.array(*[F.col(f"`{n}`").cast("double") for n in features])
    found = knn(df, df, k, key, key, vector, vector, skip_same_key=True)
    means = found.groupBy(F.col("query").alias(key)).agg(F.avg("distance").alias("knn_distance"))
    stats = means.agg(F.avg("knn_distance").alias("m"), F.stddev_pop("knn_distance").alias("s")).first()
    limit = (stats["m"] or 0.0) + deviations * (stats["s"] or 0.0)
    return means.withColumn("outlier", F.col("knn_distance") > F.lit(limit))
