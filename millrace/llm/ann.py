"""Approximate nearest neighbours with a hash-prefix forest.

Every vector has a long hash string in each tree: the signs of random projections. The index is cut into shards by id;
a shard keeps, for each tree, its strings in sorted order. Queries come in blocks of bounded size and ask every shard.

Down: the neighbours of the query's string in sorted order share the longest prefixes with it. Their distances, merged
over the shards, bound the distance of the k-th neighbour.

Up: two vectors at an angle a share a prefix of x signs in a tree with probability (1 - a / pi) ** x. All trees ascend
together to the longest prefix length at which a vector as near as the bound would be missed in all of them with a
probability of at most `miss`, and everything that shares so long a prefix in any tree is measured. So a query in a
dense place looks at few vectors, and one without near neighbours at many, as it must.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TREES, BITS = 64, 32
NEIGHBOURS = 4  # entries on either side looked at on the way down
MISS = 0.03
SHARD = 65_536  # vectors of a shard
QUERY_BLOCK = 20_000  # queries sent to the tasks at once
SEED = 17


class Forest:
    """The sorted hash strings of one shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        keys = strings(vectors)
        self.order = np.argsort(keys, axis=1, kind="stable")
        self.keys = np.take_along_axis(keys, self.order, axis=1)

    def _best(self, query: np.ndarray, own: int, near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        near = near[self.ids[near] != own]
        away = np.sqrt(((self.vectors[near] - query) ** 2).sum(axis=1))
        if len(away) > 4 * k:
            some = away <= np.partition(away, 2 * k)[2 * k]
            if len(np.unique(self.ids[near[some]])) >= k:
                near, away = near[some], away[some]
        order = np.lexsort((self.ids[near], away))
        ids, away = self.ids[near[order]], away[order]
        first = np.sort(np.unique(ids, return_index=True)[1])[:k]
        return ids[first], away[first]

    def down(self, ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        n, around = len(self.ids), np.arange(-max(NEIGHBOURS, k), max(NEIGHBOURS, k))
        keys = strings(queries)
        places = np.stack([np.searchsorted(self.keys[t], keys[t]) for t in range(TREES)])
        for q in range(len(ids)):
            near = np.clip(places[:, q, None] + around, 0, n - 1)
            yield q, *self._best(queries[q], ids[q], np.unique(np.take_along_axis(self.order, near, axis=1)), k)

    def up(self, ids: np.ndarray, queries: np.ndarray, lengths: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        shift = (BITS - lengths).astype(np.uint64)
        low = (strings(queries) >> shift) << shift
        high = low + (np.uint64(1) << shift)
        begin = np.stack([np.searchsorted(self.keys[t], low[t]) for t in range(TREES)])
        end = np.stack([np.searchsorted(self.keys[t], high[t]) for t in range(TREES)])
        for q in range(len(ids)):
            seen = np.zeros(len(self.ids), bool)
            for t in range(TREES):
                seen[self.order[t, begin[t, q] : end[t, q]]] = True
            yield q, *self._best(queries[q], ids[q], np.flatnonzero(seen), k)


def strings(vectors: np.ndarray) -> np.ndarray:
    """(trees, vectors): the first BITS signs of each tree's projections, the first sign highest."""
    turn = np.random.default_rng(SEED).normal(size=(vectors.shape[1], TREES * BITS)).astype(np.float32)
    out = np.zeros((TREES, len(vectors)), np.uint64)
    power = (np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)).astype(np.float64)
    for i in range(0, len(vectors), 4096):
        signs = (vectors[i : i + 4096].astype(np.float32) @ turn > 0).reshape(-1, TREES, BITS)
        out[:, i : i + 4096] = (signs @ power).T.astype(np.uint64)
    return out


def prefix_lengths(norms: np.ndarray, bounds: np.ndarray, least: float, most: float, miss: float) -> np.ndarray:
    """The prefix length to ascend to for queries of these norms, all other vectors having norms from least to most."""
    norm = np.clip(np.sqrt(np.maximum(norms**2 - np.minimum(bounds, 1e150) ** 2, 0)), least, most)
    with np.errstate(over="ignore", invalid="ignore"):
        cosine = (norms**2 + norm**2 - bounds**2) / (2 * norms * norm)
    same = 1 - np.arccos(np.clip(np.nan_to_num(cosine, nan=-1.0, neginf=-1.0), -1, 1)) / np.pi
    x = np.arange(BITS + 1)
    missed = (1 - same[:, None] ** x) ** TREES
    return np.where(np.isfinite(bounds), (missed <= miss).cumprod(axis=1).sum(axis=1) - 1, 0)


def _asked(sent, k: int, upwards: bool):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = [b for b in batches if b.num_rows]
        asking, queries, lengths = sent.value
        if not some or not len(asking):
            return
        ids = np.concatenate([np.asarray(b.column(0)) for b in some])
        vectors = np.concatenate([np.asarray(b.column(1).flatten(), float).reshape(b.num_rows, -1) for b in some])
        forest = Forest(ids, vectors)
        out: list[list[np.ndarray]] = [[], [], []]
        for q, near, away in forest.up(asking, queries, lengths, k) if upwards else forest.down(asking, queries, k):
            for column, x in zip(out, (np.full(len(near), asking[q]), near, away)):
                column.append(x)
        columns = [pa.array(np.concatenate(x), kind) for x, kind in zip(out, (pa.int64(), pa.int64(), pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score"])

    return ask


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and embedding (double) of the rows that take part: an id, and a vector that is neither zero nor holds
    anything missing or not finite, of the most frequent length."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    length = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("embedding") == (length.n if length else 0))


def nearest(embeddings: DataFrame, queries: DataFrame, k: int = 10, miss: float = MISS) -> DataFrame:
    """query_id, rank, vec_id, score: for each of `queries` its k nearest of `embeddings` found, by Euclidean distance.

    Both have vec_id and embedding. A query's own id is no neighbour of it. Ties go to the smaller id, rows that repeat an
    id count once with their smaller distance, and of queries that repeat an id the smallest vector asks. With fewer than
    k candidates, all are returned. `miss` is the probability to miss a neighbour; 0 measures every vector.
    """
    spark = embeddings.sparkSession
    rows = usable(embeddings)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    total, least, most = rows.agg(F.count("*"), F.min(norm), F.max(norm)).first()
    shards = rows.repartition(max(spark.sparkContext.defaultParallelism, -(-total // SHARD)), "vec_id")
    asking = usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    n_blocks = max(1, -(-asking.count() // QUERY_BLOCK))
    nearest_first = Window.partitionBy("query_id").orderBy("score", "vec_id")
    kind = "query_id long, vec_id long, score double"
    out = None
    for b in range(n_blocks):
        block = asking.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == b).toArrow()
        ids = block.column("vec_id").to_numpy()
        vectors = np.asarray(block.column("embedding").combine_chunks().flatten(), float).reshape(len(ids), -1) if len(ids) else np.zeros((0, 1))
        bounds = np.full(len(ids), np.inf)
        if len(ids) and total:
            sent = spark.sparkContext.broadcast((ids, vectors, None))
            down = shards.mapInArrow(_asked(sent, k, False), kind).withColumn("rank", F.row_number().over(nearest_first))
            place = {i: n for n, i in enumerate(ids.tolist())}
            for r in down.where(F.col("rank") == k).select("query_id", "score").collect():
                bounds[place[r.query_id]] = r.score
        lengths = prefix_lengths(np.sqrt((vectors**2).sum(axis=1)), bounds, least or 0.0, most or 0.0, miss) if len(ids) else np.zeros(0, int)
        sent = spark.sparkContext.broadcast((ids, vectors, lengths))
        found = shards.mapInArrow(_asked(sent, k, True), kind)
        out = found if out is None else out.unionByName(found)
    ranked = out.withColumn("rank", F.row_number().over(nearest_first)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
