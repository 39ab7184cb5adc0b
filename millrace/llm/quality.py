"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

Each text becomes a few statistics of its bytes, words and lines. Random cosines of the scaled statistics approximate a
Gaussian kernel; sums of their products over the partitions give the normal equations, which are as small at any size
of the input and are solved on the driver. A histogram of the fitted values, again summed over partitions, is made
monotone by pooling neighbours and turns a value into a share of good texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.sieve import Sieve
from millrace.llm.words import flat, slices, spare_name, words
from millrace.session import checkpoint

FEATURES, SEED = 256, 11
KERNEL_WIDTH, RIDGE = 4.0, 1e-3
BINS, LOW, HIGH = 1_000, -0.5, 1.5

_MARKS = [ord(c) for c in "!\"#$%&'()*+/:;<=>?@[\\]^_`{|}~"]
_CLASSES = np.zeros((256, 8))
for _n, _some in enumerate((range(65, 91), range(97, 123), range(48, 58), range(128, 256), (32, 9), (10, 13), (44, 45, 46), _MARKS)):
    _CLASSES[list(_some), _n] = 1.0


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of numbers for each text; a missing one counts as empty and gives finite numbers like any other."""
    return np.vstack([_statistics(some) for some in slices(texts)]) if len(texts) else _statistics(texts)


def _statistics(texts: pa.Array) -> np.ndarray:
    data, at = flat(texts)
    n = len(texts)
    size = np.maximum(np.diff(at), 1).astype(float)
    bytes_ = np.zeros((n, 256))
    lines, repeated = np.ones(n), np.zeros(n)
    for i in range(n):
        part = data[at[i] : at[i + 1]]
        bytes_[i] = np.bincount(part, minlength=256)
        rows = part.tobytes().split(b"\n")
        lines[i], repeated[i] = len(rows), 1 - len(set(rows)) / len(rows)
    share = bytes_ / size[:, None]
    classes = share @ _CLASSES
    marks = share[:, _MARKS].max(axis=1)
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
    parsed = words(texts)
    count = parsed.count()
    number = np.maximum(count, 1).astype(float)
    owner, length = parsed.text_of(), np.diff(parsed.start)
    total = lambda x: np.bincount(owner, weights=x, minlength=n) / number
    mean = total(length)
    spread = np.sqrt(np.maximum(total(length.astype(float) ** 2) - mean**2, 0))
    order = np.lexsort((parsed.hash, owner))
    o, h = owner[order], parsed.hash[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    begin = np.flatnonzero(new)
    times = np.diff(np.append(begin, len(h)))
    distinct = np.bincount(o[begin], minlength=n) / number
    most = np.zeros(n)
    np.maximum.at(most, o[begin], times)
    same = np.zeros(len(owner))
    same[1:] = (parsed.hash[1:] == parsed.hash[:-1]) & (owner[1:] == owner[:-1])
    stops = bytes_[:, [33, 46, 63]].sum(axis=1)
    columns = [np.log1p(np.diff(at)), np.log1p(count), mean, spread, total(length <= 2), total(length >= 12), distinct, most / number, total(same), repeated, np.log(lines), np.log1p(number / (1 + stops)), entropy, marks]
    columns += [classes[:, k] for k in range(8)] + [np.log(classes[:, k] + 1e-3) for k in (0, 2, 5, 7)] + [np.log(total(same) + 1e-3), np.log(marks + 1e-3)]
    return np.stack(columns, axis=1)


def _summed(df: DataFrame, size: int, add: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum add(statistics, labels) over the partitions, pairwise on the executors. The result has a fixed size."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size)
        for b in batches:
            if b.num_rows:
                x = np.asarray(b.column(0).flatten()).reshape(b.num_rows, -1)
                out += add(x, np.asarray(b.column(1), float))
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["sums"])

    parts = df.select("stats", "label").mapInArrow(part, "sums binary")
    return parts.rdd.map(lambda r: np.frombuffer(r[0])).treeAggregate(np.zeros(size), np.add, np.add, depth=3)


def pooled(good: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The nearest non-decreasing shares of good among seen (weighted pool of adjacent violators)."""
    blocks: list[list[float]] = []
    for g, s in zip(good.tolist(), seen.tolist()):
        blocks.append([g, s, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            g2, s2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + g2, blocks[-1][1] + s2, blocks[-1][2] + n2]
    return np.concatenate([np.full(int(n), g / s) for g, s, n in blocks]) if blocks else np.empty(0)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    turn: np.ndarray
    phase: np.ndarray
    weight: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2 / len(self.phase)) * np.cos(z @ self.turn + self.phase), z, np.ones((len(z), 1))])

    def value(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        value = self.value(x)
        # A small slope keeps the order inside a pooled block.
        return np.clip(0.999 * np.interp(value, self.knots, self.levels) + 0.001 / (1 + np.exp(-4 * (value - 0.5))), 0, 1)


def fit(rows: DataFrame) -> Model:
    """Fit on `rows` (stats, label 0 or 1). Without rows every score is one half, which predicts 1."""
    n_stats = statistics(pa.array([""])).shape[1]
    moments = _summed(rows, 2 * n_stats + 1, lambda x, y: np.concatenate([x.sum(0), (x**2).sum(0), [len(x)]]))
    seen = max(moments[-1], 1)
    mean = moments[:n_stats] / seen
    scale = np.sqrt(np.maximum(moments[n_stats:-1] / seen - mean**2, 1e-12)) + 1e-6
    draw = np.random.default_rng(SEED)
    turn = draw.normal(size=(n_stats, FEATURES)) / KERNEL_WIDTH
    model = Model(mean, scale, turn, draw.uniform(0, 2 * np.pi, FEATURES), np.zeros(0), np.zeros(2), np.zeros(2))
    wide = FEATURES + n_stats + 1

    def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = model.expand(x)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    sums = _summed(rows, wide * wide + wide, products)
    gram = sums[: wide * wide].reshape(wide, wide)
    model.weight = np.linalg.solve(gram + RIDGE * seen * np.eye(wide) / wide, sums[wide * wide :])

    def binned(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        place = np.clip(((model.value(x) - LOW) / (HIGH - LOW) * BINS).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(place, minlength=BINS), np.bincount(place, weights=y, minlength=BINS)])

    sums = _summed(rows, 2 * BINS, binned)
    held = np.flatnonzero(sums[:BINS])
    if len(held):
        model.knots = LOW + (held + 0.5) * (HIGH - LOW) / BINS
        model.levels = pooled(sums[BINS:][held], sums[:BINS][held])
    else:
        model.knots, model.levels = np.array([LOW, HIGH]), np.array([0.501, 0.501])
    return model


def part_of(doc_id: Column, parts: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts, F.lit(-1))


def _with_stats(docs: DataFrame) -> DataFrame:
    @F.arrow_udf("array<double>")
    def stats(text: pa.Array) -> pa.Array:
        x = statistics(text)
        return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))

    return docs.select("doc_id", stats("text").alias("stats"))


def _training(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows outside the held-out third with their label; of several labels of one id the mean."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(part_of(F.col("doc_id"), 3) != 1)
    known = known.groupBy("doc_id").agg(F.avg("quality").alias("label"))
    return stats.join(known.hint("merge"), "doc_id").select("stats", "label")


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs` (doc_id, text), learned from `labels` (doc_id, quality).

    Only the text is an input of the score. Labels count unless crc32(id) mod 3 is 1. Missing texts are scored as empty
    ones, missing ids are not held out, repeated rows repeat, and without labels every score is one half or a little more.
    """
    stats = checkpoint(_with_stats(docs.select("doc_id", "text")))
    model = fit(checkpoint(_training(stats, labels)))

    @F.arrow_udf("double")
    def scored(x: pa.Array) -> pa.Array:
        n = len(x)
        return pa.array(model.score(np.asarray(x.flatten()).reshape(n, -1)) if n else [], pa.float64())

    out = stats.select("doc_id", (part_of(F.col("doc_id"), 3) == 1).alias("held_out"), scored("stats").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def only_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` whose text is predicted to be good."""
    (name,) = spare_name(docs, "score")
    # Statistics of labelled texts only, and only those travel.
    sieve = Sieve(labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select(F.xxhash64("doc_id")))
    some = docs.select("doc_id", "text").where(sieve.may_hold(F.xxhash64("doc_id")))
    model = fit(checkpoint(_training(_with_stats(some), labels)))

    @F.arrow_udf("double")
    def scored(text: pa.Array) -> pa.Array:
        return pa.array(model.score(statistics(text)) if len(text) else [], pa.float64())

    return docs.withColumn(name, scored("text")).where(F.col(name) >= 0.5).drop(name)
