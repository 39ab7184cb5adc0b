"""RBF machines on random Fourier features, with the models of all folds and classes fitted in lock step.

A model minimises its mean loss (hinge, or Huber's with its own scale) plus a penalty on the weights of standardised features, by
L-BFGS. Each pass over the table gives the losses and gradients that all models ask for, so the features are mapped once for all of
them and never stored; tasks give sums, whose size follows the number of models. The passes read blocks of rows packed into one
record each, and map them in slices that stay in a core's cache, with cosines in single precision.
"""

from __future__ import annotations

import math
from collections.abc import Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import checkpoint

FOURIER = 128
ROUNDS = 100
TOLERANCE = 1e-6
BEND = 1.35  # residuals beyond so many scales count by their size
SLICE = 1024  # rows mapped at a time
HELD = -1  # the model that leaves out the rows held out; others leave out the fold of their number


@dataclass(frozen=True)
class Fourier:
    """Random Fourier features of the RBF kernel with gamma = 1 / (features * variance), and a constant."""

    weights: np.ndarray
    shift: np.ndarray

    def __call__(self, points: np.ndarray) -> np.ndarray:
        out = np.ones((len(points), len(self.shift) + 1))
        angle = points @ self.weights
        angle += self.shift
        np.multiply(np.cos(angle.astype(np.float32)), math.sqrt(2.0 / len(self.shift)), out=out[:, :-1])
        return out


def fourier(variance: float, features: int, size: int = FOURIER, seed: int = 42) -> Fourier:
    rng = np.random.default_rng(seed)
    weights = rng.normal(0.0, math.sqrt(2.0 / (features * variance)), (features, size))
    return Fourier(weights, rng.uniform(0.0, 2.0 * math.pi, size))


def minimised(start: np.ndarray, rounds: int = ROUNDS, tolerance: float = TOLERANCE, memory: int = 10) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """L-BFGS with steps by bisection, also for losses with kinks: yields points, gets value and gradient."""
    w, pairs, values = start, [], []
    f, g = yield w
    for _ in range(rounds):
        values.append(f)
        if not g.any() or (len(values) > 10 and values[-11] - f <= tolerance * abs(f)):
            break
        d, used = -g, []
        for s, y in reversed(pairs):
            used.append((s @ d) / (s @ y))
            d = d - used[-1] * y
        if pairs:
            s, y = pairs[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y), a in zip(pairs, reversed(used)):
            d = d + (a - (y @ d) / (s @ y)) * s
        slope, low, high = g @ d, 0.0, math.inf
        if slope >= 0:
            d, slope, pairs = -g, -(g @ g), []
        step = 1.0 if pairs else min(1.0, 1.0 / math.sqrt(g @ g))
        best = (f, g, w)
        for _ in range(20):
            at = w + step * d
            value, slant = yield at
            if value < best[0]:
                best = (value, slant, at)
            if not value <= f + 1e-4 * step * slope:
                high = step
            elif slant @ d < 0.9 * slope:
                low = step
            else:
                break
            step = (low + high) / 2 if high < math.inf else 2 * low
        if best[0] >= f:
            break
        s, y = best[2] - w, best[1] - g
        if s @ y > 1e-12 * (s @ s):
            pairs = [*pairs[1 - memory :], (s, y)] if len(pairs) >= memory else [*pairs, (s, y)]
        f, g, w = best
    return w


def hinge(margin: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The loss of each row and its derivative by the margin."""
    gap = 1.0 - sign * margin
    return np.maximum(gap, 0.0), np.where(gap > 0, -sign, 0.0)


def huber(margin: np.ndarray, y: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The loss of each row and its derivatives by the margin and the scale."""
    r = (y - margin) / scale
    near = np.abs(r) <= BEND
    loss = 0.5 * scale * np.where(near, 1.0 + r * r, 1.0 + 2.0 * BEND * np.abs(r) - BEND * BEND)
    return loss, np.where(near, -r, -BEND * np.sign(r)), 0.5 * (1.0 - np.where(near, r * r, BEND * BEND))


def _packed(data: DataFrame, width: int) -> DataFrame:
    """(v, label, fold, held) of whole batches of rows as bytes, written once."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                points, label, fold, held = _columns(b, width)
                arrays = (points, label, fold.astype(np.int32), held)
                yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in arrays], ["v", "label", "fold", "held"])

    return checkpoint(data.select("label", "fold", "held", "v").mapInArrow(pack, "v binary, label binary, fold binary, held binary"))


def _summed(blocks: DataFrame, width: int, sums) -> np.ndarray:
    """The sum of what `sums(points, label, fold, held)` gives for slices of the blocks; a task sends one array."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for v, label, fold, held in zip(*[b.column(n) for n in ("v", "label", "fold", "held")]):
                rows = np.frombuffer(v.as_buffer(), float).reshape(-1, width), np.frombuffer(label.as_buffer(), float), np.frombuffer(fold.as_buffer(), np.int32), np.frombuffer(held.as_buffer(), bool)
                for at in range(0, len(rows[0]), SLICE):
                    found = sums(*[a[at : at + SLICE] for a in rows])
                    total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    return sum(np.frombuffer(r["sums"], float) for r in blocks.mapInArrow(part, "sums binary").collect())


def _columns(b: pa.RecordBatch, width: int) -> tuple[np.ndarray, ...]:
    points = np.asarray(b.column("v").flatten(), float).reshape(b.num_rows, width)
    return points, np.asarray(b.column("label"), float), np.asarray(b.column("fold")), b.column("held").to_numpy(zero_copy_only=False).astype(bool)


def _inside(outs: np.ndarray, fold: np.ndarray, held: np.ndarray) -> np.ndarray:
    """(rows, models): whether a model is fitted on a row."""
    return np.where(outs == HELD, ~held[:, None], fold[:, None] != outs)


@dataclass
class Machines:
    """Fitted models: those of fold `outs[i]` have their weights, by class, in `weights[i]`."""

    space: Fourier
    classes: int
    outs: list[int]
    weights: np.ndarray  # (models, classes or 1, features + 1)

    def predict(self, points: np.ndarray, out: int) -> np.ndarray:
        margin = self.space(points) @ self.weights[self.outs.index(out)].T
        if not self.classes:
            return margin[:, 0]
        return (margin[:, 0] > 0).astype(float) if margin.shape[1] == 1 else margin.argmax(1).astype(float)


def fit(data: DataFrame, width: int, classes: int, penalty: float, folds: int) -> Machines:
    """Models of the rows not held out and, with `folds`, of all but each fold. `data` is (label, fold, held, v); `classes` 0: values."""
    x = F.explode("v").alias("x")
    space = fourier(data.select(x).agg(F.var_pop("x").alias("var")).first()["var"] or 1.0, width)
    outs, sides = [HELD, *range(folds)], classes if classes > 2 else 1
    out = np.repeat(np.array(outs), sides)
    side = np.tile(np.arange(sides) if sides > 1 else np.array([1]), len(outs))
    middle, spread = 0.0, 1.0
    if not classes:
        row = data.agg(F.avg("label").alias("m"), F.stddev_pop("label").alias("s")).first()
        middle, spread = row["m"], row["s"] or 1.0
    m, n = len(out), FOURIER + 1
    blocks = _packed(data, width)

    def moments(points, label, fold, held):
        mapped, rows = space(points), _inside(out, fold, held).astype(float)
        return np.concatenate([rows.sum(0), (rows.T @ mapped).ravel(), (rows.T @ mapped**2).ravel()])

    sums = _summed(blocks, width, moments)
    count, mean, square = sums[:m], sums[m : m + m * n].reshape(m, n), sums[m + m * n :].reshape(m, n)
    mean, square = mean / count[:, None], square / count[:, None]
    scale = np.sqrt(np.maximum(square - mean**2, 0.0))
    scale[:, -1] = 1.0
    scale[scale == 0.0] = 1.0
    # Labels are standardised, and the penalty with them, so the minimum is that of the labels as they are.
    strength = np.full(n, penalty * spread)
    strength[-1] = 0.0
    models = [minimised(np.zeros(n + (not classes))) for _ in range(m)]
    asked, done = {i: next(model) for i, model in enumerate(models)}, {}
    while asked:
        some = np.array(sorted(asked))
        w = np.stack([asked[i][:n] / scale[i] for i in some])
        scales = np.array([1.0 if classes else math.exp(min(max(asked[i][n], -30.0), 30.0)) for i in some])
        sums = _summed(blocks, width, _losses(space, classes, w, scales, out[some], side[some], middle, spread))
        k = len(some)
        loss, slant, slope = sums[:k], sums[k : k + k * n].reshape(k, n), sums[k + k * n :]
        for j, i in enumerate(some.tolist()):
            u = asked[i][:n]
            value = loss[j] / count[i] + 0.5 * (strength * u) @ u
            gradient = slant[j] / scale[i] / count[i] + strength * u
            if not classes:
                gradient = np.append(gradient, slope[j] * scales[j] / count[i])
            try:
                asked[i] = models[i].send((value, gradient))
            except StopIteration as end:
                done[i] = end.value[:n] / scale[i]
                del asked[i]
    weights = np.stack([done[i] for i in range(m)]).reshape(len(outs), sides, n) * spread
    weights[:, :, -1] += middle
    return Machines(space, classes, outs, weights)


def _losses(space: Fourier, classes: int, w: np.ndarray, scales: np.ndarray, out: np.ndarray, side: np.ndarray, middle: float, spread: float):
    """What gives the summed losses of models, their gradients and their slopes by the scale."""

    def sums(points, label, fold, held):
        mapped, rows = space(points), _inside(out, fold, held)
        margin = mapped @ w.T
        if classes:
            loss, slant = hinge(margin, np.where(label[:, None] == side, 1.0, -1.0))
            slope = np.zeros_like(loss)
        else:
            loss, slant, slope = huber(margin, (label[:, None] - middle) / spread, scales)
        return np.concatenate([(loss * rows).sum(0), ((slant * rows).T @ mapped).ravel(), (slope * rows).sum(0)])

    return sums


def predictions(data: DataFrame, width: int, found: Machines) -> DataFrame:
    """(key, label, fold, held, prediction, held_prediction): by the model that left out the row's fold, and by that of the holdout."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points, _, fold, held = _columns(b, width)
            one, two = np.full(b.num_rows, np.nan), np.full(b.num_rows, np.nan)
            for out in found.outs:
                rows = np.flatnonzero(held if out == HELD else fold == out)
                for some in np.array_split(rows, len(rows) // SLICE + 1):
                    (two if out == HELD else one)[some] = found.predict(points[some], out)
            columns = [b.column(n) for n in ("key", "label", "fold", "held")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(one), pa.array(two)], ["key", "label", "fold", "held", "prediction", "held_prediction"])

    kind = data.schema["key"].dataType.simpleString()
    return data.mapInArrow(predict, f"key {kind}, label double, fold int, held boolean, prediction double, held_prediction double")


def flat(train: DataFrame, test: DataFrame) -> DataFrame:
    """(key, label, fold, held, v), written once."""
    columns = [F.col("key"), F.col("label").cast("double").alias("label"), F.col("fold").cast("int").alias("fold")]
    both = [part.select(*columns, F.lit(held).alias("held"), vector_to_array("features").alias("v")) for part, held in ((train, False), (test, True))]
    return checkpoint(both[0].unionByName(both[1]))
