"""Forests and boosted trees from sums over one binned table, many of them at a time.

Columns are cut into at most BINS bins, and a tree is grown from sums of (hessian, gradients) per node, column and bin. Growing
is a coroutine: it asks for the sums of some nodes and goes on when it gets them, so the same code grows a tree

* in one task, over a table whose bins are few enough to be sent to every task: each task then fits whole models, and a search
  of many settings and folds is dealt out model by model;
* over a table of any size: all models go on in lock step, and each pass over the table gives the sums that all of them ask for.

Rows of equal bins and fold always stand in the same leaf: a table of many rows is first summed up to one row for each, with their
number, mean label and its variance (for classes also one for each label), and sent if these are few enough. A forest then draws
rows alike together, as often as single draws would. A forest's trees are dealt out in parts.

Forests that differ in the number of trees, their depth and the rows a split needs share their trees, if the columns tried at a node
follow its path: the largest forest is grown once, and the others are cut out of it.

Rows are drawn for a tree by a hash of their key, so both ways, and a task that runs again, grow the same trees; rows alike by a
generator seeded with the tree, in the order of their bins.

A split's gain is G_l^2 / (H_l + penalty) + G_r^2 / (H_r + penalty) - G^2 / (H + penalty), summed over the outputs of a tree.
Boosting takes first and second derivatives of its loss (squares, logistic, softmax with a tree for each class). In a
forest H is the weight of the rows and G that of each class, or of the target: the gain is then that of the Gini index, or of
the variance. Trees grow level by level, or with `leaves` by the best leaf first.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable, Generator, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import checkpoint

BINS = 64
# Bytes of bins and labels that may be sent to every task; larger tables are passed over.
MOST_SENT = 64_000_000
# Bytes of sums that one pass may give; more are asked for in further passes.
MOST_SUMS = 128_000_000
BESIDE_ROWS = 60_000  # rows of trees that one task grows side by side
PASS_ROWS = 100_000  # rows of a task that a pass sums up at a time
BESIDE = 16  # trees of a forest that passes grow side by side
TOGETHER = 16  # trees of forests that share them, grown before they are scored
LOOKED_UP = 16_384  # rows whose leaf is looked up at a time
PACKED = 4096  # bins of columns that are summed up together
ALIKE_FROM = 200_000  # rows from which a table is summed up even if it could be sent
MOST_ALIKE = 2 * MOST_SENT  # bytes of rows alike that may be sent to every task
_POISSON = np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320)])
_ONE_MORE = np.diff(_POISSON, prepend=0.0) / (1.0 - np.concatenate([[0.0], _POISSON[:-1]]))  # chance of k draws after k - 1


@dataclass(frozen=True)
class Spec:
    """One model. `fold` is the fold left out of the fit and scored; None fits all rows."""

    kind: str  # forest or boost
    task: str  # classification or regression
    classes: int = 2
    trees: int = 100
    depth: int = 6
    rate: float = 0.1
    penalty: float = 1.0
    least_weight: float = 1.0  # hessian (boost) or weight (forest) that a child needs
    least_rows: int = 1  # rows that a child needs
    least_split: int = 2  # rows that a node needs to be split
    leaves: int | None = None  # grow the best leaf first, up to so many
    columns: str | int = "all"  # or sqrt, third, a number: columns tried at each node of a forest
    draw: bool = True  # rows of a forest's tree are drawn with replacement
    class_weights: tuple[float, ...] | None = None
    fold: int | None = None
    seed: int = 42
    first: int = 0  # number of the first tree of a part of a forest
    paths: bool = False  # the columns tried at a node follow its path from the root, else its number in the tree

    @property
    def outputs(self) -> int:
        """Outputs of one tree."""
        return self.classes if self.kind == "forest" and self.task == "classification" else 1

    @property
    def margins(self) -> int:
        """Numbers that the model gives for a row."""
        return self.classes if self.task == "classification" and (self.kind == "forest" or self.classes > 2) else 1

    @property
    def per_round(self) -> int:
        return self.margins if self.kind == "boost" else 1


@dataclass
class Tree:
    column: list[int] = field(default_factory=lambda: [-1])  # -1: a leaf
    cut: list[int] = field(default_factory=lambda: [0])  # bins up to it go left
    left: list[int] = field(default_factory=lambda: [0])  # the right child is the next one
    value: list[np.ndarray] = field(default_factory=lambda: [np.zeros(1)])
    # Left behind when a tree is sent: parent, level, rows, and number of the path (children of i: 2i + 1 and 2i + 2).
    parent: list[int] = field(default_factory=lambda: [0])
    level: list[int] = field(default_factory=lambda: [0])
    rows: list[float] = field(default_factory=lambda: [np.inf])
    path: list[int] = field(default_factory=lambda: [0])

    def __getstate__(self) -> tuple[np.ndarray, ...]:
        return np.array(self.column, np.int32), np.array(self.cut, np.int16), np.array(self.left, np.int32), np.stack(self.value)

    def __setstate__(self, state: tuple[np.ndarray, ...]) -> None:
        self.column, self.cut, self.left = (a.tolist() for a in state[:3])
        self.value = list(state[3])

    def split(self, node: int, column: int, cut: int, values: Sequence[np.ndarray], rows: Sequence[float]) -> int:
        at = len(self.column)
        self.column[node], self.cut[node], self.left[node] = column, cut, at
        for side in (0, 1):
            self.column.append(-1)
            self.cut.append(0)
            self.left.append(0)
            self.value.append(values[side])
            self.parent.append(node)
            self.level.append(self.level[node] + 1)
            self.rows.append(rows[side])
            self.path.append((2 * self.path[node] + 1 + side) % 2**64)
        return at

    def ends(self, specs: Sequence[Spec]) -> np.ndarray:
        """(specs, nodes): whether a node is split no further in the tree of a setting; the root needs no rows."""
        column, level, rows = np.array(self.column), np.array(self.level), np.array(self.rows)
        return np.stack([(column < 0) | (level >= s.depth) | (rows < s.least_split) for s in specs])

    def pruned(self, spec: Spec) -> Tree:
        """The tree of a smaller setting, cut out of this one."""
        return replace(self, column=np.where(self.ends([spec])[0], -1, self.column).tolist())

    def nodes(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row of bins."""
        inner = np.array(self.column) >= 0
        # A leaf leads to itself, so rows only leave when most have come to theirs.
        column, left = np.where(inner, self.column, 0), np.where(inner, self.left, np.arange(len(inner)))
        cut = np.where(inner, self.cut, 255).astype(np.uint8)
        out = np.zeros(len(x), np.int64)
        for first in range(0, len(x), LOOKED_UP):
            flat, at = x[first : first + LOOKED_UP].ravel("F"), out[first : first + LOOKED_UP]
            rows, here, start = np.arange(len(at)), np.zeros(len(at), np.int64), column * len(at)
            while going := np.count_nonzero(some := inner.take(here)):
                if 2 * going < len(rows):
                    at[rows] = here
                    rows, here = rows[some], here[some]
                here = left.take(here) + (flat.take(start.take(here) + rows) > cut.take(here))
            at[rows] = here
        return out


@dataclass
class Sums:
    """What a growing tree asks for: sums of these nodes of tree `number` of the round."""

    number: int
    tree: Tree
    nodes: list[int]


@dataclass
class Splits:
    """The best split of each node: gain 0 without one; of equal ones that of the first column and bin."""

    gain: np.ndarray
    column: np.ndarray
    cut: np.ndarray
    left: np.ndarray  # (nodes, 2 + outputs): rows, H, G... of the left side
    right: np.ndarray


def _best(sums: np.ndarray, spec: Spec, number: int, width: int, tree: Tree, nodes: Sequence[int]) -> Splits:
    """`sums` is (nodes, 2 + outputs, columns, bins): rows, H, then G of each output, of all columns or those tried."""
    n, planes, given, bins = sums.shape
    columns = _tried_at(spec, width, number, tree, nodes)
    if columns is not None and given == width:
        sums = np.take_along_axis(sums, columns[:, None, :, None], 2)
    left = np.cumsum(sums, axis=3)
    total, left = left[..., -1:], left[..., :-1]
    right = total - left

    def score(side: np.ndarray) -> np.ndarray:
        out = side[:, 2] ** 2
        for k in range(3, planes):
            out += side[:, k] ** 2
        return out / np.maximum(side[:, 1] + spec.penalty, 1e-300)

    before = score(total)
    gain = score(left) + score(right) - before
    gain[(np.minimum(left[:, 0], right[:, 0]) < max(spec.least_rows, 1)) | (np.minimum(left[:, 1], right[:, 1]) < spec.least_weight)] = 0.0
    gain = gain.reshape(n, -1)
    if not gain.shape[1]:
        none = np.zeros(n, np.int64)
        return Splits(np.zeros(n), none, none, total[:, :, 0, 0], total[:, :, 0, 0])
    # Gains that differ by rounding only count as equal.
    top = gain.max(1)
    at = np.argmax(gain >= (top * (1 - 1e-9))[:, None], axis=1)
    top = np.where(top > 1e-9 * np.maximum(1.0, before[:, 0, 0]), top, 0.0)
    column, cut, each = at // (bins - 1), at % (bins - 1), np.arange(n)
    best = left[each, :, column, cut]
    rest = total[:, :, 0, 0] - best
    return Splits(top, column if columns is None else columns[each, column], cut, best, rest)


def columns_tried(spec: Spec, width: int) -> int:
    return {"all": width, "sqrt": max(1, int(np.sqrt(width))), "third": max(1, width // 3)}.get(spec.columns, spec.columns)


def _tried(spec: Spec, width: int, tree: int | np.ndarray, nodes: Sequence[int]) -> np.ndarray | None:
    """The columns each node may split by, drawn anew for each node of a forest; None for all. Nodes of several trees come with theirs."""
    few = columns_tried(spec, width)
    if few >= width:
        return None
    salt = (spec.seed * 1_000_003 + tree) * 2 + 1 if isinstance(tree, int) else salts([(spec.seed * 1_000_003 + t) * 2 + 1 for t in tree.tolist()])[:, None]
    draws = mixed(np.array(nodes, np.uint64)[:, None] * np.uint64(width) + np.arange(width, dtype=np.uint64), salt)
    return np.sort(np.argsort(draws, 1)[:, :few], 1)


def _tried_at(spec: Spec, width: int, number: int, tree: Tree, nodes: Sequence[int]) -> np.ndarray | None:
    return _tried(spec, width, number, [tree.path[n] for n in nodes] if spec.paths else nodes)


def salts(seeds: Sequence[int]) -> np.ndarray:
    return np.array([s * 0x9E3779B97F4A7C15 % 2**64 for s in seeds], np.uint64)


def mixed(x: np.ndarray, seed: int | np.ndarray) -> np.ndarray:
    """64 well spread bits of each number; several seeds are given as their `salts`."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) ^ (seed if isinstance(seed, np.ndarray) else salts([seed])[0])
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(31))


def drawn(key: np.ndarray, seed: int, tree: int | np.ndarray) -> np.ndarray:
    """How often each row is drawn for a tree: Poisson with mean 1. Several trees give a row each."""
    salt = seed * 1_000_003 + tree if isinstance(tree, int) else salts([seed * 1_000_003 + int(t) for t in tree])[:, None]
    u = (mixed(key, salt) >> np.uint64(11)).astype(float) / 2.0**53
    return np.searchsorted(_POISSON, u, "right").astype(float)


def drawn_together(rows: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(rows drawn at all, draws) of groups of rows alike, as single Poisson draws of mean 1 give them."""
    left, some, draws = rows.astype(np.int64), np.zeros(len(rows)), np.zeros(len(rows))
    for times, chance in enumerate(_ONE_MORE):
        here = np.flatnonzero(left)
        hit = rng.binomial(left[here], chance)
        left[here] -= hit
        if times:
            some[here] += hit
            draws[here] += times * hit
    return some + left, draws + len(_ONE_MORE) * left


def _leaves(total: np.ndarray, spec: Spec) -> np.ndarray:
    """The values of nodes from their (rows, H, G...)."""
    if spec.kind == "forest":
        return total[:, 2:] / np.maximum(total[:, 1:2], 1e-300)
    return -spec.rate * total[:, 2:] / np.maximum(total[:, 1:2] + spec.penalty, 1e-300)


def _open(total: np.ndarray, spec: Spec) -> np.ndarray:
    """Whether nodes of these (rows, H, G...) may be split at all."""
    enough = (total[:, 0] >= max(spec.least_split, 2 * spec.least_rows)) & (total[:, 1] >= 2 * spec.least_weight)
    return enough if spec.outputs == 1 else enough & (total[:, 2:].max(1) < total[:, 1] * (1 - 1e-12))


def _split(tree: Tree, nodes: Sequence[int], best: Splits, some: np.ndarray, spec: Spec) -> list[int]:
    """Split the nodes numbered `some`; the children that may be split further."""
    values = [_leaves(side, spec) for side in (best.left, best.right)]
    opens = [_open(side, spec).tolist() for side in (best.left, best.right)]
    out = []
    for i in some.tolist():
        at = tree.split(nodes[i], int(best.column[i]), int(best.cut[i]), (values[0][i], values[1][i]), (best.left[i, 0], best.right[i, 0]))
        out += [at + k for k in (0, 1) if opens[k][i]]
    return out


def _grow(spec: Spec, number: int, width: int, tree: Tree) -> Generator[Sums, np.ndarray, None]:
    first = yield Sums(number, tree, [0])
    tree.value[0] = _leaves(first[:, :, 0].sum(2), spec)[0]
    if spec.leaves is None:
        level, sums = [0], first
        for depth in range(spec.depth):
            best = _best(sums, spec, number, width, tree, level)
            new = _split(tree, level, best, np.flatnonzero(best.gain > 0), spec)
            if not new or depth + 1 == spec.depth:
                return
            level, sums = new, (yield Sums(number, tree, new))
        return
    # The largest gain first; children are looked at as soon as their parent is split.
    heap: list[tuple] = []
    known = {0: (first, 0)}
    fresh, made = [0], 1
    while made < spec.leaves:
        for node in fresh:
            sums, depth = known.pop(node)
            best = _best(sums, spec, number, width, tree, [node])
            if best.gain[0] > 0:
                heapq.heappush(heap, (-best.gain[0], node, depth, best))
        if not heap:
            return
        _, node, depth, best = heapq.heappop(heap)
        fresh = _split(tree, [node], best, np.zeros(1, int), spec)
        made += 1
        if depth + 1 >= spec.depth or made >= spec.leaves:
            fresh = []
        if fresh:
            found = yield Sums(number, tree, fresh)
            known |= {n: (found[i : i + 1], depth + 1) for i, n in enumerate(fresh)}


def _model(spec: Spec, width: int, beside: int = 1) -> Generator[list[Sums] | None, list[np.ndarray] | None, list[Tree]]:
    """Grow all trees of a model: yields what its trees ask for, and None when the trees of a round are done.

    The trees of a round grow side by side: one for each margin, or `beside` of a forest.
    """
    trees: list[Tree] = []
    if spec.kind == "boost" and spec.task == "regression":
        mean = Tree()
        (found,) = yield [Sums(0, mean, [0])]
        _, h, g = found[0, :, 0].sum(1)
        mean.value[0] = np.array([-g / max(h, 1e-300)])
        trees.append(mean)
        yield None
    first = len(trees) + spec.first
    total = first + spec.trees * (spec.per_round if spec.kind == "boost" else 1)
    side = spec.per_round if spec.kind == "boost" else beside
    for at in range(first, total, side):
        mine = [Tree(value=[np.zeros(spec.outputs)]) for _ in range(min(side, total - at))]
        growing = [_grow(spec, at + i, width, t) for i, t in enumerate(mine)]
        asked = [next(g) for g in growing]
        while asked:
            found = yield asked
            going, asked, growing = growing, [], []
            for g, sums in zip(going, found):
                try:
                    asked.append(g.send(sums))
                    growing.append(g)
                except StopIteration:
                    pass
        trees += mine
        yield None
    return trees


def _derivatives(spec: Spec, y: np.ndarray, margin: np.ndarray, weight: np.ndarray, output: int) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the loss by one margin."""
    if spec.task == "regression":
        return (margin[:, 0] - y) * weight, weight
    if spec.margins == 1:
        p = 1.0 / (1.0 + np.exp(-margin[:, 0]))
        return (p - y) * weight, np.maximum(p * (1 - p), 1e-16) * weight
    e = np.exp(margin - margin.max(1, keepdims=True))
    p = e[:, output] / e.sum(1)
    return (p - (y == output)) * weight, np.maximum(2 * p * (1 - p), 1e-16) * weight


def _weights(spec: Spec, y: np.ndarray) -> np.ndarray:
    return np.array(spec.class_weights)[y.astype(int)] if spec.class_weights else np.ones(len(y))


def _targets(
    spec: Spec, y: np.ndarray, margin: np.ndarray | None, key: np.ndarray | None, number: int, rows: np.ndarray | None = None, spread: np.ndarray | None = None
) -> tuple[np.ndarray, list[np.ndarray], np.ndarray | None]:
    """H, the G of each output and the number of rows (None: 1) for the rows of a tree. With `rows` each stands for several, and
    `rows` is (classes, rows) for classes."""
    if rows is not None and spec.task == "classification":
        return _class_targets(spec, margin, number, rows)
    weight = _weights(spec, y) if rows is None else rows
    if spec.kind == "boost":
        g, h = _derivatives(spec, y, margin, weight, number % spec.per_round)
        return h, [g], rows
    total = None
    if spec.draw and rows is None:
        weight = weight * drawn(key, spec.seed, number)
    elif spec.draw:
        rng = np.random.default_rng((spec.seed, number))
        rows, weight = _drawn_alike(spec, rows, rng)
        # The labels of the draws add up to about their mean and variance, and to the label itself where all are equal.
        total = weight * y + np.sqrt(weight * spread) * rng.standard_normal(len(y))
    if spec.task == "classification":
        return weight, [weight * (y == k) for k in range(spec.classes)], rows
    return weight, [weight * y if total is None else total], rows


def _drawn_alike(spec: Spec, rows: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray | None, np.ndarray]:
    """(rows drawn at all, draws) of groups of rows alike; None if only those without draws matter, as rows alike never part."""
    if spec.least_rows <= 1 and spec.least_split <= 2 and not spec.paths:
        return None, rng.poisson(rows).astype(float)
    return drawn_together(rows, rng)


def _class_targets(spec: Spec, margin: np.ndarray | None, number: int, counts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray | None]:
    """What `_targets` gives for groups of rows alike, of each of which `counts` has the number by class."""
    weights = np.ones(spec.classes) if spec.class_weights is None else np.array(spec.class_weights)
    if spec.kind == "forest":
        rows = counts.sum(0)
        if spec.draw:
            rng = np.random.default_rng((spec.seed, number))
            found = [_drawn_alike(spec, c, rng) for c in counts]
            rows, counts = None if found[0][0] is None else sum(r for r, _ in found), np.stack([d for _, d in found])
        gs = [c * w for c, w in zip(counts, weights)]
        return sum(gs), gs, rows
    # The derivative as if all were of other classes, less the rows that are of the class.
    own, other = (1, 0.0) if spec.margins == 1 else (number % spec.per_round, -1.0)
    g, h = _derivatives(spec, np.full(counts.shape[1], other), margin, weights @ counts, own)
    return h, [g - weights[own] * counts[own]], counts.sum(0)


def _summed(x: np.ndarray, node: np.ndarray, nodes: list[int], h: np.ndarray, gs: list[np.ndarray], bins: int, rows: np.ndarray | None = None) -> np.ndarray:
    """(nodes, 2 + outputs, columns, bins) over rows whose leaf is one of `nodes`."""
    slot = np.full(int(max(node.max(initial=0), max(nodes))) + 1, -1)
    slot[nodes] = np.arange(len(nodes))
    at = slot[node]
    here = np.flatnonzero((at >= 0) & (h > 0))
    out = np.zeros((len(nodes), 2 + len(gs), x.shape[1], bins))
    base, weights = at[here] * bins, [None if rows is None else rows[here], h[here], *[g[here] for g in gs]]
    size = len(nodes) * bins
    for c in range(x.shape[1]):
        place = base + x[here, c]
        for k, w in enumerate(weights):
            out[:, k, c] = np.bincount(place, w, size).reshape(len(nodes), bins)
    return out


class _Growing:
    """A tree that grows over rows at hand. Rows leave once their node is split no further. Of two children the one of more rows
    has the sums of the parent without those of the other; a tree that tries few columns at a node sums up only these, if that is less work."""

    def __init__(self, spec: Spec, number: int, tree: Tree, packs: _Packs, h: np.ndarray, gs: list[np.ndarray], rows: np.ndarray | None):
        self.spec, self.number, self.tree, self.packs, self.node = spec, number, tree, packs, np.zeros(len(h), np.int32)
        # Planes that follow from others are not summed up: H is the sum of the classes of a forest, or the number of rows.
        self.added, self.few = spec.kind == "forest" and spec.task == "classification", columns_tried(spec, packs.x.shape[1])
        self.same = rows is not None and h is rows
        self.weights = [rows, *gs] if self.added or self.same else [rows, h, *gs]
        self.active = np.flatnonzero(h > 0)
        self.idle = np.flatnonzero(h <= 0) if len(self.active) < len(h) else self.active[:0]
        self.asked: dict[int, np.ndarray] = {}  # sums of the nodes asked for last; best first, of all leaves
        self.members = None if spec.leaves is None else {0: self.active}  # best first, the rows of each leaf

    def step(self) -> None:
        """Move active rows to the children of nodes split since."""
        tree, x = self.tree, self.packs.x
        if self.members is not None:
            for n in [n for n in self.members if tree.column[n] >= 0]:
                rows, at = self.members.pop(n), tree.left[n]
                right = x[rows, tree.column[n]] > tree.cut[n]
                self.members |= {at: rows[~right], at + 1: rows[right]}
                self.node[rows] = at + right
            return
        column, cut, left = np.array(tree.column), np.array(tree.cut), np.array(tree.left)
        here = self.node.take(self.active)
        split = column.take(here) >= 0
        if not split.all():
            self.active, here = self.active[split], here[split]
        self.node[self.active] = left.take(here) + (self.packs.at(self.active, column.take(here)) > cut.take(here))

    def sums(self, nodes: list[int]) -> np.ndarray:
        if nodes != [0]:
            self.step()
        slot = np.full(len(self.tree.column), -1)
        slot[nodes] = np.arange(len(nodes))
        if self.members is not None:
            rows = np.concatenate([self.members[n] for n in nodes])
            at = np.repeat(np.arange(len(nodes)), [len(self.members[n]) for n in nodes])
        else:
            at = slot.take(self.node.take(self.active))
            some = at >= 0
            rows, at = (self.active, at) if some.all() else (self.active[some], at[some])
            self.active = rows
        # All columns take a sum for each pack, over the smaller children only.
        columns = None if self.few >= len(self.packs.packs) / 2 else _tried_at(self.spec, self.packs.x.shape[1], self.number, self.tree, nodes)
        if columns is not None:
            return self._whole(self.packs.tried(rows, at, columns, self.weights))
        # (child of fewer rows, its sibling, sums of both): these follow from the parent's.
        counts, known = np.bincount(at, minlength=len(nodes)), []
        for parent, sums in self.asked.items():
            a = slot[self.tree.left[parent]] if self.tree.column[parent] >= 0 else -1
            b = slot[self.tree.left[parent] + 1] if a >= 0 else -1
            if b >= 0:
                known.append((a, b, sums) if counts[a] <= counts[b] else (b, a, sums))
        direct = np.ones(len(nodes), bool)
        direct[[b for _, b, _ in known]] = False
        out = np.zeros((len(nodes), len(self.weights), self.packs.x.shape[1], self.packs.bins))
        if known:
            some = direct[at]
            rows, at = rows[some], (np.cumsum(direct) - 1)[at[some]]
        out[direct] = self.packs.summed(rows, at, int(direct.sum()), self.weights)
        for a, b, sums in known:
            out[b] = sums - out[a]
        self.asked = ({} if self.members is None else {n: f for n, f in self.asked.items() if self.tree.column[n] < 0}) | dict(zip(nodes, out))
        return self._whole(out)

    def _whole(self, sums: np.ndarray) -> np.ndarray:
        """The sums with those of H."""
        if not (self.added or self.same):
            return sums
        return np.concatenate([sums[:, :1], sums[:, 1:].sum(1, keepdims=True) if self.added else sums[:, :1], sums[:, 1:]], 1)

    def leaves(self) -> np.ndarray:
        """The leaf of every row."""
        self.step()
        self.node[self.idle] = self.tree.nodes(self.packs.x[self.idle])
        return self.node


class _Packs:
    """Bins of rows at hand, and columns packed into numbers below PACKED: what is summed up by these gives the sums of each column."""

    def __init__(self, x: np.ndarray, bins: int):
        self.x, self.bins, self.packs = np.asfortranarray(x), bins, []
        self.flat = self.x.ravel("F")
        sizes = [int(c.max(initial=0)) + 1 for c in self.x.T]
        for c in sorted(range(len(sizes)), key=sizes.__getitem__):
            if not self.packs or np.prod([sizes[i] for i in self.packs[-1]]) * sizes[c] > PACKED:
                self.packs.append([])
            self.packs[-1].append(c)
        self.sizes = [[sizes[c] for c in p] for p in self.packs]
        self.places = [np.ravel_multi_index([self.x[:, c] for c in p], n).astype(np.int64) for p, n in zip(self.packs, self.sizes)]

    def at(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        return self.flat.take(columns * len(self.x) + rows)

    def summed(self, rows: np.ndarray, at: np.ndarray, nodes: int, weights: list[np.ndarray | None]) -> np.ndarray:
        """(nodes, weights, columns, bins) of rows whose node is `at`; weights of None are 1."""
        every = len(rows) == len(self.x)
        given = [w if w is None or every else w.take(rows) for w in weights]
        out = np.zeros((nodes, len(weights), self.x.shape[1], self.bins))
        for pack, sizes, place in zip(self.packs, self.sizes, self.places):
            size = int(np.prod(sizes))
            if len(pack) > 1 and nodes * size > max(8 * PACKED, len(rows)):
                # Each column for itself.
                for c, n in zip(pack, sizes):
                    place = at * n + self.x[rows, c]
                    for k, w in enumerate(given):
                        out[:, k, c, :n] = np.bincount(place, w, nodes * n).reshape(nodes, n)
                continue
            place = place if every else place.take(rows)
            place = place if nodes == 1 else place + at * size
            for k, w in enumerate(given):
                found = np.bincount(place, w, nodes * size).reshape(nodes, *sizes)
                for i, (c, n) in enumerate(zip(pack, sizes)):
                    out[:, k, c, :n] = found.sum(tuple(j + 1 for j in range(len(pack)) if j != i)) if len(pack) > 1 else found
        return out

    def tried(self, rows: np.ndarray, at: np.ndarray, columns: np.ndarray, weights: list[np.ndarray | None]) -> np.ndarray:
        """(nodes, weights, tried, bins): the same by the columns that each node tries."""
        nodes, few = columns.shape
        out = np.zeros((nodes, len(weights), few, self.bins))
        given = [w if w is None else w.take(rows) for w in weights]
        for j in range(few):
            place = at * self.bins + self.at(rows, columns[:, j].take(at))
            for k, w in enumerate(given):
                out[:, k, j] = np.bincount(place, w, nodes * self.bins).reshape(nodes, self.bins)
        return out


def _merged(x: np.ndarray, y: np.ndarray, rows: np.ndarray, spread: np.ndarray | None, classes: int = 0) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray | None]:
    """Rows of equal bins as one: folds that are fitted together need no rows of their own. For values with their mean label,
    number and variance; for classes with the number of each."""
    flat = np.ascontiguousarray(x).view(f"V{x.shape[1]}")[:, 0]
    _, first, at = np.unique(flat, return_index=True, return_inverse=True)
    if classes:
        return x[first], None, np.stack([np.bincount(at, rows * (y == k), len(first)) for k in range(classes)]), None
    n = np.bincount(at, rows)
    mean = np.bincount(at, rows * y) / n
    return x[first], mean, n, np.bincount(at, rows * (spread + (y - mean[at]) ** 2)) / n


def fit_here(spec: Spec, x: np.ndarray, y: np.ndarray, key: np.ndarray | None, fold: np.ndarray, bins: int = BINS, rows: np.ndarray | None = None, spread: np.ndarray | None = None) -> list[Tree]:
    """Grow a model over rows at hand; `rows` says how many each of them stands for, `spread` the variance of their labels."""
    some = np.ones(len(x), bool) if spec.fold is None else fold != spec.fold
    x, y, key = x[some], y[some].astype(float), None if key is None else key[some]
    if rows is not None:
        spread = np.zeros(len(x)) if spread is None else spread[some]
        x, y, rows, spread = _merged(x, y, rows[some].astype(float), spread, spec.classes if spec.task == "classification" else 0)
    packs = _Packs(x, bins)
    model = _model(spec, x.shape[1])
    margin = np.zeros((len(x), spec.margins))
    held: dict[int, _Growing] = {}  # the trees that grow
    asked = next(model)
    while True:
        send = None
        if asked is None:  # a round is done
            for i, growing in enumerate(held.values()):
                if spec.kind == "boost":
                    margin[:, i] += np.array([v[0] for v in growing.tree.value])[growing.leaves()]
            held = {}
        else:
            send = []
            for s in asked:
                if s.number not in held:
                    held[s.number] = _Growing(spec, s.number, s.tree, packs, *_targets(spec, y, margin, key, s.number, rows, spread))
                send.append(held[s.number].sums(s.nodes))
        try:
            asked = model.send(send)
        except StopIteration as end:
            return end.value


def shared(specs: Sequence[Spec]) -> list[list[int]]:
    """The numbers of the settings, those of forests that share their trees together."""
    groups: dict[object, list[int]] = {}
    for i, s in enumerate(specs):
        alike = s.kind == "forest" and s.paths and s.leaves is None
        groups.setdefault(replace(s, trees=0, depth=0, least_split=0) if alike else i, []).append(i)
    return list(groups.values())


def largest(specs: Sequence[Spec]) -> Spec:
    """The forest out of which those of all these settings are cut."""
    return replace(specs[0], trees=max(s.trees for s in specs), depth=max(s.depth for s in specs), least_split=min(s.least_split for s in specs))


def _margins_together(specs: Sequence[Spec], grow: Callable[[Spec], list[Tree]], x: np.ndarray) -> np.ndarray:
    """(specs, rows, margins): what `predicted` gives for forests that share their trees, which `grow` gives in parts."""
    out, number = np.zeros((len(specs), len(x), specs[0].margins)), 0
    while mine := [i for i, s in enumerate(specs) if s.trees > number]:
        part = largest([specs[i] for i in mine])
        for t in grow(replace(part, first=part.first + number, trees=min(TOGETHER, part.trees - number))):
            leaf, value, parent, level = t.nodes(x), np.stack(t.value), np.array(t.parent), np.array(t.level)
            some = [i for i in mine if specs[i].trees > number]
            # The node at which each setting ends: that of the parent, if it ends there or above.
            ends = t.ends([specs[i] for i in some])
            stop = np.tile(np.arange(len(level)), (len(some), 1))
            for at in range(1, level.max() + 1):
                here = np.flatnonzero(level == at)
                up = parent[here]
                stop[:, here] = np.where(ends[:, up] | (stop[:, up] != up), stop[:, up], here)
            for i, nodes in zip(some, stop):
                out[i] += (value[nodes] / specs[i].trees).take(leaf, 0)
            number += 1
    return out


def forest_here(spec: Spec, x: np.ndarray, y: np.ndarray, key: np.ndarray, asked: np.ndarray, most: int = BESIDE_ROWS) -> np.ndarray:
    """(asked rows, classes): what `predicted` gives for the forest that `fit_here` grows, for tables of few rows.

    There the calls cost more than the sums, so its trees grow side by side, level by level, over sorted rows.
    """
    beside, out = max(1, most // max(len(x), 1)), np.zeros((len(asked), spec.classes))
    for first in range(spec.first, spec.first + spec.trees, beside):
        numbers = np.arange(first, min(first + beside, spec.first + spec.trees))
        column, cut, left, value = _grown_beside(spec, x, y.astype(int), key, numbers)
        at = np.repeat(np.arange(len(numbers))[:, None], len(asked), 1)
        rows = np.arange(len(asked))
        for _ in range(spec.depth):
            inner = column[at] >= 0
            at = np.where(inner, left[at] + (asked[rows, np.maximum(column[at], 0)] > cut[at]), at)
        for one in value[at]:
            out += one / spec.trees
    return out


def _grown_beside(spec: Spec, x: np.ndarray, y: np.ndarray, key: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, ...]:
    """(column, cut, left, value) of the nodes of these trees of a forest for classes, the roots first."""
    (n, width), classes = x.shape, np.arange(spec.classes)
    weights = np.array(spec.class_weights or [1.0] * spec.classes)[:, None]
    draws = drawn(key, spec.seed, numbers) if spec.draw else np.ones((len(numbers), n))
    slot, row = np.nonzero(draws)
    times = draws[slot, row]
    # Of the nodes of a level: how often each class is drawn, rows, tree and number in it.
    held = np.stack([np.bincount(slot, times * (y[row] == k), len(numbers)) for k in classes])
    count, tree, number = np.bincount(slot, minlength=len(numbers)), np.arange(len(numbers)), np.zeros(len(numbers), np.int64)
    sizes, start, parts = np.ones(len(numbers), np.int64), 0, []
    for depth in range(spec.depth + 1):
        weighted = held * weights
        h, here = weighted.sum(0), len(count)
        column, cut, left = np.full(here, -1), np.zeros(here, np.int64), np.zeros(here, np.int64)
        parts.append((column, cut, left, (weighted / np.maximum(h, 1e-300)).T))
        some = (count >= max(spec.least_split, 2 * spec.least_rows)) & (h >= 2 * spec.least_weight) & (weighted.max(0) < h * (1 - 1e-12))
        if depth == 0:
            some[:] = count > 0
        here = np.flatnonzero(some[slot])
        if depth == spec.depth or not len(here):
            break
        nodes = np.flatnonzero(some)
        slot, row, times = (np.cumsum(some) - 1)[slot[here]], row[here], times[here]
        tried = _tried(spec, width, numbers[tree[nodes]], number[nodes])
        tried = np.broadcast_to(np.arange(width), (len(nodes), width)) if tried is None else tried
        few = tried.shape[1]
        place = np.concatenate([(slot * few + j) * BINS + x[row, tried[slot, j]] for j in range(few)]).astype(np.int32)
        order = np.argsort(place)
        place, entry = place[order], order % len(slot)
        summed = np.stack([np.cumsum((times * (y[row] == k))[entry]) for k in classes])
        # The last row of each bin; the last bin of a node's column has nothing to its right.
        ends = np.flatnonzero(np.append(place[1:] != place[:-1], True))
        pair = place[ends] // BINS
        last = np.append(pair[1:] != pair[:-1], True)
        total, rows = summed[:, ends[last]], ends[last] + 1
        before, rows_before = np.hstack([np.zeros_like(total[:, :1]), total[:, :-1]]), np.append(0, rows[:-1])
        ends, pair = ends[~last], pair[~last]
        if not len(ends):
            break
        lower, upper = summed[:, ends] - before[:, pair], total[:, pair] - summed[:, ends]
        whole = (total - before)[:, ::few]

        def score(side: np.ndarray) -> np.ndarray:
            side = side * weights
            return (side**2).sum(0) / np.maximum(side.sum(0) + spec.penalty, 1e-300)

        at, was = pair // few, score(whole)
        gain = score(lower) + score(upper) - was[at]
        fewest = np.minimum(ends + 1 - rows_before[pair], rows[pair] - ends - 1)
        gain[(fewest < max(spec.least_rows, 1)) | (np.minimum((lower * weights).sum(0), (upper * weights).sum(0)) < spec.least_weight)] = 0.0
        firsts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        top = np.zeros(len(nodes))
        top[at[firsts]] = np.maximum.reduceat(gain, firsts)
        # Gains that differ by rounding only count as equal: the first column and bin.
        best = np.flatnonzero((gain >= top[at] * (1 - 1e-9)) & (top > 1e-9 * np.maximum(1.0, was))[at])
        best = best[np.append(True, at[best][1:] != at[best][:-1])] if len(best) else best
        split, j = at[best], pair[best] % few
        start += len(count)
        column[nodes[split]], cut[nodes[split]] = tried[split, j], place[ends[best]] % BINS
        left[nodes[split]] = start + 2 * np.arange(len(split))
        child = np.full(len(nodes), -1)
        child[split] = 2 * np.arange(len(split))
        going = np.flatnonzero(child[slot] >= 0)
        slot, row, times = slot[going], row[going], times[going]
        slot = child[slot] + (x[row, column[nodes[slot]]] > cut[nodes[slot]])
        held = np.stack([lower[:, best], upper[:, best]], 2).reshape(spec.classes, -1)
        count = np.bincount(slot, minlength=2 * len(best))
        mine = tree[nodes[split]]
        rank = np.arange(len(split)) - np.searchsorted(mine, mine)
        first = 2 * number[nodes[split]] + 1 if spec.paths else sizes[mine] + 2 * rank
        number = (first[:, None] + np.arange(2)).ravel()
        sizes += 2 * np.bincount(mine, minlength=len(numbers))
        tree = np.repeat(mine, 2)
    return tuple(np.concatenate([p[i] for p in parts]) for i in range(4))


def predicted(spec: Spec, trees: list[Tree], x: np.ndarray) -> np.ndarray:
    """(rows, margins): summed margins of boosting, or the mean value of a forest's trees."""
    out = np.zeros((len(x), spec.margins))
    for i, t in enumerate(trees):
        value = np.stack(t.value).take(t.nodes(x), 0)
        if spec.kind == "boost":
            out[:, i % spec.per_round] += value[:, 0]
        else:
            out += value / len(trees)
    return out


def decided(spec: Spec, margin: np.ndarray) -> np.ndarray:
    """Class numbers, or values."""
    if spec.task == "regression":
        return margin[:, 0]
    return (margin[:, 0] > 0).astype(float) if spec.margins == 1 else margin.argmax(1).astype(float)


def likely(spec: Spec, margin: np.ndarray) -> np.ndarray:
    """(rows, classes): the probability of each class."""
    if spec.kind == "forest":
        return margin / np.maximum(margin.sum(1, keepdims=True), 1e-300)
    if spec.margins == 1:
        p = 1.0 / (1.0 + np.exp(-margin))
        return np.hstack([1 - p, p])
    e = np.exp(margin - margin.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def scored(spec: Spec, y: np.ndarray, found: np.ndarray, rows: np.ndarray | None = None, spread: np.ndarray | None = None) -> np.ndarray:
    """Sums from which the metrics follow: the confusion counts, or (n, y, y^2, squared error, absolute error).

    Rows that stand for several with a mean label leave no absolute error.
    """
    if spec.task == "classification":
        return np.bincount((y * spec.classes + found).astype(int), rows, spec.classes**2).astype(float)
    e = y - found
    if rows is not None:
        return np.array([rows.sum(), rows @ y, rows @ (y**2 + spread), rows @ (e**2 + spread), np.nan])
    return np.array([len(y), y.sum(), (y**2).sum(), (e**2).sum(), np.abs(e).sum()])


def metrics(spec: Spec, sums: np.ndarray) -> dict[str, float]:
    if spec.task == "classification":
        table = sums.reshape(spec.classes, spec.classes)
        n, right = table.sum(), np.diag(table)
        with np.errstate(invalid="ignore", divide="ignore"):
            f = np.where(table.sum(0) + table.sum(1) > 0, 2 * right / (table.sum(0) + table.sum(1)), 0.0)
        return {"accuracy": float(right.sum() / n), "f1": float((f * table.sum(1)).sum() / n)} if n else {"accuracy": float("nan"), "f1": float("nan")}
    n, s, ss, se, ae = sums
    spread = ss - s * s / n if n else 0.0
    return {"r2": float(1 - se / spread) if spread > 0 else 0.0, "rmse": float(np.sqrt(se / n)), "mae": float(ae / n)}


@dataclass
class Binned:
    """A written table (key, hash, fold, label, bins) and the values that cut its columns."""

    table: DataFrame
    cuts: list[np.ndarray]
    rows: int

    @property
    def width(self) -> int:
        return len(self.cuts)

    @property
    def bins(self) -> int:
        return max([len(c) for c in self.cuts], default=0) + 1


def cut_up(values: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """The bins of values, column by column."""
    x = np.empty(values.shape, np.uint8)
    for i, c in enumerate(cuts):
        x[:, i] = np.searchsorted(c, values[:, i], "left")
    return x


def binned(data: DataFrame, width: int, bins: int = BINS) -> Binned:
    """`data` (key, label, features, fold) with each feature cut at up to `bins` - 1 of its values; x <= cut goes left."""
    flat = data.select("key", "label", "fold", vector_to_array("features").alias("v"))
    shares = [i / bins for i in range(1, bins)]
    row = flat.agg(F.count("*").alias("n"), *[F.percentile_approx(F.col("v")[i], shares, 20_000).alias(f"q{i}") for i in range(width)], *[F.max(F.col("v")[i]).alias(f"m{i}") for i in range(width)]).first()
    cuts = []
    for i in range(width):
        values = np.unique(np.array(row[f"q{i}"] or [], float))
        cuts.append(values[values < row[f"m{i}"]] if len(values) else values)  # nothing lies beyond the largest value

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            x = cut_up(np.asarray(b.column("v").flatten()).reshape(n, width), cuts)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), n, [None, pa.py_buffer(x.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("hash"), b.column("fold"), b.column("label"), packed], ["key", "hash", "fold", "label", "bins"])

    kind = data.schema["key"].dataType.simpleString()
    keyed = flat.select("key", F.xxhash64("key", F.lit(42)).alias("hash"), F.col("fold").cast("int"), F.col("label").cast("double"), "v")
    return Binned(checkpoint(keyed.mapInArrow(cut, f"key {kind}, hash long, fold int, label double, bins binary")), cuts, row["n"])


def _arrays(b: pa.RecordBatch | pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]:
    """bins, label, hash (None: there is none), fold."""
    column = b.column("bins")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    raw = b"".join(column.to_pylist())
    x = np.frombuffer(raw, np.uint8).reshape(b.num_rows, width)
    key = np.asarray(b.column("hash")).astype(np.int64).view(np.uint64) if "hash" in b.schema.names else None
    return x, np.asarray(b.column("label"), float), key, np.asarray(b.column("fold")).astype(int)


def _alike(data: Binned, specs: Sequence[Spec], most_sent: int) -> DataFrame | None:
    """(fold, label, bins, rows): rows of equal bins and fold as one, if few enough are left; for values with the `spread` of their labels."""
    # A mean label gives the gradient of squares only.
    by = ["fold", "bins"] + (["label"] if any(s.task == "classification" for s in specs) else [])
    label = [] if "label" in by else [F.avg("label").alias("label"), F.var_pop("label").alias("spread")]
    found = checkpoint(data.table.groupBy(*by).agg(F.count("*").alias("rows"), *label))
    # As _narrow packs them: a class takes up to 4 bytes.
    return found if found.count() * (data.width + 8 + (4 if "label" in by else 16)) <= most_sent else None


def _narrow(numbers: np.ndarray) -> np.ndarray:
    """Whole numbers in as few bytes as they need."""
    top = numbers.max(initial=0)
    return numbers.astype(np.min_scalar_type(int(top))) if numbers.min(initial=0) >= 0 and (numbers == np.floor(numbers)).all() else numbers


def fit_many(data: Binned, specs: Sequence[Spec], give: str = "sums", most_sent: int = MOST_SENT, alike_from: int = ALIKE_FROM, most_alike: int = MOST_ALIKE) -> list:
    """Fit all models. `sums` gives what scores each on the rows of its fold (all rows without one), `squares` the same, perhaps
    without the absolute errors, `trees` the trees themselves.

    A table of up to `most_sent` bytes of bins is sent to all tasks, and each of these fits some models. So are the sums of rows
    alike, from `alike_from` rows on and up to `most_alike` bytes; else all models grow in lock step over passes of the table.
    """
    specs = list(specs)
    too_large = data.rows * (data.width + 17) > most_sent
    alike = _alike(data, specs, min(most_alike, 2 * most_sent)) if too_large or data.rows >= alike_from else None
    if alike is None and not too_large:
        return _fit_by_tasks(data, None, specs, "sums" if give == "squares" else give)
    if alike is not None and (give != "sums" or all(s.task == "classification" for s in specs)):
        return _fit_by_tasks(data, alike, specs, give)
    grown = _fit_by_passes(data, specs) if alike is None else _fit_by_tasks(data, alike, specs, "trees")
    return grown if give == "trees" else [_scored_by_pass(data, [s], [t])[0] for s, t in zip(specs, grown)]


def _parts(specs: Sequence[Spec], tasks: int) -> list[tuple[int, Spec]]:
    """The models by number; forests that are dear beside a task's share in parts, whose trees follow each other."""
    cost = [s.trees * s.depth for s in specs]
    out = []
    for i, s in enumerate(specs):
        pieces = min(s.trees, -(-cost[i] * tasks // max(sum(cost), 1))) if s.kind == "forest" else 1
        ends = [s.trees * k // max(pieces, 1) for k in range(max(pieces, 1) + 1)]
        out += [(i, replace(s, first=s.first + a, trees=b - a)) for a, b in zip(ends, ends[1:])]
    return out


def _fit_by_tasks(data: Binned, alike: DataFrame | None, specs: list[Spec], give: str) -> list:
    """Send the table, or the sums of rows alike, to all tasks, and fit one model, or a part of a forest, in each."""
    spark, width, bins = data.table.sparkSession, data.width, data.bins
    # In a fixed order, so that sums are added up alike.
    if alike is None:
        found = data.table.select("hash", "fold", "label", "bins").orderBy("hash", "label", "bins", "fold").toArrow()
        sent = spark.sparkContext.broadcast((*_arrays(found, width), None, None))
    else:
        found = alike.orderBy("bins", "label", "fold").toArrow()
        x, y, _, fold = _arrays(found, width)
        spread = np.asarray(found.column("spread"), float) if "spread" in alike.columns else None
        sent = spark.sparkContext.broadcast((x, _narrow(y), None, _narrow(fold), _narrow(np.asarray(found.column("rows"))), spread))
    del found
    groups = [g for g in shared(specs) if len(g) > 1] if give != "trees" else []
    together = {i for g in groups for i in g}
    alone = [i for i in range(len(specs)) if i not in together]
    parts = [(alone[i], s) for i, s in _parts([specs[i] for i in alone], 4 * spark.sparkContext.defaultParallelism)]
    whole = {i for i in range(len(specs)) if sum(j == i for j, _ in parts) == 1}

    def score(specs: list[Spec], found: Callable[[np.ndarray], Sequence[np.ndarray]]) -> list[np.ndarray]:
        x, y, _, fold, rows, spread = sent.value
        held = np.ones(len(x), bool) if specs[0].fold is None else fold == specs[0].fold
        more = (None, None) if rows is None else (rows[held].astype(float), spread if spread is None else spread[held])
        return [scored(s, y[held].astype(float), decided(s, margin), *more) for s, margin in zip(specs, found(x[held]))]

    def fit(job: int) -> list[Tree] | np.ndarray | list[np.ndarray]:
        if job >= len(parts):
            mine = [specs[i] for i in groups[job - len(parts)]]
            return score(mine, lambda x: _margins_together(mine, lambda s: fit_here(s, *sent.value[:4], bins, *sent.value[4:]), x))
        i, spec = parts[job]
        trees = fit_here(spec, *sent.value[:4], bins, *sent.value[4:])
        return trees if give == "trees" or i not in whole else score([spec], lambda x: [predicted(spec, trees, x)])[0]

    # The dearest first, one in a task.
    dear = [s for _, s in parts] + [largest([specs[i] for i in g]) for g in groups]
    found = _dealt(spark, sorted(range(len(dear)), key=lambda j: -dear[j].trees * dear[j].depth), fit)
    grown: dict[int, list] = {i: x for k, g in enumerate(groups) for i, x in zip(g, found[len(parts) + k])}
    for j, (i, _) in enumerate(parts):
        grown[i] = found[j] if i in whole else grown.get(i, []) + found[j]
    rest = [i for i in alone if i not in whole]
    if rest and give != "trees":
        forests = spark.sparkContext.broadcast({i: grown[i] for i in rest})
        grown |= _dealt(spark, rest, lambda i: score([specs[i]], lambda x: [predicted(specs[i], forests.value[i], x)])[0])
    return [grown[i] for i in range(len(specs))]


def _dealt(spark, jobs: Sequence[int], work: Callable[[int], object]) -> dict[int, object]:
    """What `work` gives for each job; each is one task, in this order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for j in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([j], pa.int64()), pa.array([pickle.dumps(work(j))], pa.binary())], ["id", "found"])

    table = spark.createDataFrame([(j, at) for at, j in enumerate(jobs)], "id long, at int").repartitionByRange(len(jobs), "at")
    return {r["id"]: pickle.loads(r["found"]) for r in table.select("id").mapInArrow(run, "id long, found binary").collect()}


def _fit_by_passes(data: Binned, specs: list[Spec]) -> list[list[Tree]]:
    """Grow all models in lock step; a pass gives the sums that they ask for, up to MOST_SUMS bytes of them."""
    groups = shared(specs)
    if len(groups) < len(specs):
        grown = _fit_by_passes(data, [largest([specs[i] for i in g]) for g in groups])
        found = {i: [t.pruned(specs[i]) for t in trees[: specs[i].trees]] if len(g) > 1 else trees for g, trees in zip(groups, grown) for i in g}
        return [found[i] for i in range(len(specs))]
    width, bins = data.width, data.bins
    models = [_model(s, width, BESIDE) for s in specs]
    asked: dict[int, list[Sums] | None] = {i: next(m) for i, m in enumerate(models)}
    growing: dict[int, dict[int, Tree]] = {i: {} for i in asked}
    done: dict[int, list[Tree]] = {}
    boosted = {i: 0 for i, s in enumerate(specs) if s.kind == "boost"}
    margins = 0
    for i in boosted:
        boosted[i], margins = margins, margins + specs[i].margins
    table = data.table.select("hash", "fold", "label", "bins")
    if margins:
        table = table.withColumn("margin", F.lit(None).cast("binary"))
    while asked:
        ended = [i for i, a in asked.items() if a is None]
        new = [(specs[i], boosted[i], [t for _, t in sorted(growing[i].items())]) for i in ended if i in boosted]
        if new:
            table = checkpoint(table.mapInArrow(_advanced(new, margins, width), table.schema))
        for i in ended:
            growing[i] = {}
            _next(models[i], None, i, asked, done)
        wanted = [(i, s) for i, a in asked.items() if a is not None for s in a]
        found: dict[tuple[int, int], np.ndarray] = {}
        while wanted:
            some, size = [], 0
            while wanted and (not some or size < MOST_SUMS):
                i, s = wanted.pop()
                some.append((i, specs[i], boosted.get(i, 0), s))
                growing[i][s.number] = s.tree
                size += len(s.nodes) * width * bins * (2 + specs[i].outputs) * 8
            found |= _pass(table, some, margins, width, bins)
        for i in [i for i, a in asked.items() if a is not None]:
            _next(models[i], [found[i, s.number] for s in asked[i]], i, asked, done)
    return [done[i] for i in range(len(specs))]


def _next(model: Generator, send, i: int, asked: dict, done: dict) -> None:
    try:
        asked[i] = model.send(send)
    except StopIteration as end:
        done[i] = end.value
        asked.pop(i)


def _advanced(new: list[tuple[Spec, int, list[Tree]]], margins: int, width: int):
    """Add a round's trees to the margins, which stand in one binary of float64 for each row."""

    def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, *_ = _arrays(b, width)
            margin = _margins(b, margins).copy()
            for _, at, trees in new:
                for i, t in enumerate(trees):
                    margin[:, at + i] += np.array([v[0] for v in t.value])[t.nodes(x)]
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * margins), b.num_rows, [None, pa.py_buffer(margin.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in ("hash", "fold", "label", "bins")], raw], ["hash", "fold", "label", "bins", "margin"])

    return advance


def _margins(b: pa.RecordBatch, n: int) -> np.ndarray:
    """The margins of the rows, 0 before the first round."""
    if not n or b.column("margin").null_count:
        return np.zeros((b.num_rows, n))
    return np.frombuffer(b"".join(b.column("margin").to_pylist()), float).reshape(b.num_rows, n)


def _gathered(batches: Iterator[pa.RecordBatch], least: int = PASS_ROWS) -> Iterator[pa.Table]:
    """Batches put together: the sums of a tree are as large for few rows as for many."""
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= least:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def _summed_tried(x: np.ndarray, node: np.ndarray, nodes: list[int], columns: np.ndarray, h: np.ndarray, gs: list[np.ndarray], bins: int) -> np.ndarray:
    """(nodes, 2 + outputs, tried, bins): what `_summed` gives, by the columns that each node tries."""
    slot = np.full(int(max(node.max(initial=0), max(nodes))) + 1, -1)
    slot[nodes] = np.arange(len(nodes))
    at = slot.take(node)
    here = np.flatnonzero((at >= 0) & (h > 0))
    at, weights = at.take(here), [None, h.take(here), *[g.take(here) for g in gs]]
    out = np.zeros((len(nodes), len(weights), columns.shape[1], bins))
    for j in range(columns.shape[1]):
        place = at * bins + x[here, columns[:, j].take(at)]
        for k, w in enumerate(weights):
            out[:, k, j] = np.bincount(place, w, len(nodes) * bins).reshape(len(nodes), bins)
    return out


def _pass(table: DataFrame, asked: list[tuple[int, Spec, int, Sums]], margins: int, width: int, bins: int) -> dict[tuple[int, int], np.ndarray]:
    tried = [_tried_at(spec, width, s.number, s.tree, s.nodes) for _, spec, _, s in asked]
    sent = table.sparkSession.sparkContext.broadcast([(*a, c) for a, c in zip(asked, tried)])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in _gathered(batches):
            x, y, key, fold = _arrays(b, width)
            margin = _margins(b, margins)
            for i, spec, at, s, columns in sent.value:
                some = slice(None) if spec.fold is None else fold != spec.fold
                h, gs, _ = _targets(spec, y[some], margin[some, at : at + spec.margins], key[some], s.number)
                node = s.tree.nodes(x[some])
                got = _summed(x[some], node, s.nodes, h, gs, bins) if columns is None else _summed_tried(x[some], node, s.nodes, columns, h, gs, bins)
                sums[i, s.number] = sums[i, s.number] + got if (i, s.number) in sums else got
        if sums:
            columns = [pa.array([k[0] for k in sums], pa.int64()), pa.array([k[1] for k in sums], pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["model", "tree", "sums"])

    def added(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(r, float) for r in rows.column("sums").to_pylist())
        return pa.table({"model": rows.column("model").slice(0, 1), "tree": rows.column("tree").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    kind = "model long, tree long, sums binary"
    shape = {(i, s.number): (len(s.nodes), 2 + spec.outputs, width if c is None else c.shape[1], bins) for (i, spec, _, s), c in zip(asked, tried)}
    out = {k: np.zeros(size) for k, size in shape.items()}
    for r in table.mapInArrow(part, kind).groupBy("model", "tree").applyInArrow(added, kind).collect():
        at = r["model"], r["tree"]
        out[at] = np.frombuffer(r["sums"], float).reshape(shape[at])
    sent.unpersist()
    return out


def predictions(data: Binned, spec: Spec, trees: list[Tree]) -> DataFrame:
    """(key, label, fold, prediction) of all rows."""
    sent, width = data.table.sparkSession.sparkContext.broadcast(trees), data.width

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _gathered(batches):
            x, *_ = _arrays(b, width)
            found = decided(spec, predicted(spec, sent.value, x))
            yield from b.select(["key", "label", "fold"]).append_column("prediction", pa.array(found, pa.float64())).combine_chunks().to_batches()

    kind = data.table.schema["key"].dataType.simpleString()
    return data.table.mapInArrow(predict, f"key {kind}, label double, fold int, prediction double")


def _scored_by_pass(data: Binned, specs: list[Spec], trees: list[list[Tree]]) -> list[np.ndarray]:
    out = []
    for spec, mine in zip(specs, trees):
        held = data if spec.fold is None else replace(data, table=data.table.where(F.col("fold") == spec.fold))
        found = predictions(held, spec, mine)
        if spec.task == "classification":
            counts = found.groupBy("label", "prediction").agg(F.count("*").alias("n")).collect()
            table = np.zeros(spec.classes**2)
            for r in counts:
                table[int(r["label"]) * spec.classes + int(r["prediction"])] = r["n"]
            out.append(table)
        else:
            e, y = F.col("label") - F.col("prediction"), F.col("label")
            out.append(np.array([float(v or 0) for v in found.agg(F.count("*"), F.sum(y), F.sum(y * y), F.sum(e * e), F.sum(F.abs(e))).first()]))
    return out


def cross_validated(data: Binned, specs: Sequence[Spec], folds: int, metric: str, most_sent: int = MOST_SENT) -> list[float]:
    """The mean of a metric over the folds for each model; all models and folds are fitted together."""
    each = [replace(s, fold=f) for s in specs for f in range(folds)]
    sums = fit_many(data, each, "sums" if metric == "mae" else "squares", most_sent)
    values = [metrics(s, x)[metric] for s, x in zip(each, sums)]
    return [float(np.nanmean(values[i * folds : (i + 1) * folds])) for i in range(len(specs))]
