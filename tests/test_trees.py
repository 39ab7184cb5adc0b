from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from millrace.operators import trees as tr


def table(spark, n=300, classes=2, seed=1):
    draw = np.random.default_rng(seed)
    x = draw.integers(0, 12, (n, 3)).astype(float)
    y = (x[:, 0] > 5).astype(int) + ((x[:, 1] > 6) & (classes > 2)).astype(int)
    y = np.where(draw.random(n) < 0.1, draw.integers(0, classes, n), y)
    frame = pd.DataFrame({"key": np.arange(n), "f0": x[:, 0], "f1": x[:, 1], "f2": x[:, 2], "label": y.astype(float), "fold": np.arange(n) % 5})
    df = VectorAssembler(inputCols=["f0", "f1", "f2"], outputCol="features").transform(spark.createDataFrame(frame))
    return frame, df.select("key", "label", "features", "fold")


def newton(x, g, h, depth, penalty, least, rate):
    """A tree by trying every split, as nested tuples."""
    value = -rate * g.sum() / (h.sum() + penalty)
    if not depth:
        return value
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + penalty)
    best = (1e-9, None)
    for c in range(x.shape[1]):
        for cut in np.unique(x[:, c])[:-1]:
            m = x[:, c] <= cut
            if min(h[m].sum(), h[~m].sum()) < least:
                continue
            gain = score(m) + score(~m) - score(np.ones(len(x), bool))
            if gain > best[0] * (1 + 1e-9):
                best = (gain, (c, cut))
    if best[1] is None:
        return value
    c, cut = best[1]
    m = x[:, c] <= cut
    return c, cut, newton(x[m], g[m], h[m], depth - 1, penalty, least, rate), newton(x[~m], g[~m], h[~m], depth - 1, penalty, least, rate)


def walk(tree, row):
    while isinstance(tree, tuple):
        c, cut, left, right = tree
        tree = left if row[c] <= cut else right
    return tree


def boosted_by_hand(x, y, classes, rounds, depth, rate, penalty=1.0, least=1.0):
    margin = np.zeros((len(x), classes if classes > 2 else 1))
    for _ in range(rounds):
        if classes > 2:
            e = np.exp(margin - margin.max(1, keepdims=True))
            p = e / e.sum(1, keepdims=True)
        else:
            p = 1 / (1 + np.exp(-margin))
        step = np.zeros_like(margin)
        for k in range(margin.shape[1]):
            want = (y == k) if classes > 2 else y
            tree = newton(x, p[:, k] - want, (2 if classes > 2 else 1) * p[:, k] * (1 - p[:, k]), depth, penalty, least, rate)
            step[:, k] = [walk(tree, r) for r in x]
        margin = margin + step
    return margin


@pytest.mark.parametrize("classes", [2, 3])
@pytest.mark.parametrize("most", [10**9, 0])
def test_boosting_equals_newton_trees_by_hand(spark, classes, most):
    frame, df = table(spark, classes=classes)
    spec = tr.Spec("boost", "classification", classes, trees=3, depth=3, rate=0.3)
    data = tr.binned(df, 3)
    (grown,) = tr.fit_many(data, [spec], "trees", most)
    order = data.table.orderBy("key").toArrow()
    got = tr.predicted(spec, grown, tr._arrays(order, 3)[0])
    want = boosted_by_hand(frame[["f0", "f1", "f2"]].to_numpy(), frame["label"].to_numpy(), classes, 3, 3, 0.3)
    assert np.allclose(got, want, atol=1e-9)


def same(a, b):
    return all(x.column == y.column and x.cut == y.cut and np.allclose(x.value, y.value) for p, q in zip(a, b) for x, y in zip(p, q, strict=True))


def test_passes_and_one_task_grow_the_same_trees(spark):
    _, df = table(spark, 200)
    data = tr.binned(df, 3)
    specs = [
        tr.Spec("forest", "classification", trees=3, depth=4, columns="sqrt", fold=1, class_weights=(1.0, 2.0)),
        tr.Spec("forest", "regression", trees=2, depth=3, columns="third", least_split=8),
        tr.Spec("boost", "regression", trees=2, depth=6, rate=0.5, leaves=5, least_rows=4, penalty=0.0, least_weight=1e-3, fold=2),
    ]
    assert same(tr.fit_many(data, specs, "trees"), tr.fit_many(data, specs, "trees", 0))
    for a, b in zip(tr.fit_many(data, specs, "sums"), tr.fit_many(data, specs, "sums", 0)):
        assert np.allclose(a, b)


def test_boosting_needs_no_passes_over_rows_that_are_alike(spark, monkeypatch):
    _, df = table(spark, 3000)
    coarse = df.select("key", "label", "fold", tr.vector_to_array("features").alias("v"))
    few = coarse.select("key", "label", "fold", *[F.floor(F.col("v")[i] / 4).alias(f"f{i}") for i in range(3)])
    data = tr.binned(VectorAssembler(inputCols=["f0", "f1", "f2"], outputCol="features").transform(few), 3)
    each = [
        [tr.Spec("boost", "classification", trees=3, depth=3, fold=1, class_weights=(1.0, 2.0))],
        [tr.Spec("boost", "regression", trees=3, depth=4, rate=0.5, leaves=5, least_rows=40, penalty=0.0, least_weight=1e-3, fold=2)],
    ]
    monkeypatch.setattr(tr, "_fit_by_passes", lambda *a: pytest.fail("passes"))
    for specs in each:
        assert same(tr.fit_many(data, specs, "trees"), tr.fit_many(data, specs, "trees", 10_000))
        for a, b in zip(tr.fit_many(data, specs, "sums"), tr.fit_many(data, specs, "sums", 10_000)):
            assert np.allclose(a, b)


@pytest.mark.parametrize("classes", [2, 3])
def test_rows_alike_of_all_folds_are_sent_in_few_bytes(spark, monkeypatch, classes):
    _, df = table(spark, 3000, classes)
    data = tr.binned(df.withColumn("value", F.col("label")), 3)
    specs = [
        tr.Spec("boost", "classification", classes, trees=3, depth=3, fold=1, class_weights=(1.0, 2.0, 3.0)[:classes]),
        tr.Spec("forest", "classification", classes, trees=2, depth=4, draw=False, columns=2, penalty=0.0, least_weight=0.0, fold=2, class_weights=(1.0, 2.0, 3.0)[:classes]),
    ]
    alike = data.table.select("bins", "label", "fold").distinct().count()
    # Fewer bytes than rows alike took as numbers of 8 bytes, or than the rows themselves.
    most = alike * (data.width + 12) // 2 + 1
    assert most < alike * (data.width + 33) and most < data.rows * (data.width + 17)
    want = tr.fit_many(data, specs, "trees"), tr.fit_many(data, specs, "sums")
    monkeypatch.setattr(tr, "_fit_by_passes", lambda *a: pytest.fail("passes"))
    assert same(want[0], tr.fit_many(data, specs, "trees", most))
    for a, b in zip(want[1], tr.fit_many(data, specs, "sums", most)):
        assert np.allclose(a, b)


@pytest.mark.parametrize("split", [2, 3])
def test_rows_alike_are_drawn_as_often_as_single_rows(split):
    spec = tr.Spec("forest", "classification", least_split=split)
    n = np.repeat([1.0, 4.0, 30.0], 20_000)
    some, draws = tr._drawn_alike(spec, n, np.random.default_rng(3))
    assert (some is None) == (split == 2)
    for size in (1, 4, 30):
        here = draws[n == size]
        assert abs(here.mean() / size - 1) < 0.03 and abs(here.var() / size - 1) < 0.05
        assert abs((here == 0).mean() - np.exp(-size)) < 0.01


def test_best_leaf_first_keeps_to_its_leaves(spark):
    frame, df = table(spark, 400)
    data = tr.binned(df.withColumn("label", F.col("key") % 7 + F.col("label") * 20), 3)
    wide, few = (tr.Spec("boost", "regression", trees=1, depth=9, rate=1.0, leaves=n, penalty=0.0) for n in (400, 4))
    for spec, grown in zip((wide, few), tr.fit_many(data, [wide, few], "trees")):
        assert sum(c < 0 for c in grown[1].column) <= spec.leaves
    # The first split of both is the best one over all rows, and a fit with all leaves is at least as close.
    one, two = tr.fit_many(data, [wide, few], "trees")
    assert (one[1].column[0], one[1].cut[0]) == (two[1].column[0], two[1].cut[0])
    x, y, *_ = tr._arrays(data.table.toArrow(), 3)
    error = [((tr.predicted(s, t, x)[:, 0] - y) ** 2).sum() for s, t in ((wide, one), (few, two))]
    assert error[0] < error[1] < ((y - y.mean()) ** 2).sum()


def test_a_forest_without_drawing_is_one_tree_and_splits_by_gini(spark):
    frame, df = table(spark)
    spec = tr.Spec("forest", "classification", trees=2, depth=1, draw=False)
    (grown,) = tr.fit_many(tr.binned(df, 3), [spec], "trees")
    assert grown[0].column == grown[1].column
    gini = lambda y: len(y) * (1 - ((y == 0).mean() ** 2 + (y == 1).mean() ** 2))
    y, best = frame["label"], []
    for c in range(3):
        for cut in np.unique(frame[f"f{c}"])[:-1]:
            m = frame[f"f{c}"] <= cut
            best.append((gini(y[m]) + gini(y[~m]), c, cut))
    _, c, cut = min(best)
    assert grown[0].column[0] == c and np.unique(frame[f"f{c}"])[grown[0].cut[0]] == cut


def test_folds_and_metrics(spark):
    frame, df = table(spark, 300)
    data = tr.binned(df, 3)
    spec = tr.Spec("forest", "classification", trees=10, depth=4)
    (score,) = tr.cross_validated(data, [spec], 5, "accuracy")
    assert 0.8 < score <= 1.0
    y, p = np.array([0, 0, 1, 2, 2, 2.0]), np.array([0, 1, 1, 2, 2, 0.0])
    three = replace(spec, classes=3)
    got = tr.metrics(three, tr.scored(three, y, p))
    f = [2 * 1 / (2 + 2), 2 * 1 / (1 + 2), 2 * 2 / (3 + 2)]
    assert np.isclose(got["accuracy"], 4 / 6) and np.isclose(got["f1"], (2 * f[0] + f[1] + 3 * f[2]) / 6)
    line = tr.Spec("boost", "regression")
    got = tr.metrics(line, tr.scored(line, y, p))
    assert np.isclose(got["r2"], 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()) and np.isclose(got["mae"], np.abs(y - p).mean())


def test_columns_of_one_value_and_single_rows(spark):
    _, df = table(spark, 20)
    flat = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df.select("key", "label", "fold", F.lit(1.0).alias("a"), F.lit(2.0).alias("b")))
    data = tr.binned(flat.select("key", "label", "features", "fold"), 2)
    for most in (10**9, 0):
        (grown,) = tr.fit_many(data, [tr.Spec("forest", "classification", trees=2)], "trees", most)
        assert [t.column for t in grown] == [[-1], [-1]]


def test_forests_need_no_passes_over_rows_that_are_alike(spark, monkeypatch):
    _, df = table(spark, 3000)
    coarse = df.select("key", "label", "fold", tr.vector_to_array("features").alias("v"))
    few = coarse.select("key", "label", "fold", *[F.floor(F.col("v")[i] / 4).alias(f"f{i}") for i in range(3)])
    data = tr.binned(VectorAssembler(inputCols=["f0", "f1", "f2"], outputCol="features").transform(few), 3)
    monkeypatch.setattr(tr, "_fit_by_passes", lambda *a: pytest.fail("passes"))
    x, y, key, fold = tr._arrays(data.table.toArrow(), 3)
    for task in ("classification", "regression"):
        plain = tr.Spec("forest", task, trees=2, depth=4, draw=False, columns=2, fold=1)
        assert same(tr.fit_many(data, [plain], "trees"), tr.fit_many(data, [plain], "trees", 10_000))
        drawn = tr.Spec("forest", task, trees=60, depth=4, least_split=8, fold=1)
        (one,), (two,) = tr.fit_many(data, [drawn], "trees"), tr.fit_many(data, [drawn], "trees", 10_000)
        assert len(two) == 60 and np.abs(tr.predicted(drawn, one, x) - tr.predicted(drawn, two, x)).max() < 0.03
        # The parts of a forest, grown in other tasks, are the trees of the whole.
        with monkeypatch.context() as m:
            m.setattr(tr, "_parts", lambda specs, tasks: list(enumerate(specs)))
            assert same([two], tr.fit_many(data, [drawn], "trees", 10_000))
            (whole,) = tr.fit_many(data, [drawn], "squares", 10_000)
        (found,) = tr.fit_many(data, [drawn], "squares", 10_000)
        held = fold == 1
        want = tr.scored(drawn, y[held], tr.decided(drawn, tr.predicted(drawn, two, x[held])))
        assert np.allclose(found[:4], want[:4]) and np.allclose(whole[:4], want[:4])


def test_rows_alike_are_drawn_as_often_as_single_rows():
    rng, n = np.random.default_rng(1), np.full(20_000, 7.0)
    some, draws = tr.drawn_together(n, rng)
    assert ((some <= draws) & (some <= n)).all() and ((some == 0) == (draws == 0)).all()
    assert abs(some.mean() - 7 * (1 - np.exp(-1))) < 0.05 and abs(draws.mean() - 7) < 0.1 and abs(draws.var() - 7) < 0.3


def test_parts_of_forests_hold_all_trees():
    specs = [tr.Spec("forest", "regression", trees=120, depth=10), tr.Spec("boost", "regression", trees=120, depth=10), tr.Spec("forest", "regression", trees=1, depth=1)]
    parts = tr._parts(specs, 32)
    assert [t for i, s in parts if i == 0 for t in range(s.first, s.first + s.trees)] == list(range(120))
    assert sum(i == 0 for i, _ in parts) > 10 and sum(i == 1 for i, _ in parts) == sum(i == 2 for i, _ in parts) == 1


def test_a_forest_grown_side_by_side_is_that_grown_tree_by_tree():
    rng = np.random.default_rng(6)
    for n, width, most in ((67, 10, 60_000), (300, 4, 1_000), (20, 1, 60_000)):
        values = rng.normal(0, 1, (n, width)).round(1)
        y = (values[:, 0] + rng.normal(0, 0.5, n) > 0.5).astype(float)
        cuts = [np.unique(v)[:-1][:63] for v in values.T]
        x, key = tr.cut_up(values, cuts), np.arange(n, dtype=np.uint64)
        weights = tuple(n / (2 * (y == k).sum()) for k in (0, 1))
        for spec in (
            tr.Spec("forest", "classification", 2, trees=30, depth=8, least_weight=0.0, columns="sqrt", class_weights=weights),
            tr.Spec("forest", "classification", 2, trees=3, depth=4, least_rows=3, draw=False, penalty=0.0),
        ):
            want = tr.predicted(spec, tr.fit_here(spec, x, y, key, np.zeros(n, int)), x)
            assert np.allclose(tr.forest_here(spec, x, y, key, x, most), want, atol=1e-12)


@pytest.mark.parametrize("task", ["classification", "regression"])
@pytest.mark.parametrize("most", [10**9, 0])
def test_forests_that_share_trees_equal_those_grown_alone(spark, monkeypatch, task, most):
    _, df = table(spark, 400)
    data = tr.binned(df, 3)
    sizes = [(7, 3, 2), (3, 6, 9), (9, 5, 4), (2, 1, 30)]
    each = [tr.Spec("forest", task, trees=n, depth=d, least_split=s, columns="sqrt", least_weight=0.0, paths=True, fold=f) for n, d, s in sizes for f in (0, 1)]
    x, y, key, fold = tr._arrays(data.table.orderBy("key").toArrow(), 3)
    alone = [tr.scored(s, y[fold == s.fold], tr.decided(s, tr.predicted(s, tr.fit_here(s, x, y, key, fold), x[fold == s.fold]))) for s in each]
    got = tr.fit_many(data, each, "sums", most)
    assert all(np.allclose(a, b) for a, b in zip(got, alone, strict=True))
    # One forest of nine trees of six levels for each fold.
    assert [(s.trees, s.depth, s.least_split) for s in (tr.largest([each[i] for i in g]) for g in tr.shared(each))] == [(9, 6, 2)] * 2


def test_sums_of_a_sibling_follow_from_the_parent(spark):
    draw = np.random.default_rng(3)
    x = draw.integers(0, 9, (500, 4)).astype(np.uint8)
    y, key, fold = (x[:, 0] + 3.0 * (x[:, 1] > 4)), np.arange(500, dtype=np.uint64), np.zeros(500, int)
    for spec in (tr.Spec("boost", "regression", trees=3, depth=5, rate=0.4), tr.Spec("boost", "regression", trees=3, depth=9, leaves=9)):
        for tree in tr.fit_here(spec, x, y, key, fold)[1:]:
            rows, at = np.zeros(len(tree.column)), tree.nodes(x)
            for n in at:
                while n:
                    rows[n] += 1
                    n = tree.parent[n]
            assert tree.rows[1:] == rows[1:].tolist()
