import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler

from millrace.operators import machines as mc
from millrace.operators import models as mo


def points(spark, n=400):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (n, 2))
    frame = pd.DataFrame({"key": np.arange(n), "a": x[:, 0], "b": x[:, 1], "fold": np.arange(n) % 2, "kind": (x[:, 0] * x[:, 1] > 0) * 1.0, "size": 100 + 50 * np.sin(x[:, 0]) + rng.normal(0, 1, n)})
    return x, frame, VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(spark.createDataFrame(frame))


def test_steps_reach_the_least_hinge_loss():
    rng = np.random.default_rng(3)
    z, sign = rng.normal(0, 1, (300, 5)), np.where(rng.random(300) < 0.5, -1.0, 1.0)
    z += 0.5 * sign[:, None]

    def loss(w):
        value, slant = mc.hinge(z @ w, sign)
        return value.mean() + 0.05 * w @ w, (slant[:, None] * z).mean(0) + 0.1 * w

    steps = mc.minimised(np.zeros(5))
    at = next(steps)
    try:
        while True:
            at = steps.send(loss(at))
    except StopIteration as end:
        w = end.value
    best = loss(w)[0]
    assert all(loss(w + rng.normal(0, size, 5))[0] > best - 1e-4 for size in (0.3, 0.03, 0.003) for _ in range(200))


def test_the_machine_of_each_fold_is_at_its_minimum(spark):
    x, frame, df = points(spark)
    data = df.withColumnRenamed("size", "label").coalesce(1)
    table = mc.flat(data.where("key >= 40"), data.where("key < 40"))
    found = mc.fit(table, 2, 0, 1 / 400, 2)
    y, mapped, rng = frame["size"].to_numpy(), found.space(x), np.random.default_rng(1)
    assert found.outs == [mc.HELD, 0, 1]
    for i, rows in enumerate((frame["key"] >= 40, frame["fold"] != 0, frame["fold"] != 1)):
        z, t, w = mapped[rows], y[rows], found.weights[i, 0]
        spread = z[:, :-1].std(0)
        loss = lambda w: min(mc.huber(z @ w, t, s)[0].mean() for s in np.geomspace(0.05, 100, 200)) + 0.5 / 400 * ((w[:-1] * spread) ** 2).sum()
        best = loss(w)
        assert all(loss(w + rng.normal(0, 0.5, len(w))) > best * 0.998 for _ in range(30))
    shown = mc.predictions(table, 2, found).orderBy("key").toPandas()
    own = np.where(frame["fold"] == 0, found.predict(x, 0), found.predict(x, 1))
    assert np.allclose(shown["prediction"], own, atol=1e-3) and np.allclose(shown["held_prediction"][:40], found.predict(x[:40], mc.HELD), atol=1e-3)
    assert shown["held_prediction"][40:].isna().all()


@pytest.mark.parametrize("model,target,score", [("SVC", "kind", "accuracy"), ("SVR", "size", "r2")])
def test_machines_of_all_folds_are_fitted_together(spark, monkeypatch, model, target, score):
    """A pass serves all folds: the fits of one fold after another took as many jobs again for each."""
    _, frame, _ = points(spark)
    df = spark.createDataFrame(frame)
    passes = []
    summed = mc._summed
    monkeypatch.setattr(mc, "_summed", lambda *a: passes.append(1) or summed(*a))
    monkeypatch.setattr(mo, "CrossValidator", lambda **a: pytest.fail("fold by fold"))
    result = mo.run_model(df, model, "key", target, features=["a", "b"])
    assert result["metrics"][score] > 0.85 and result["metrics"]["cv_score"] > 0.85 and len(passes) < 4 * mc.ROUNDS
    assert 40 < result["predictions"].count() < 130
