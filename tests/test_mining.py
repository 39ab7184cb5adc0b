import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import baskets as bk
from millrace.operators import density
from millrace.operators import forecast as fc
from millrace.operators.anomaly import anomaly_summary, score_rows
from millrace.operators.cluster import assign_kmeans, principal_components
from millrace.operators.forecast import forecast, step_seconds
from millrace.operators.impute import chained_impute
from millrace.operators.neighbours import knn, knn_outliers, search


def brute_rules(baskets, support, confidence):
    n = len(baskets)
    share = lambda s: sum(s <= b for b in baskets) / n
    items = sorted(set().union(*baskets))
    out = set()
    for size in (2, 3):
        for combo in itertools.combinations(items, size):
            s = share(set(combo))
            if s < support:
                continue
            for r in range(1, size):
                for ant in itertools.combinations(combo, r):
                    con = tuple(x for x in combo if x not in ant)
                    if s / share(set(ant)) >= confidence:
                        out.add((", ".join(ant), ", ".join(con), round(s, 6), round(s / share(set(ant)), 6), round(s / share(set(ant)) / share(set(con)), 6)))
    return out


@pytest.mark.parametrize("tile", [2, 2048])
def test_rules_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(bk, "TILE", tile)
    rng = np.random.default_rng(3)
    sets = [set(rng.choice(list("abcdefg"), size=rng.integers(1, 6), replace=False, p=[0.3, 0.25, 0.2, 0.1, 0.05, 0.05, 0.05])) for _ in range(60)]
    rows = [(i, str(x)) for i, s in enumerate(sets) for x in s] + [(0, None), (1, " "), (None, "a")]
    pairs = bk.baskets_from_pairs(spark.createDataFrame(rows, "t int, item string"), "t", "item")
    got = {(r["antecedent"], r["consequent"], round(r["support"], 6), round(r["confidence"], 6), round(r["lift"], 6)) for r in bk.mine_rules(pairs, 0.1, 0.4, limit=None).collect()}
    assert got == brute_rules([{str(x) for x in s} for s in sets], 0.1, 0.4)
    assert any(", " in g[1] for g in got)


def test_too_few_baskets(spark):
    rows = [(i, x) for i in range(7) for x in "ab"]
    pairs = spark.createDataFrame(rows, "basket int, item string")
    with pytest.raises(ValueError):
        bk.mine_rules(pairs)
    eight = pairs.unionByName(spark.createDataFrame([(7, "a"), (7, "b")], "basket int, item string"))
    assert bk.mine_rules(eight).count() == 2


def brute_dbscan(points, eps, least):
    near = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2)) <= eps
    core = near.sum(1) >= least
    noise = ~core & ~(near & core[None]).any(1)
    seen, clusters = set(), 0
    for i in np.nonzero(core)[0]:
        if i in seen:
            continue
        clusters += 1
        todo = [i]
        while todo:
            j = todo.pop()
            if j not in seen:
                seen.add(j)
                todo += [k for k in np.nonzero(near[j] & core)[0] if k not in seen]
    return int(noise.sum()), clusters


@pytest.mark.parametrize("dims,eps", [(2, 0.3), (3, 0.5)])
def test_dbscan_equals_brute_force(spark, dims, eps):
    rng = np.random.default_rng(dims)
    points = np.vstack([
        rng.normal(0, 0.3, (80, dims)), rng.normal(4, 0.3, (60, dims)), rng.uniform(-3, 8, (40, dims)), np.full((70, dims), 1.5),
    ])
    df = spark.createDataFrame(pd.DataFrame(points, columns=[f"c{i}" for i in range(dims)]))
    scaled = (points - points.mean(0)) / points.std(0)
    got = density.dbscan_summary(df, eps=eps).first()
    assert (got["noise_points"], got["clusters"]) == brute_dbscan(scaled, eps, 5)
    assert got["rows"] == len(points)


def test_dense_cells_split_until_decided(spark):
    """Two crowded neighbour cells whose first points are far apart but whose edges touch, and one that does not."""
    rng = np.random.default_rng(0)
    line = np.column_stack([rng.uniform(0, 10, 600), rng.normal(0, 0.01, 600)])
    other = np.column_stack([rng.uniform(0, 10, 300), rng.normal(3, 0.01, 300)])
    points = np.vstack([line, other])
    df = spark.createDataFrame(pd.DataFrame(points, columns=["a", "b"]))
    scaled = (points - points.mean(0)) / points.std(0)
    got = density.dbscan_summary(df, eps=0.25).first()
    assert (got["noise_points"], got["clusters"]) == brute_dbscan(scaled, 0.25, 5)


def test_boxes_are_split_only_between_components(spark, monkeypatch):
    """Cells of one component need no smaller boxes to tell whether they touch."""
    levels, boxes = [], density._boxes
    monkeypatch.setattr(density, "_boxes", lambda dense, width, level, dims: levels.append(level) or boxes(dense, width, level, dims))
    rng = np.random.default_rng(1)
    blob = rng.uniform(0, 4, (3000, 2))
    near = rng.uniform(0, 1, (300, 2)) + [4.45, 0]
    for points in (blob, np.vstack([blob, near])):
        levels.clear()
        scaled = (points - points.mean(0)) / points.std(0)
        got = density.dbscan_summary(spark.createDataFrame(pd.DataFrame(points, columns=["a", "b"])), eps=0.4).first()
        assert (got["noise_points"], got["clusters"]) == brute_dbscan(scaled, 0.4, 5)
        assert len(points) > 3000 or max(levels) == 0


def test_knn_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    points = np.vstack([rng.normal(0, 1, (150, 5)), np.zeros((80, 5))])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id int, v array<double>")
    got = knn(df, df, 3, "id", "id", F.col("v"), F.col("v"), skip_same_key=True, fan=4, leaf=9, chunk=5).toPandas()
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    for i in range(len(points)):
        mine = got[got["query"] == i].sort_values("rank")
        assert mine["neighbour"].tolist() == np.argsort(d[i], kind="stable")[:3].tolist()
        assert np.allclose(mine["distance"], np.sort(d[i])[:3])


def test_knn_outlier(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(0, 1, (80, 2)))] + [(99, 50.0, 50.0)]
    found = knn_outliers(spark.createDataFrame(rows, "id int, a double, b double"), ["a", "b"], "id", 5)
    assert [r["id"] for r in found.where("outlier").collect()] == [99]


def test_isolation_forest_finds_planted(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(0, 1, (400, 2)))] + [(1000 + i, 12.0 + i, -12.0) for i in range(4)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    scored = score_rows(df, ["a", "b"])
    found = {r["id"] for r in scored.where("anomaly").collect()}
    assert {1000, 1001, 1002, 1003} <= found
    summary = anomaly_summary(df, ["a", "b"]).first()
    assert abs(summary["rate"] - 0.08) < 0.02 and summary["rows"] == 404


def test_imputation_paths_agree(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(10, 2, 300), rng.normal(-4, 1, 300)
    c = 3 * a - 2 * b + rng.normal(0, 0.01, 300)
    frame = pd.DataFrame({"id": range(300), "a": a, "b": b, "c": c, "note": "x"})
    true_c = frame["c"].copy()
    frame.loc[::7, "c"] = None
    frame.loc[3::11, "a"] = None
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in frame.itertuples(index=False)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, note string")
    quick = chained_impute(df, ["a", "b", "c"], 5).orderBy("id").toPandas()
    slow = chained_impute(df, ["a", "b", "c"], 5, max_patterns=0).orderBy("id").toPandas()
    assert quick[["a", "b", "c"]].notna().all().all() and list(quick.columns) == list(frame.columns)
    assert np.allclose(quick[["a", "b", "c"]], slow[["a", "b", "c"]], atol=1e-6)
    only_c = frame["c"].isna() & frame["a"].notna()
    assert np.abs(quick.loc[only_c, "c"] - true_c[only_c]).max() < 0.2


def test_kmeans_and_pca(spark):
    rng = np.random.default_rng(7)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.vstack([rng.normal(0, 0.2, (50, 2)), rng.normal(9, 0.2, (50, 2))]))]
    df = spark.createDataFrame(rows + [(100, None, 1.0)], "id int, x double, y double")
    out, summary = assign_kmeans(df, ["x", "y"], 2)
    got = out.orderBy("id").toPandas()
    assert got["cluster_id"][:50].nunique() == 1 and got["cluster_id"][:100].nunique() == 2 and pd.isna(got["cluster_id"][100])
    assert summary["silhouette"] > 0.9
    _, shares = principal_components(df, ["x", "y"], 2)
    assert shares[0] > 0.95 and abs(sum(shares) - 1) < 1e-9


def test_forecast_recovers_line_and_week(spark):
    days = pd.date_range("2023-01-01", periods=200, freq="D")
    y = 100 + 0.5 * np.arange(200) + 10 * np.sin(2 * np.pi * np.arange(200) / 7)
    points = spark.createDataFrame(pd.DataFrame({"ds": days, "y": y})).withColumn("ds", F.col("ds").cast("timestamp"))
    assert step_seconds(points) == 86_400
    ahead = forecast(points, 28).orderBy("ds").toPandas()
    t = np.arange(200, 228)
    assert np.abs(ahead["yhat"] - (100 + 0.5 * t + 10 * np.sin(2 * np.pi * t / 7))).max() < 4
    assert (ahead["yhat_lower"] <= ahead["yhat"]).all() and len(ahead) == 28


def test_nearest_of_clustered_wide_vectors_visit_few_pairs(spark):
    """Sixty-four columns, sixty clusters and a crowd of equal points: exact, with a small share of all pairs looked at."""
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 1, (60, 64))
    x = centres[rng.integers(0, 60, 3000)] + rng.normal(0, 0.05, (3000, 64))
    x[:300] = centres[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    shares = []
    for n in (1500, 3000):
        some = df.where(F.col("id") < n)
        shares.append(search(some, some, 6, "id", "id", F.col("v"), F.col("v"), leaf=40, fan=16).visited() / n**2)
    assert shares[1] < 0.15 and shares[0] < 0.2
    got = knn(df, df, 5, "id", "id", F.col("v"), F.col("v"), skip_same_key=True, leaf=40, fan=16, chunk=100).toPandas().sort_values(["query", "rank"])
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(2)) if len(x) <= 500 else np.stack([np.sqrt(((x - r) ** 2).sum(1)) for r in x])
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, axis=1, kind="stable")[:, :5]
    assert (got["neighbour"].to_numpy().reshape(-1, 5) == want).mean() > 0.999
    assert np.allclose(got["distance"].to_numpy().reshape(-1, 5), np.take_along_axis(d, want, 1))


def test_nearest_with_few_or_no_points(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [3.0, 1.0]), (3, None)], "id int, v array<double>")
    assert [tuple(r) for r in knn(df, df, 5, "id", "id", F.col("v"), F.col("v"), skip_same_key=True).orderBy("query").collect()] == [(1, 2, 3.0, 1), (2, 1, 3.0, 1)]
    assert knn(df, df.where("id = 3"), 2, "id", "id", F.col("v"), F.col("v")).collect() == []
    assert knn(df.where("id = 3"), df, 2, "id", "id", F.col("v"), F.col("v")).collect() == []


def test_a_query_goes_once_to_a_chunk_whatever_the_number_of_cells(spark):
    x = np.random.default_rng(8).normal(0, 1, (900, 16))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, v array<double>")
    ready = search(df, df, 6, "id", "id", F.col("v"), F.col("v"), leaf=40, fan=16, chunk=300)
    chunks = len(ready.tree.chunks(300)[0])
    assert 3 <= chunks <= 16 < len(ready.tree.leaves(0))
    assert ready.sent.count() <= 900 * chunks


def test_neighbours_of_other_groups_only(spark):
    rng = np.random.default_rng(9)
    x, fold = np.vstack([rng.normal(0, 1, (120, 3)), np.ones((60, 3))]), rng.integers(0, 5, 180)
    df = spark.createDataFrame([(i, r.tolist(), int(f)) for i, (r, f) in enumerate(zip(x, fold))], "id int, v array<double>, fold int")
    got = knn(df, df, 3, "id", "id", F.col("v"), F.col("v"), leaf=30, fan=4, apart="fold").toPandas().sort_values(["query", "rank"])
    d = np.where(fold[:, None] == fold[None], np.inf, np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)))
    assert got["neighbour"].to_numpy().reshape(-1, 3).tolist() == np.argsort(d, axis=1, kind="stable")[:, :3].tolist()


@pytest.mark.parametrize("tile,most", [(2048, 500_000), (2048, 0), (3, 0)])
def test_itemsets_of_rows_are_the_same_by_every_way_of_counting(spark, monkeypatch, tile, most):
    monkeypatch.setattr(bk, "TILE", tile)
    rng = np.random.default_rng(9)
    sets = [sorted({str(x) for x in rng.choice(list("abcdefgh"), size=rng.integers(0, 7))}) for _ in range(90)]
    df = spark.createDataFrame([(s,) for s in sets], "items array<string>")
    found, total = bk.frequent_itemsets(df, 0.08, most_sent=most)
    got = {tuple(r["items"]): (r["size"], r["n"], round(r["support"], 9)) for r in found.collect()}
    want = {}
    for size in (1, 2, 3):
        for c in itertools.combinations("abcdefgh", size):
            n = sum(set(c) <= set(s) for s in sets)
            if n / 90 >= 0.08:
                want[c] = (size, n, round(n / 90, 9))
    assert total == 90 and got == want and max(len(k) for k in got) == 3
    assert bk.frequent_itemsets(df.limit(0), 0.2, most_sent=most)[0].collect() == []


def test_seasonal_forecast_of_each_series_is_its_own_ridge(spark):
    """Against the closed form for each series, in one part and in many; the week and the year come back."""
    rng = np.random.default_rng(5)
    frames = []
    for name, n in (("a", 900), ("b", 60), ("c", 9), ("d", 300)):
        day = np.arange(n) * (10 if name == "d" else 1)
        y = 50 + 0.03 * day + 4 * np.sin(2 * np.pi * day / 7) + (6 * np.cos(2 * np.pi * day / 365.25) if n > 800 else 0) + rng.normal(0, 0.3, n)
        frames.append(pd.DataFrame({"k": name, "ds": pd.to_datetime("2020-01-06") + pd.to_timedelta(day, "D"), "y": y}))
    frame = pd.concat(frames)
    frame["ds"] = frame["ds"].dt.date
    df = spark.createDataFrame(frame)
    bad = spark.createDataFrame([("a", None, 1.0), (None, None, 2.0)], df.schema)
    for size in (100_000, 70):
        got = fc.seasonal_by_series(df.unionByName(bad), "k", 14, rows_per_task=size).toPandas().sort_values(["k", "ds"])
        assert sorted(set(got["k"])) == ["a", "b", "d"] and len(got) == 42
        for name, one in frame.groupby("k"):
            if name == "c":
                continue
            day = (pd.to_datetime(one["ds"]) - pd.Timestamp("1970-01-01")).dt.days.to_numpy(float)
            y, n = one["y"].to_numpy(), len(one)
            ahead = day[-1] + np.arange(1, 15)
            terms = lambda d: fc.date_terms(d, np.full(len(d), day[0]), np.full(len(d), day[-1]), np.full(len(d), float(n)))
            x, top = terms(day), np.abs(y).max()
            noise = max(y.var() / top**2 * (1 - np.corrcoef(y, day)[0, 1] ** 2), 1e-8)
            w = np.linalg.solve(x.T @ x + noise * np.diag([0] + [1] * (x.shape[1] - 1)), x.T @ (y / top))
            mine = got[got["k"] == name]
            assert np.allclose(mine["yhat"], terms(ahead) @ w * top, rtol=1e-6)
            sigma = np.sqrt(((y / top - x @ w) ** 2).mean()) * top
            assert np.allclose(mine["yhat_upper"] - mine["yhat"], 1.2816 * sigma, rtol=1e-4)
    a = got[got["k"] == "a"]
    days = 900 + np.arange(14)
    truth = 50 + 0.03 * days + 4 * np.sin(2 * np.pi * days / 7) + 6 * np.cos(2 * np.pi * days / 365.25)
    assert np.abs(a["yhat"].to_numpy() - truth).max() < 1.5


def test_seasonal_forecast_of_one_series_equals_the_single_one(spark):
    day = np.arange(800)
    y = 20 + 0.01 * day + 3 * np.sin(2 * np.pi * day / 7) + np.random.default_rng(6).normal(0, 0.2, 800)
    ds = pd.to_datetime("2021-03-01") + pd.to_timedelta(day, "D")
    single = fc.forecast(spark.createDataFrame(pd.DataFrame({"ds": ds, "y": y})), 10).toPandas().sort_values("ds")
    by = fc.seasonal_by_series(spark.createDataFrame(pd.DataFrame({"k": 1, "ds": ds.date, "y": y})), "k", 10).toPandas().sort_values("ds")
    assert np.allclose(single["yhat"], by["yhat"], rtol=1e-3) and np.allclose(single["yhat_lower"], by["yhat_lower"], rtol=2e-3)
