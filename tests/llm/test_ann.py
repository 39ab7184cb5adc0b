import math

import numpy as np
import pytest

from millrace.llm import ann


def by_hand(rows, queries, k=10):
    """query id -> [(distance, id)] nearest first, by the rules of the operator."""

    def fine(v):
        return v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)

    rows = [(i, v) for i, v in rows if i is not None and fine(v)]
    asking = {}
    for i, v in queries:
        if i is not None and fine(v):
            asking[i] = min(asking.get(i, v), v)
    out = {}
    for i, q in asking.items():
        best = {}
        for j, v in rows:
            if j != i:
                best[j] = min(best.get(j, math.inf), math.dist(q, v))
        out[i] = sorted((d, j) for j, d in best.items())[:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, score string")


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_recall(spark, folder):
    e = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, float) for r in e.collect()}
    table, ids = np.stack(list(rows.values())), np.array(list(rows))
    got = found(ann.nearest(e, e.where("vec_id % 100 = 0")))
    assert sorted(got) == sorted(i for i in rows if i % 100 == 0)
    hits = 0
    for i, near in got.items():
        away = np.sqrt(((table - rows[i]) ** 2).sum(axis=1))
        away[ids == i] = np.inf
        assert len(near) == 10 and near == sorted(near) and len({j for _, j in near}) == 10
        assert all(math.isclose(d, math.dist(rows[i], rows[j]), rel_tol=1e-12) for d, j in near)
        hits += len({j for _, j in near} & set(ids[np.lexsort((ids, away))[:10]].tolist()))
    assert hits / (10 * len(got)) >= 0.93


def test_ties_odd_vectors_and_repeated_rows(spark):
    draw = np.random.default_rng(1)
    vec = lambda: [round(x, 3) for x in draw.normal(size=8).tolist()]
    same, rows = vec(), []
    rows += [(i, vec()) for i in range(60)] + [(1000 + i, same) for i in range(40)]
    rows += [(200, None), (201, [0.0] * 8), (202, [1.0, None] + [0.0] * 6), (203, [math.nan] * 8), (204, [math.inf] + [1.0] * 7), (205, [1.0, 2.0]), (206, []), (None, vec())]
    rows += [(7, rows[7][1]), (7, vec()), (300, [1e-12] + [0.0] * 7), (301, [1e6] * 8)]
    queries = [r for r in rows if r[0] is None or r[0] % 5 == 0 or r[0] in (7, 201, 202)]
    got = found(ann.nearest(frame(spark, rows), frame(spark, queries), miss=0.0))
    want = by_hand(rows, queries)
    assert sorted(got) == sorted(want)
    for i in want:
        assert [j for _, j in got[i]] == [j for _, j in want[i]]
        assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12) for (a, _), (b, _) in zip(got[i], want[i]))


def test_few_and_no_candidates(spark):
    some = frame(spark, [(0, [1.0] * 8), (1, [2.0] * 8)])
    assert found(ann.nearest(some, some)) == {0: [(math.sqrt(8), 1)], 1: [(math.sqrt(8), 0)]}
    assert found(ann.nearest(some.limit(0), some)) == {}
    assert found(ann.nearest(some, some.limit(0))) == {}
    assert found(ann.nearest(some.where("vec_id = 0"), some.where("vec_id = 0"))) == {}


def test_blocks_of_queries_give_the_same(spark, monkeypatch):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    whole = found(ann.nearest(e, e.where("vec_id % 20 = 0"), 3))
    monkeypatch.setattr(ann, "QUERY_BLOCK", 9)
    assert found(ann.nearest(e, e.where("vec_id % 20 = 0"), 3)) == whole


def test_prefix_length_keeps_what_it_promises():
    draw = np.random.default_rng(8)
    for angle in (0.05, 0.4, 0.8):
        q = draw.normal(size=32)
        q /= np.linalg.norm(q)
        turn = draw.normal(size=(300, 32))
        turn -= (turn @ q)[:, None] * q
        near = math.cos(angle) * q + math.sin(angle) * turn / np.linalg.norm(turn, axis=1, keepdims=True)
        x = int(ann.prefix_lengths(np.ones(1), np.array([2 * math.sin(angle / 2)]), 1.0, 1.0, 0.05)[0])
        shift = np.uint64(ann.BITS - x)
        same = (ann.strings(near) >> shift) == (ann.strings(q[None]) >> shift)
        assert same.any(axis=0).mean() > 0.88
