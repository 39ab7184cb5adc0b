import zlib

import numpy as np
import pyarrow as pa

from millrace.llm import quality


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 1


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = {r.doc_id: r for r in quality.score(docs, labels).collect()}
    assert len(got) == docs.count()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    both = [(got[i], q) for i, q in truth.items() if i in got and held(i)]
    assert len(both) > 300 and all(r.held_out for r, _ in both)
    assert np.mean([r.predicted == q for r, q in both]) > 0.97
    bad, good = [r.score for r, q in both if q == 0], [r.score for r, q in both if q == 1]
    assert np.mean([b < g for b in bad for g in good]) > 0.99
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == held(i) for i, r in got.items())


def test_held_out_labels_and_columns_are_not_read(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality")
    scores = lambda d, la: {r.doc_id: round(r.score, 6) for r in quality.score(d, la).collect()}
    assert scores(docs, labels) == scores(docs.selectExpr("doc_id", "text", "'x' AS lang", "'y' AS source", "1 AS stats", "2 AS score"), turned)


def test_odd_rows_and_pipeline_filter(spark):
    texts = [None, "", " ", "\n\n", "word", "é", "A!! " * 5, "x" * 100_000, "a b c\n" * 20_000]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "some text", "c"), (4, "word", "c"), (4, "other", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(0, 1), (2, 0), (3, 1), (4, None), (None, 0), (6, 0), (6, 0), (8, 1)], "doc_id long, quality int")
    got = quality.score(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    kept = quality.only_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)
    for empty in (labels.limit(0), labels.where("quality = 1")):
        assert all(r.predicted == 1 for r in quality.score(docs, empty).collect())
    assert quality.score(docs.limit(0), labels).collect() == []


def test_pooling_against_brute_force():
    draw = np.random.default_rng(3)
    for _ in range(20):
        seen = draw.integers(1, 9, 30).astype(float)
        good = np.floor(draw.uniform(0, 1, 30) * (seen + 1))
        got = quality.pooled(good, seen)
        # The minimax form of isotonic regression.
        want = [max(min(good[i:j].sum() / seen[i:j].sum() for j in range(k + 1, 31)) for i in range(k + 1)) for k in range(30)]
        assert np.allclose(got, want)


def test_features_approximate_the_kernel():
    draw = np.random.default_rng(1)
    z = draw.normal(size=(5, 4))
    turn, phase = draw.normal(size=(4, 20_000)) / 2.0, draw.uniform(0, 2 * np.pi, 20_000)
    m = quality.Model(np.zeros(4), np.ones(4), turn, phase, np.zeros(0), np.zeros(2), np.zeros(2))
    x = m.expand(z)[:, :20_000]
    near = np.exp(-((z[:, None] - z[None]) ** 2).sum(-1) / (2 * 4))
    assert np.abs(x @ x.T - near).max() < 0.05
    assert np.isfinite(quality.statistics(pa.array([None, "", "x"]))).all()
