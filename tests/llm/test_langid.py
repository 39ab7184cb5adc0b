import zlib

import numpy as np
import pyarrow as pa

from millrace.llm import langid

FOLDER = "/root/testdata/sf0.1"


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = langid.identify(docs).collect()
    assert len(got) == len(truth) and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got if r.held_out and truth[r.doc_id]]) > 0.97


def test_held_out_labels_and_columns_are_not_read(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    turned = docs.selectExpr("doc_id", "text", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 4 = 2 THEN 'xx' ELSE lang END AS lang", "'s' AS source")
    assert sorted(map(tuple, langid.identify(docs).collect())) == sorted(map(tuple, langid.identify(turned).collect()))


def test_odd_rows(spark):
    base = [(i, f"{'der die das und' if i % 2 else 'the and of to'} " * 20, "de" if i % 2 else "en") for i in range(80)]
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "123 !?", "de"), (None, "the and of to", "en"), (1003, "é", None), (1004, "the of and to " * 30_000, None), (3, "\x00 \x00", "de"), (3, "x", None)]
    docs = spark.createDataFrame([(*r, "clash") for r in base + odd], "doc_id long, text string, lang string, j string")
    got = {(r.doc_id, n): r for n, r in enumerate(langid.identify(docs).collect())}
    by = {i: r for (i, _), r in got.items()}
    assert len(got) == len(base + odd)
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1004].lang_pred == "en" and by[1003].lang_pred in ("de", "en")
    assert not by[None].held_out
    assert np.mean([by[i].lang_pred == lang for i, _, lang in base if i != 3]) > 0.9
    nothing = langid.identify(docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    assert langid.identify(docs.limit(0)).collect() == []


def test_windows_hold_every_byte():
    texts = ["a" * 255, "", None, "bé" * 300, "c" * 512]
    x, owner, used = langid.windows(pa.array(texts))
    for i, t in enumerate(texts):
        assert b"".join(row[:n].tobytes() for row, o, n in zip(x, owner, used) if o == i) == (t or "").encode()


def test_gradients_against_differences():
    draw = np.random.default_rng(2)
    net = langid.Network.fresh(["a", "b", "c"])
    for name in ("vector", "out", "out_bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    net.filters = [f.astype(np.float64) for f in net.filters]
    net.bias = [b.astype(np.float64) + 0.1 for b in net.bias]
    x, y = draw.integers(1, 256, (6, langid.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])

    def loss():
        best = [z.max(axis=1) + b for (_, z), b in zip(net._responses(x), net.bias)]
        return -np.log(net._softmax(np.maximum(np.hstack(best), 0))[np.arange(6), y]).mean()

    for w, g in zip(net.weights(), net.gradients(x, y)):
        for _ in range(4):
            at = tuple(draw.integers(0, s) for s in w.shape)
            if w is net.vector and at[0] == 0:
                continue
            keep, step = w[at], 1e-6
            w[at] = keep + step
            up = loss()
            w[at] = keep - step
            down = loss()
            w[at] = keep
            assert abs((up - down) / (2 * step) - g[at]) < 1e-5
