import random
import re

import numpy as np
import pyarrow as pa

from millrace.llm import words as W

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def made(n):
    draw = random.Random(n)
    return ["".join(draw.choices("aB9 ,é日😀\x00\n`{", k=draw.randrange(40))) for _ in range(n)] + [None, "", "x", "ÀÉ İ"]


def test_words_and_hashes_against_a_plain_split(spark):
    texts = made(300)
    parsed = W.words(pa.array(texts))
    want = [WORD.findall((t or "").translate(LOWER)) for t in texts]
    assert parsed.count().tolist() == [len(w) for w in want]
    listed = [w for ws in want for w in ws]
    assert [parsed.word(i).decode() for i in range(len(listed))] == listed
    by = {}
    for w, h in zip(listed, parsed.hash.tolist()):
        assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by)
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r.w for r in rows.select("i", W.word_array(rows["text"]).alias("w")).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_shingles_stay_in_their_text():
    texts = made(100)
    parsed = W.words(pa.array(texts))
    want = [WORD.findall((t or "").translate(LOWER)) for t in texts]
    for n in (1, 2, 3, 5):
        value, at = parsed.shingles(n)
        listed = [tuple(w[i : i + n]) for w in want for i in range(len(w) - n + 1)]
        assert len(value) == len(at) == len(listed)
        by = {}
        for s, v in zip(listed, value.tolist()):
            assert by.setdefault(s, v) == v
        assert len(set(by.values())) == len(by)


def test_slices_hold_everything_and_change_nothing():
    texts = pa.array(made(200) + ["long " * 1000])
    for most in (1, 100, 10_000):
        parts = list(W.slices(texts, most))
        assert [t for p in parts for t in p.to_pylist()] == texts.to_pylist()
        assert np.array_equal(np.concatenate([W.words(p).hash for p in parts]), W.words(texts).hash)
    assert list(W.slices(texts.slice(0, 0))) == []


def test_spare_names(spark):
    df = spark.createDataFrame([(1, 2)], "Score int, score_ int")
    assert W.spare_name(df, "score", "score", "x") == ["score__", "score___", "x"]
