import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import repeats
from millrace.llm.words import flat

SPAN = repeats.SPAN


def by_hand(rows):
    raws = [(t or "").encode() for _, t in rows]
    times = Counter(r[s : s + SPAN] for r in raws for s in range(len(r) - SPAN + 1))
    out = []
    for (i, _), r in zip(rows, raws):
        gone = np.zeros(len(r) + 1, bool)
        for s in range(len(r) - SPAN + 1):
            if times[r[s : s + SPAN]] > 1:
                gone[s : s + SPAN] = True
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((i, len(r), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def check(spark, rows, parts=5):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, key string, h int").repartition(parts)
    got = sorted((tuple(r) for r in repeats.without_repeats(docs).drop("kept").collect()), key=repr)
    want = by_hand(rows)
    assert got == want
    return want


def made(seed, n, letters="abcdefghij é\n"):
    draw = random.Random(seed)
    text = lambda k: "".join(draw.choices(letters, k=k))
    common = [text(draw.choice([150, 300, 399, 400, 401, 450, 700, 1500])) for _ in range(8)]
    rows = []
    for _ in range(n):
        parts = [text(draw.randrange(300))]
        for _ in range(draw.randrange(4)):
            c = draw.choice(common)
            if draw.random() < 0.4:
                at = draw.randrange(len(c))
                c = c[:at] + draw.choice("xyz") + c[at + 1 :]
            if draw.random() < 0.4:
                c = c[draw.randrange(len(c)) :] if draw.random() < 0.5 else c[: draw.randrange(len(c))]
            parts += [c, text(draw.randrange(60))]
        rows.append("".join(parts))
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_random_texts_against_brute_force(spark, seed):
    want = check(spark, made(seed, 90))
    assert sum(w[2] for w in want) > 5000


def test_many_small_ranges(spark, monkeypatch):
    monkeypatch.setattr(repeats, "RANGE", 12)
    draw = random.Random(9)
    passage = "".join(draw.choices("abcdef ", k=520))
    hot = [(1000 + i, "".join(draw.choices("uvw ", k=draw.randrange(200))) + passage[draw.randrange(60) :] + "".join(draw.choices("uvw ", k=200))) for i in range(120)]
    check(spark, made(3, 60) + hot)


def test_generated_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows)


def test_odd_rows(spark):
    draw = random.Random(4)
    unique = "".join(draw.choices("abcdefgh", k=900))
    rows = [(1, None), (2, ""), (3, "short"), (4, "a" * 399), (5, "a" * 400), (6, "b" * 401), (7, "cd" * 500), (8, unique), (9, unique[250:700] + "!" + unique[:399]), (None, unique[:500])]
    rows += [(20, "é" * 200), (20, "é" * 200), (21, "日本" * 400), (22, "\x00" * 450), (23, "xyz" * 40_000), (24, "\x00\x01" * 100 + unique[:400])]
    check(spark, rows)


def test_empty_table(spark):
    check(spark, [])
    check(spark, [(1, "nothing long here")])


def test_anchors_do_not_depend_on_place_or_chunk(monkeypatch):
    draw = random.Random(6)
    same = "".join(draw.choices("abc ", k=5000))
    texts = [same, "x" * 77 + same, "", "tiny", same[:2500], "zz" * 1000]

    def owners():
        data, at = flat(pa.array(texts))
        out = {}
        for p, s, e, h in zip(*(x.tolist() for x in repeats.anchors(data, at))):
            for w in range(s, e + 1):
                assert w <= p <= w + SPAN - repeats.GRAM and w not in out
                out[w] = (p - w, h)
        starts = [s for b, e in zip(at, at[1:]) for s in range(b, e - SPAN + 1)]
        assert sorted(out) == starts
        by = {}
        for w, found in out.items():
            assert by.setdefault(data[w : w + SPAN].tobytes(), found) == found
        return out

    whole = owners()
    monkeypatch.setattr(repeats, "CHUNK", 100)
    assert owners() == whole


def test_merge_of_front_coded_runs():
    draw = random.Random(7)
    for k in (1, 2, 3, 7, 16):
        runs = [sorted("".join(draw.choices("ab", k=draw.randrange(1, 12))).encode() for _ in range(draw.randrange(1, 40))) for _ in range(k)]
        got = list(repeats.merged([repeats.decoded(repeats.encoded(r)) for r in runs]))
        want = sorted(s for r in runs for s in r)
        assert [s for s, _ in got] == want
        assert [c for _, c in got[1:]] == [repeats.shared(a, b) for a, b in zip(want, want[1:])]


def test_merge_looks_at_no_byte_twice(monkeypatch):
    looked = Counter()
    plain = repeats.shared

    def counted(a, b, known=0):
        n = plain(a, b, known)
        looked["bytes"] += n - known
        return n

    base = "p" * 300
    runs = [sorted((base + f"{i:04d}{j}").encode() for i in range(50)) for j in range(8)]
    blobs = [repeats.encoded(r) for r in runs]
    monkeypatch.setattr(repeats, "shared", counted)
    assert len(list(repeats.merged([repeats.decoded(b) for b in blobs]))) == 400
    # The common prefix is read once for each run but the first, and then hardly more than the last few bytes.
    assert looked["bytes"] < 7 * 310 + 400 * 3 * 6
