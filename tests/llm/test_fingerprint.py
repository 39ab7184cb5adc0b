import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.llm import fingerprint as fp
from millrace.llm.queries import QUERIES

KIND = "doc_id long, text string"
PARAGRAPH = re.compile("[^ \t\n\x0b\f\r.!?。！？][^\n.!?。！？]{0,199}+[.!?。！？]*+[ \t\n\x0b\f\r]*+|[.!?。！？]++[ \t\n\x0b\f\r]*+|[ \t\n\x0b\f\r]++")


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def tree(text):
    """Sections as lists of (digest, length)."""
    out, section = [], []
    parts = PARAGRAPH.findall(text)
    assert "".join(parts) == text
    for i, p in enumerate(parts):
        section.append((h(p), len(p)))
        if re.search("\n[ \t\x0b\f\r]*\n", p) or h(p)[0] == "0" or i == len(parts) - 1:
            out.append(section)
            section = []
    return out


def shown(text):
    sections = tree(text)
    digests = [h("".join(d for d, _ in s)) for s in sections]
    return "/".join([h("".join(digests))] + [f"{g[:16]}:{','.join(f'{d[:12]}{n:x}' for d, n in s)}" for g, s in zip(digests, sections)])


def alike(a, b):
    """Shared distinct paragraphs, but sections that both have count as they are."""
    if a == b:
        return 1.0
    one, two = ({tuple((d[:12], n) for d, n in s) for s in tree(x)} for x in (a, b))
    size = lambda some: sum(n for _, n in some)
    both = sum(size(s) for s in one & two)
    x, y = ({p for s in some for p in s} for some in (one - two, two - one))
    total = 2 * both + size(x) + size(y)
    return min(0.999999, 2 * (both + size(x & y)) / total) if total else 0.0


def by_hand(rows):
    rows = [(i, t or "") for i, t in rows]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    order = sorted(set(rows), key=key)
    after = {r: order[(i + 1) % len(order)] for i, r in enumerate(order)}
    out = []
    for i, t in rows:
        q, following = len(t) // 4, after[i, t][1]
        e = t[: len(t) - q] + following[:q]
        out.append((i, len(t), h(e), shown(t), shown(e), alike(t, e), alike(t, following)))
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], KIND + ", to string, name int")
    got = sorted((tuple(r) for r in fp.with_edits(df).collect()), key=repr)
    want = sorted(by_hand(rows), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(abs(a - b) < 1e-9 for g, w in zip(got, want) for a, b in zip(g[5:], w[5:]))


def made(n, seed=2):
    draw = random.Random(seed)
    words = ["one", "two", "thrée", "日本", "x", "𝒳", "four five", "\t"]
    sentence = lambda: " ".join(draw.choices(words, k=draw.randint(1, 12))) + draw.choice([".", "!", "?!", "。", "", "\n", "\n\n", "\n \n", "..."])
    return [(i, "".join(sentence() + draw.choice(["", " "]) for _ in range(draw.randint(0, 60)))) for i in range(n)]


def test_random_texts(spark):
    check(spark, made(80))


def test_nulls_ties_repeats_and_long_texts(spark):
    rows = [(5, None), (6, ""), (7, "abc"), (8, "a"), (9, " \n\n "), (10, "." * 500), (11, "word " * 50_000), (12, "x" * 3000), (None, "no id. At all."), (13, "Same. Text."), (13, "Same. Text."), (13, "Same. Text."), (14, None), (14, "")]
    check(spark, rows)


@pytest.mark.parametrize("rows", [[(1, "Only one here. It is its own next one.")], [(2, "a. b. c. d. e."), (1, "f. g. h.")], [(1, None)]])
def test_few_rows(spark, rows):
    check(spark, rows)


def test_empty_table(spark):
    assert fp.with_edits(spark.createDataFrame([], KIND)).collect() == []


def test_ranges_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(fp, "ROWS_PER_RANGE", 7)
    check(spark, made(60, 5))


def test_differing_locates_an_edit(spark):
    text = "\n".join(f"Line {i} says this. And then that {i * i}." for i in range(300))
    at = text.index("Line 100 ")
    edited = text[:at] + "Something new. " + text[at:]
    df = spark.createDataFrame([(text, edited)], "a string, b string").select(fp.fingerprint(F.col("a")).alias("a"), fp.fingerprint(F.col("b")).alias("b"))
    there, back, same, near = df.select(fp.differing(F.col("b"), F.col("a")), fp.differing(F.col("a"), F.col("b")), fp.differing(F.col("a"), F.col("a")), fp.likeness(F.col("a"), F.col("b"))).first()
    assert [edited[s.start : s.end] for s in there] == ["Something new. "]
    assert back == [] and same == [] and 0.99 < near < 1


def test_equal_texts_and_only_sql_functions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    plan = QUERIES["op13_fingerprints"](spark, "/root/testdata/sf0.01")
    shown_plan = plan._jdf.queryExecution().toString()
    assert "Python" not in shown_plan and "Arrow" not in shown_plan
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in plan.collect()), key=repr)
    want = sorted(by_hand(rows), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(abs(a - b) < 1e-9 for g, w in zip(got, want) for a, b in zip(g[5:], w[5:]))
    long = [g[5] for g in got if g[1] > 500]
    assert sum(long) / len(long) > 0.6 > 0.3 > sum(g[6] for g in got) / len(got)
