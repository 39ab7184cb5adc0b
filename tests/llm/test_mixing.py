import math
from collections import defaultdict
from hashlib import md5

from millrace.llm import mixing


def by_hand(rows):
    size = lambda t: len((t or "").replace("\x0b", " ").replace("\x0c", " ").split())
    totals = defaultdict(int)
    for _, text, source in rows:
        totals[source] += size(text)
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    pot, open_, target = 1.5 * sum(totals.values()), set(order), {}
    while open_:
        level = pot / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level >= 2 * totals[s]}
        if not over:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: 2.0 * totals[s] for s in over}
        pot -= sum(2 * totals[s] for s in over)
        open_ -= over
    return size, totals, target


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix(docs).collect()
    size, totals, target = by_hand(rows)
    assert sorted((repr(r.doc_id), r.size) for r in got) == sorted((repr(i), size(t)) for i, t, _ in rows)
    where = {i: s for i, _, s in rows}
    taken = defaultdict(int)
    for r in got:
        s = where[r.doc_id]
        assert r.source_size == totals[s] and math.isclose(r.target, target[s], rel_tol=1e-9, abs_tol=1e-6)
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in totals:
        assert abs(taken[s] - target[s]) <= 1.0 + 1e-6
    return got


def test_targets_and_taken(spark):
    rows = [(i, "w " * (1 + (i * 7919) % 60), f"s{i % 5}") for i in range(400)]
    rows += [(1000 + i, "w " * 5, "hot") for i in range(900)] + [(3000, "a\tb\x0bc\x0cd", None), (3001, None, None), (3002, "", "empty")]
    first = check(spark, rows)
    again = check(spark, list(reversed(rows)))
    assert sorted(map(repr, first)) == sorted(map(repr, again))


def test_lower_hash_first(spark):
    rows = [(i, "w " * 10, "a" if i % 3 else "b") for i in range(300)]
    got = check(spark, rows)
    where = {i: s for i, _, s in rows}
    for s in "ab":
        ordered = sorted((r for r in got if where[r.doc_id] == s), key=lambda r: md5(f"mix:{r.doc_id}".encode()).hexdigest())
        assert [r.taken for r in ordered] == sorted((r.taken for r in ordered), reverse=True)


def test_repeated_ids_and_one_document(spark):
    docs = spark.createDataFrame([(7, "a b c d", "x"), (7, "a b c d", "x"), (None, "q", "x"), (None, "r", "x")], "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert sum(r.size for r in got) == 10 and 13 <= sum(r.taken for r in got) <= 15
    check(spark, [(1, "only one text here", "x")])


def test_empty_and_no_words(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string, size string, hash string")
    assert mixing.mix(docs).collect() == []
    got = mixing.mix(spark.createDataFrame([(1, " ", "x", "k")], "doc_id long, text string, source string, size string")).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in got] == [(0, 0, 0.0, 0)]
