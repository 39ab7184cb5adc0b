import random
import re
from collections import defaultdict

import numpy as np

from millrace.llm import graph, neardup

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def by_hand(rows):
    """Row number -> (class, links), a class being the smallest row of what links connect."""
    sets = [shingles(t) for _, t in rows]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    links, parent = [set() for _ in rows], list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        for j in {j for x in s for j in holders[x] if j > i}:
            common = len(s & sets[j])
            if 5 * common >= 4 * (len(s) + len(sets[j]) - common):
                links[i].add(j)
                links[j].add(i)
                parent[max(top(i), top(j))] = min(top(i), top(j))
    return [(top(i), len(links[i])) for i in range(len(rows))]


def check(spark, rows):
    docs = spark.createDataFrame([(*r, "clash", 5) for r in rows], "doc_id long, text string, v string, h int").repartition(4)
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in neardup.near_duplicates(docs).collect()), key=repr)
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    found = by_hand(rows)
    want = sorted(((r[0], rows[c][0], n) for r, (c, n) in zip(rows, found)), key=repr)
    assert got == want
    kept = neardup.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(repr(rows[c][0]) for c in {c for c, _ in found})


def edited(draw, text, share, words):
    return " ".join(draw.choice(words) if draw.random() < share else w for w in text.split())


def made(seed, families, size, share):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(2000)]
    rows = []
    for _ in range(families):
        base = " ".join(draw.choices(words, k=draw.choice([3, 8, 40, 200])))
        rows += [base] + [edited(draw, base, draw.uniform(0, share), words) for _ in range(draw.randrange(size))]
    draw.shuffle(rows)
    return list(enumerate(rows))


def test_generated_documents(spark):
    check(spark, [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()])


def test_families_of_copies(spark):
    check(spark, made(1, 60, 6, 0.06))


def test_large_group_over_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 16)
    check(spark, made(2, 3, 150, 0.05) + [(9000 + i, "the same short text again and again") for i in range(200)])


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "!!!"), (4, "one"), (5, "ONE!"), (6, "one two"), (None, "one two"), (None, None), (7, long), (8, long + " end"), (4, "one"), (4, "other words"), (4, "one")]
    rows += [(20, "a b c d e"), (21, "a b c d e a b c d e"), (22, "e d c b a")]
    check(spark, rows)


def test_empty_and_all_different(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(docs).collect() == [] and neardup.without_near_duplicates(docs).collect() == []
    check(spark, [(i, f"text number {i} has its own words {i * 7} here") for i in range(20)])


def test_dense_and_sparse_counts_agree():
    draw = np.random.default_rng(4)
    sets = [np.unique(draw.integers(0, 400, draw.integers(0, 300)).astype(np.uint64)) for _ in range(30)]
    one, two = np.triu_indices(30, 1)
    assert neardup._common(sets, one, two).tolist() == [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(one, two)]


def test_pruning_bound():
    draw = np.random.default_rng(5)
    need = neardup.fewest_matches()
    assert need == sorted(need) and need[neardup.HASHES] < 0.8 * neardup.HASHES
    for n in (16, 64, 128):
        s = draw.uniform(size=400_000)
        m = draw.binomial(n, s)
        # A kept pair is not hopeless: among simulated pairs with fewer matches hardly any reaches the threshold.
        assert (s[m < need[n]] >= 0.8).mean() < 1e-4


def test_components(spark):
    draw = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 60)] + [(draw.randrange(100, 400), draw.randrange(100, 400)) for _ in range(150)] + [(1000, 1000 + i) for i in range(1, 80)] + [(5, 5)]
    got = {r.v: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}
    for a, b in edges:
        parent.setdefault(a, a), parent.setdefault(b, b)
    for _ in range(200):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == {v: p for v, p in parent.items() if any(v in e and e[0] != e[1] for e in edges)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []
