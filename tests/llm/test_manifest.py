import hashlib
import random
import zlib

import pytest

from millrace.llm import manifest
from millrace.llm.queries import QUERIES

KIND = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in row])


def grow(nodes):
    """Root, and for each leaf the list of (siblings before, siblings after) from the bottom up."""
    proofs, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, w in enumerate(where):
            a, b = w // 8 * 8, min(len(nodes), w // 8 * 8 + 8)
            proofs[i].append((nodes[a:w], nodes[w + 1 : b]))
        nodes, where = [h(*nodes[a : a + 8]) for a in range(0, len(nodes), 8)], [w // 8 for w in where]
    return nodes[0], proofs


def by_hand(rows):
    """rows: doc_id, source, lang, n_chars, text."""
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    grown = {}
    for lang in order:
        mine = sorted(langs[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        grown[lang] = (mine, *grow([leaf(r) for r in mine]))
    if not order:
        return []
    root, upper = grow([grown[lang][1] for lang in order])
    out = []
    for lang, top in zip(order, upper):
        mine, subroot, proofs = grown[lang]
        for r, proof in zip(mine, proofs):
            proof = proof + top
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and text is not None:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            now = leaf((*r[:4], text))
            for before, after in proof:
                now = h(*before, now, *after)
            out.append((r[0], leaf(r), subroot, root, h(*[x for a, b in proof for x in a + b]), now, now == root))
    return out


def check(spark, rows, monkeypatch=None, size=None):
    if size:
        monkeypatch.setattr(manifest, "ROWS_PER_RANGE", size)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], KIND + ", tree string, at int")
    got = sorted((tuple(r) for r in manifest.manifest(df, manifest.tampered(df)).collect()), key=repr)
    assert got == sorted(by_hand(rows), key=repr)


def made(n, langs, seed=1):
    draw = random.Random(seed)
    return [(i * 3 - 5, draw.choice(["a", None, "é"]), draw.choice(langs), draw.choice([None, i]), draw.choice([None, "", "Text %d" % i, "aBc:É日"])) for i in range(n)]


@pytest.mark.parametrize("n,langs", [(1, ["en"]), (2, [None]), (9, ["en"]), (64, ["en"]), (65, ["en"]), (600, ["en", "de", None, "", "é", "z"])])
def test_trees_of_many_shapes(spark, n, langs):
    check(spark, made(n, langs))


def test_many_languages_make_an_upper_tree_of_levels(spark):
    check(spark, made(300, [f"l{i}" for i in range(150)]))


def test_ranges_change_nothing(spark, monkeypatch):
    check(spark, made(700, ["en", "en", "en", "de", None]), monkeypatch, 60)


def test_repeated_rows_ties_and_nulls(spark):
    rows = made(20, ["en", None]) + [(4, "a", "en", 1, "Same")] * 11 + [(None, None, None, None, None)] * 3 + [(4, "b", "en", 1, "Other"), (None, "a", "en", 2, "x")]
    check(spark, rows + [(9, "s", "en", 0, "A" * 300_000)])


def test_empty_table_and_proof(spark):
    assert manifest.manifest(spark.createDataFrame([], KIND)).collect() == []
    rows = made(30, ["en", "de"])
    for r in manifest.manifest(spark.createDataFrame(rows, KIND), give_proof=True).collect():
        assert r.verified
        x = r.leaf
        for s in r.proof:
            x = h(s.left, x, s.right)
        assert x == r.root


def test_generated_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    got = sorted(tuple(r) for r in QUERIES["op12_merkle_manifest"](spark, "/root/testdata/sf0.01").collect())
    assert got == sorted(by_hand([tuple(r) for r in docs.collect()]))
    assert 0 < sum(r[6] for r in got) < len(got)
