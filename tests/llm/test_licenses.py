import math
import re

from millrace.llm import licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


# The base phrases, spelled out here.
BASE = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}


def by_hand(texts):
    files = [WORD.findall((t or "").translate(LOWER)) for t in texts]
    df = lambda w: sum(w in f for f in map(set, files))
    vocabulary = {w for _, notice, _ in licenses.TEMPLATES for w in notice.split()}
    weight = {w: math.log((len(files) + 1) / (df(w) + 1)) for w in vocabulary}
    out = []
    for f in files:
        places, score, labels, base = [], 0.0, set(), set()
        for n, (label, notice, key) in enumerate(licenses.TEMPLATES):
            notice, key = notice.split(), key.split()
            lead = next(i for i in range(len(notice)) if notice[i : i + len(key)] == key)
            for s in range(len(f)):
                if f[s : s + len(key)] != key:
                    continue
                labels.add(label)
                got = sum(weight[w] for i, w in enumerate(notice) if 0 <= s - lead + i < len(f) and f[s - lead + i] == w)
                whole = sum(weight[w] for w in notice)
                score = max(score, min(1.0, got / whole) if whole > 0 else 1.0)
        for label, phrase in BASE.items():
            mine = [s for s in range(len(f)) if " ".join(f[s : s + len(phrase.split())]) == phrase]
            places += mine
            base |= {label} if mine else set()
            labels |= {label} if mine else set()
        out.append((len(f), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score))
    return out


def check(spark, texts, docs):
    got = sorted((tuple(r) for r in licenses.scan(docs).collect()), key=repr)
    want = sorted(((i, *w) for (i, _), w in zip(texts, by_hand([t for _, t in texts]))), key=repr)
    assert [g[:-1] for g in got] == [w[:-1] for w in want]
    assert all(abs(g[-1] - w[-1]) < 1e-5 for g, w in zip(got, want))


TRICKY = [
    None, "", "...", "THE MIT LICENSE", "Under the MIT License", "released under the mit license under the mit license", "the mit the mit license the-mit_license!", "Apache License, Version 2.0 and cc by-NC and CC BY SA 4.0", "the mit licensé",
    "Licensed under CC BY-NC 4.0.", "cc by nc cc by nc", "İthe mit license ſ", "mit license the mit", "GNU General Public License, version 3",
    "Permission is hereby granted, free of charge, to any person obtaining a copy", "x " * 40_000 + "the mit license " * 50, "the bsd license", "license",
]


def test_tricky_texts(spark):
    texts = list(enumerate(TRICKY)) + [(3, "the mit license"), (None, "the mit license"), (3, "the mit license")]
    check(spark, texts, spark.createDataFrame([(i, t, "clash", "k") for i, t in texts], "doc_id long, text string, words string, hits string"))


def test_generated_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check(spark, [(r.doc_id, r.text) for r in docs.collect()], docs)


def test_empty_table_and_only_sql_functions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert licenses.scan(docs.limit(0)).collect() == []
    plan = licenses.scan(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_whole_license_text_scores_one_and_a_part_less(spark):
    label, notice, _ = licenses.TEMPLATES[3]
    half = " ".join(notice.split()[:60])
    df = spark.createDataFrame([(1, notice), (2, half + " and so on"), (3, "nothing")], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert got[1].labels == got[2].labels == label and got[1].score == 1.0 and 0.1 < got[2].score < 0.9 and got[3].score == 0.0
