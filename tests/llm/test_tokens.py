import random

import pytest
import sentencepiece

from millrace.llm import tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "a", " a", "a ", "  a  b   c ", "\n\t x\r\n", "▁", "a▁b ▁▁ c", "<s> </s><unk> <0x0A>", "日本語 text ñandú 😀", "\x00\x01", "word" * 50 + " end", "ﬁ Å é"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_count_equals_library(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in tokens.count_tokens(docs).collect():
        assert (r.n_bytes, r.n_tokens) == (len(texts[r.doc_id].encode()), len(library.encode(texts[r.doc_id])))
        assert r.over_limit == (r.n_tokens > 4096)


def test_odd_texts_nulls_and_repeated_rows(spark, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(1, None), (None, "x"), (2, "a"), (99, "long " * 30_000)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, n_tokens string")
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in tokens.count_tokens(docs).collect()), key=repr)
    want = sorted(((i, len((t or "").encode()), len(library.encode(t or ""))) for i, t in rows), key=repr)
    assert got == want
    assert tokens.count_tokens(docs.limit(0)).collect() == []


def test_every_prefix_is_exact(spark, library):
    draw = random.Random(5)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(12).collect()
    c = tokens.counter(MODEL)
    for text in ODD[:-2] + [r.text[:300] for r in docs] + ["".join(draw.choices("ab ▁ñé日 the", k=60)) for _ in range(30)]:
        want = [len(library.encode(text[:i])) for i in range(len(text) + 1)]
        assert c.everywhere(text).tolist() == want
        ends, counts = c.at_boundaries(text)
        assert [want[e] for e in ends] == counts.tolist()
        for budget in (0, 1, 3, 10, 40):
            assert c.cut(text, budget) == max(i for i in range(len(want)) if want[i] <= budget)


def test_cut_and_stored_prefixes(spark, library):
    docs = spark.createDataFrame([(1, "one two three four"), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in tokens.cut_to_budget(docs, 2).collect()}
    assert got[2] is None and got[3] == "" and len(library.encode(got[1])) <= 2
    stored = {r.doc_id: (r.chars, r.tokens) for r in tokens.token_prefixes(docs).collect()}
    assert stored[1] == ([0, 3, 7, 13, 18], [0] + [len(library.encode("one two three four"[:i])) for i in (3, 7, 13, 18)])
