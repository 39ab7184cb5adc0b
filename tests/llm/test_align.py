import random
from collections import Counter
from hashlib import sha256

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from millrace.llm import align

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def byte_table():
    """A byte's character in the vocabulary: of the one-byte tokens, in the order the printable ones come first."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    table, more = {chr(b): b for b in shown}, 256
    for b in range(256):
        if b not in shown:
            table[chr(more)] = b
            more += 1
    return table


BYTES = byte_table()


def tokens(text):
    a = A.encode(" " + text, add_special_tokens=False)
    pieces = B.encode(text)
    ab = [bytes(BYTES[c] for c in t) for t in a.tokens]
    bb = [bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in pieces]
    return list(zip(a.ids, ab)), list(zip(pieces, bb))


def by_hand(texts):
    docs, count = [], Counter()
    for text in texts:
        a, b = tokens(text) if text else ([], [])
        whole = (" " + text).encode() if text else b""
        if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            a, b = [], []
        spans = []
        for side in (a, b):
            at, out = 0, []
            for i, raw in side:
                out.append((i, at, at + len(raw)))
                at += len(raw)
            spans.append(out)
        links = [(i, j) for i, s, e in spans[0] for j, u, v in spans[1] if s < v and u < e]
        count.update(links)
        both = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, last = [], 0
        for end in both:
            groups.append("|".join(",".join(str(i) for i, s, e in side if last <= s and e <= end) for side in spans))
            last = end
        docs.append((len(a), len(b), groups, links, both))
    top = {}
    for (_, b), n in count.items():
        top[b] = max(top.get(b, 0), n)
    out = []
    for n_a, n_b, groups, links, ends in docs:
        whole = ";".join(groups)
        digest = sha256(whole.encode()).hexdigest() if n_a else ""
        out.append((n_a, n_b, len(groups), len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links), digest, whole, ends))
    return out


def check(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, pairs int, row string")
    got = sorted((tuple(r) for r in align.align(df, give_groups=True, **kw).collect()), key=repr)
    want = sorted(((i, *w) for (i, _), w in zip(rows, by_hand([t for _, t in rows]))), key=repr)
    assert got == want


TRICKY = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a\n b", "a\n  b", "a \n b\t c", "héllo 日本 𝒳 <s> x\x00y", "日本語のテキスト", "<|endoftext|> and </s><unk>", "a▁b", "▁", "<0x41> <0xE3>",
    "é 👩‍👩‍👧 x", "it's don't I'LL  we're", "a  b 　c", "a\x85 b​ c﻿ d᠎ e", "x" * 3000, "1234567 89 0", "\n\n\n", "a\x1c b", "the the the", "Ünïcödé ſ İ ß", "\t \t x",
]


def test_tricky_texts(spark):
    check(spark, list(enumerate(TRICKY)) + [(3, "the the the"), (3, "the the the"), (None, "ab ab")])


def test_joined_counts_equal_the_broadcast_ones(spark):
    check(spark, list(enumerate(TRICKY)), most_sent=0)


def test_random_texts(spark):
    draw, letters = random.Random(3), ["a", "th", "on", " ", "  ", "\n", ".", "'s", "é", "日", "𝒳", "▁", " ", "0", "12", "\t", "-", "́", "<s>"]
    check(spark, [(i, "".join(draw.choices(letters, [9, 9, 9, 20, 2, 3, 3, 1, 3, 2, 1, 0.1, 1, 2, 2, 1, 2, 1, 0.5], k=draw.randint(0, 120)))) for i in range(400)])


def test_generated_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = [(i, t) for i, t in rows if len(t or "") < 4000] + [(-1, " ".join(t for _, t in rows[:8] if t))]
    check(spark, [(i, t if i >= 0 else t[:9000]) for i, t in rows])


def test_registered_query_on_all_documents(spark):
    from millrace.llm.queries import QUERIES

    got = QUERIES["op11_alignment"](spark, "/root/testdata/sf0.001").collect()
    rows = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert len(got) == len(rows)
    assert sum(r.n_a for r in got) == sum(len(tokens(t)[0]) for t in rows if t)
    assert sum(r.n_b for r in got) == sum(len(tokens(t)[1]) for t in rows if t)


def test_long_text_and_little_memory(spark, monkeypatch):
    draw = random.Random(4)
    text = " ".join("".join(draw.choices("thonéar日", k=draw.randint(1, 9))) for _ in range(60_000))
    got = align.align(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    a, b = tokens(text)
    assert (got.n_a, got.n_b) == (len(a), len(b))


def test_empty_table(spark):
    assert align.align(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("limit", [0, 3])
def test_forgetting_changes_nothing(limit, monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(TRICKY))), pa.array(TRICKY)], ["doc_id", "text"])
    monkeypatch.setattr(align, "CACHED", limit)
    one = [b.to_pylist() for b in align._aligned(None, None, False, True)(iter([batch, batch]))]
    assert one[0] == one[1]
