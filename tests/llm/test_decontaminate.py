import random
import re
from hashlib import sha256

from millrace.llm import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def split(text):
    return WORD.findall((text or "").translate(LOWER))


def by_hand(docs, items, window=13):
    windows = set()
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.add((tuple(w[i : i + window]), "" if item is None else str(item)))
    out = []
    for i, text in docs:
        w, hit, found = split(text), set(), set()
        for win, item in windows:
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    found.add(item)
        out.append((i, len(w), len(hit), len(found), sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def check(spark, docs, items, **kw):
    d = spark.createDataFrame([(*r, "clash", 1) for r in docs], "doc_id long, text string, items string, n_words int").repartition(3)
    b = spark.createDataFrame([(*r, "k") for r in items], "item_id long, text string, words string")
    got = sorted((tuple(r) for r in decontaminate.overlaps(d, b, **kw).collect()), key=repr)
    want = by_hand(docs, items)
    assert got == want
    kept = decontaminate.without_contaminated(d, b)
    assert kept.columns == d.columns
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(repr(w[0]) for w in want if not w[-1])


def made(seed, words="a b c d the of é Z9".split()):
    draw = random.Random(seed)
    text = lambda n: " ".join(draw.choices(words, k=n))
    items = [(i, text(draw.choice([0, 1, 2, 3, 5, 12, 13, 14, 40]))) for i in range(12)]
    docs = []
    for i in range(40):
        parts = [text(draw.randrange(30))]
        for _ in range(draw.randrange(3)):
            its = draw.choice(items)[1].split()
            at = draw.randrange(len(its) + 1)
            parts += [" ".join(its[max(0, at - 14) : at + 5]), text(draw.randrange(20))]
        docs.append((i, draw.choice([" ", ", "]).join(parts)))
    return docs, items


def test_random_texts_against_brute_force(spark):
    words = [f"w{i}" for i in range(300)]
    check(spark, *made(1, words))
    docs, items = made(2)
    check(spark, docs, items, block_words=40)


def test_odd_rows(spark):
    long = " ".join(f"q{i}" for i in range(40_000))
    thirteen = "One two three four five six seven eight nine ten eleven twelve thirteen"
    docs = [(1, None), (2, ""), (3, "!!"), (None, thirteen), (3, thirteen.upper()), (3, thirteen), (5, thirteen[4:]), (6, f"{long} {thirteen} {long}"), (7, "short item"), (8, "short  ITEM.")]
    items = [(1, thirteen), (1, "other words " + thirteen), (None, "short item"), (2, None), (3, "..."), (10, thirteen)]
    check(spark, docs, items)


def test_empty_tables(spark):
    check(spark, [(1, "a b c")], [])
    check(spark, [], [(1, "a b c")])
