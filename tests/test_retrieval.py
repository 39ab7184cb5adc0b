import random
import re

import pytest

from millrace.operators import retrieval as rt


def by_hand(docs, questions, k):
    out = []
    words = lambda t: set(re.findall(rt.TOKEN, (t or "").lower()))
    for q, text in questions:
        scored = []
        for d, t in docs:
            n = len(words(text) & words(t))
            if n and any(w in text.lower() for w in rt.TROUBLE_QUESTIONS) and any(w in t.lower() for w in rt.TROUBLE_ROWS):
                n += 2
            if n:
                scored.append((-n, d))
        out += [(q, d, -n, i + 1) for i, (n, d) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("block,pairs", [(20_000, 2_000_000), (7, 40)])
def test_many_questions_equal_one_by_one(spark, monkeypatch, block, pairs):
    """Common and rare words, ties, documents and questions without words, in one block and in several."""
    monkeypatch.setattr(rt, "PAIRS", pairs)
    draw = random.Random(3)
    words = ["the", "the", "the", "pump", "Vibration", "fail", "why", "M1", "heat", "x.1", "!", ""]
    docs = [(i, " ".join(draw.choices(words, k=draw.randint(0, 7)))) for i in range(150)] + [(900, None)]
    questions = [(f"q{i}", " ".join(draw.choices(words, k=draw.randint(0, 5)))) for i in range(40)]
    got = rt.keyword_search_many(
        spark.createDataFrame(docs, "row_id long, document string").repartition(3), spark.createDataFrame(questions, "question_id string, question string"), 4, block=block
    )
    assert sorted((r["question_id"], r["row_id"], r["score"], r["rank"]) for r in got.collect()) == by_hand([(d, t or "") for d, t in docs], questions, 4)


def test_only_the_best_of_a_task_are_shuffled(spark):
    docs = spark.range(4000).selectExpr("id AS row_id", "'the same words' AS document").repartition(4)
    questions = spark.range(30).selectExpr("id AS question_id", "'the words' AS question")
    found = rt._ranked(questions.selectExpr("question_id", "split(question, ' ') AS words", "false AS asks").toArrow(), 5)
    left = docs.selectExpr("row_id", "split(document, ' ') AS words", "false AS told").mapInArrow(found, "question_id long, row_id long, score int")
    assert left.count() == 4 * 30 * 5
    got = rt.keyword_search_many(docs, questions, 5).collect()
    assert len(got) == 150 and {r["row_id"] for r in got} == set(range(5))
