"""Row documents, keyword and vector search over them, and the extractive answer."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.cast import number
from millrace.functions.names import quoted, resolve

TOKEN = r"[a-zA-Z0-9_.]+"

# Words of a question that ask for trouble, and words of a row that tell of it.
TROUBLE_QUESTIONS = ("fail", "vibration", "temp", "why", "spike")
TROUBLE_ROWS = ("vibration", "fail")


def row_documents(df: DataFrame, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """(row_id, document): ``row_id=… | column=value | …``, missing values left out."""
    columns = list(columns or df.columns)
    parts = [F.concat(F.lit("row_id="), F.col(quoted(key)).cast("string"))]
    for n in columns:
        value = F.col(quoted(n)).cast("string")
        parts.append(F.when(value.isNotNull(), F.concat(F.lit(f"{n}="), value)))
    # concat_ws skips NULL parts.
    return df.select(F.col(quoted(key)).alias("row_id"), F.concat_ws(" | ", *parts).alias("document"))


def question_tokens(question: str) -> list[str]:
    return sorted(set(re.findall(TOKEN, (question or "").lower())))


def _score(document: Column, question: str) -> Column:
    low = F.lower(document)
    words = F.array_distinct(F.regexp_extract_all(low, F.lit(f"({TOKEN})"), 1))
    wanted = question_tokens(question)
    overlap = F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in wanted]))) if wanted else F.lit(0)
    if any(w in (question or "").lower() for w in TROUBLE_QUESTIONS):
        told = F.lit(False)
        for w in TROUBLE_ROWS:
            told = told | F.contains(low, F.lit(w))
        overlap = overlap + F.when(told, 2).otherwise(0)
    return overlap


def keyword_search(docs: DataFrame, question: str, top_k: int = 6, key: str = "row_id", text: str = "document") -> DataFrame:
    """The best documents by shared words; if none shares any, the first three with score 0."""
    scored = docs.select(F.col(quoted(key)).alias("row_id"), F.col(quoted(text)).alias("document"), _score(F.col(quoted(text)), question).alias("score"))
    ranked = scored.orderBy(F.desc("score"), "row_id").limit(max(top_k, 3))
    # A handful of rows from here on. Without any hit all scores are 0 and the order is that of the rows.
    whole = Window.partitionBy(F.lit(0))
    place = F.row_number().over(whole.orderBy(F.desc("score"), "row_id"))
    placed = ranked.withColumns({"place": place, "best": F.max("score").over(whole)})
    hit = (F.col("score") > 0) & (F.col("place") <= top_k)
    kept = placed.where(hit | ((F.col("best") <= 0) & (F.col("place") <= 3)))
    source = F.when(F.col("score") > 0, "keyword").otherwise("fallback")
    return kept.orderBy("place").select("row_id", "document", "score", source.alias("source"))


# Questions whose words are sent to the tasks at a time; more are asked in further passes over the documents.
BLOCK = 20_000
# (document, question) pairs that a task scores at a time.
PAIRS = 2_000_000


def keyword_search_many(docs: DataFrame, questions: DataFrame, top_k: int = 6, key: str = "row_id", text: str = "document", block: int = BLOCK) -> DataFrame:
    """The same for many questions (question_id, question) at once: question_id, row_id, score, rank.

    A block of questions goes to every task as an index from words to questions. A task keeps the best `top_k` documents of each
    question and lets go of what scores less than the last of them, so no more than that leaves it for the final ranking.
    Documents that share no word with a question are not listed for it.
    """
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(f"({TOKEN})"), 1))
    trouble = F.lit(False)
    for w in TROUBLE_QUESTIONS:
        trouble = trouble | F.contains(F.lower("question"), F.lit(w))
    told = F.lit(False)
    for w in TROUBLE_ROWS:
        told = told | F.contains(F.lower(F.col(quoted(text))), F.lit(w))
    asked = questions.select("question_id", tokens(F.col("question")).alias("words"), F.coalesce(trouble, F.lit(False)).alias("asks"))
    read = docs.select(F.col(quoted(key)).alias("row_id"), tokens(F.col(quoted(text))).alias("words"), F.coalesce(told, F.lit(False)).alias("told"))
    kinds = [f.schema[c].dataType.simpleString() for f, c in ((asked, "question_id"), (read, "row_id"))]
    schema = f"question_id {kinds[0]}, row_id {kinds[1]}, score int"
    blocks = max(1, math.ceil(asked.count() / block))
    found = []
    for b in range(blocks):
        some = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == b)
        found.append(read.mapInArrow(_ranked(some.toArrow(), top_k), schema))
    best = Window.partitionBy("question_id").orderBy(F.desc("score"), "row_id")
    every = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(best))
    return every.where(F.col("rank") <= top_k)


def _ranked(questions: pa.Table, top_k: int):
    """Keep the best documents of each question while the documents go by."""
    names, asks = questions["question_id"].combine_chunks(), np.asarray(questions["asks"], bool)
    lists = questions["words"].combine_chunks()
    words = lists.flatten().dictionary_encode()
    owner = np.repeat(np.arange(len(names)), np.asarray(lists.value_lengths().fill_null(0), np.int64))
    order = np.argsort(np.asarray(words.indices), kind="stable")
    asking, vocabulary = owner[order], words.dictionary
    size = np.bincount(np.asarray(words.indices), minlength=len(vocabulary))
    first = np.cumsum(size) - size

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = pd.DataFrame({"q": np.empty(0, np.int64), "row_id": [], "score": np.empty(0, np.int64)})
        least = np.zeros(len(names), np.int64)  # the score of the last document kept, 0 before there are enough
        kind = None
        for b in batches:
            kind = b.column(0).type
            ids, told = b.column(0).to_pandas(), np.asarray(b.column(2), bool)
            lengths = np.asarray(b.column(1).value_lengths().fill_null(0), np.int64)
            flat = b.column(1).flatten()
            place = pc.index_in(flat, value_set=vocabulary.cast(flat.type))
            doc = np.repeat(np.arange(len(ids)), lengths)[np.asarray(place.is_valid())]
            word = np.asarray(place.drop_null(), np.int64)
            load = np.cumsum(size[word])
            cuts = np.searchsorted(load, np.arange(PAIRS, load[-1] if len(load) else 0, PAIRS))
            # A cut never goes through a document.
            edges = np.unique([0, *np.searchsorted(doc, doc[cuts]).tolist(), len(doc)])
            for s, e in zip(edges, edges[1:]):
                n = size[word[s:e]]
                total = np.cumsum(n)
                question = asking[np.arange(total[-1]) + np.repeat(first[word[s:e]] - (total - n), n)]
                pair, score = np.unique(np.repeat(doc[s:e], n) * len(names) + question, return_counts=True)
                d, q = pair // len(names), pair % len(names)
                score = score + 2 * (asks[q] & told[d])
                fair = score >= least[q]
                new = pd.DataFrame({"q": q[fair], "row_id": ids.iloc[d[fair]].to_numpy(), "score": score[fair]})
                kept = pd.concat([kept, new]) if len(kept) else new
                kept = kept.sort_values(["q", "score", "row_id"], ascending=[True, False, True]).groupby("q").head(top_k)
                full = kept.groupby("q")["score"].agg(["size", "min"])
                full = full[full["size"] == top_k]
                least[full.index.to_numpy(np.int64)] = full["min"]
        if len(kept):
            columns = [names.take(pa.array(kept["q"].to_numpy())), pa.array(kept["row_id"], kind), pa.array(kept["score"].to_numpy(), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["question_id", "row_id", "score"])

    return rank


def cosine(a: Column, b: Column) -> Column:
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def vector_search(points: DataFrame, query: Sequence[float], key: str, vector: str, top_k: int = 6) -> DataFrame:
    """The nearest rows by cosine, exact: one scan with a top-k at its end."""
    wanted = F.array(*[F.lit(float(v)) for v in query])
    scored = points.select(F.col(quoted(key)).alias(key), cosine(F.col(quoted(vector)).cast("array<double>"), wanted).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(top_k)


def extract_answer(df: DataFrame, question: str) -> DataFrame:
    """One row: peak vibration and temperature of the machine named in the question, as a sentence."""
    low = (question or "").lower()
    machine = resolve(df.columns, "machine_id", "machine", "asset_id")
    vib, temp = resolve(df.columns, "vibration", "vib"), resolve(df.columns, "temperature", "temp")
    named = re.search(r"machine\s*([a-zA-Z0-9_-]+)", low)
    asked = named.group(1) if named else None
    if not (("fail" in low or "why" in low) and (machine or vib)):
        return df.agg(F.format_string("The table has %d rows. Ask about a machine, KPI or column.", F.count("*")).alias("answer"))
    mine = F.lit(False)
    if asked and machine:
        mine = F.coalesce(F.contains(F.lower(F.col(quoted(machine)).cast("string")), F.lit(asked.lower())), F.lit(False))
    peaks = []
    for name, column in (("vib", vib), ("temp", temp)):
        x = number(df, column) if column else F.lit(None).cast("double")
        # When no row names the machine the whole table answers.
        peaks += [F.max(F.when(mine, x)).alias(f"{name}_mine"), F.max(x).alias(f"{name}_all")]
    one = df.agg(F.count_if(mine).alias("rows_mine"), *peaks)
    pick = lambda n: F.when(F.col("rows_mine") > 0, F.col(f"{n}_mine")).otherwise(F.col(f"{n}_all"))
    facts = F.concat_ws(
        ", ",
        F.when(pick("vib").isNotNull(), F.format_string("vibration reached %.2f", pick("vib"))),
        F.when(pick("temp").isNotNull(), F.format_string("temperature peaked at %.2f", pick("temp"))),
    )
    who = f"Machine {asked}" if asked else "The asset"
    text = F.concat(F.lit(f"{who} likely failed because "), F.when(facts == "", "sensor anomalies in the rows").otherwise(facts), F.lit(". Inspect bearings and schedule maintenance."))
    return one.select(text.alias("answer"), pick("vib").alias("peak_vibration"), pick("temp").alias("peak_temperature"))
