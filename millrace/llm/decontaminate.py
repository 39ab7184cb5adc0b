"""Benchmark decontamination as a prefix-filtered join of word shingles.

A window is 13 words in a row of a benchmark item, or the whole of a shorter item. A document can hold a window only if
it holds every shingle of it, so one shingle is enough to join on: the rarest, by its count over all documents. Each
meeting gives one place where the window would stand. Places that reach over an end of the document are dropped, and
the rest are verified word by word and then byte by byte.

The benchmark is handled in blocks of a bounded number of words, each sent to the tasks; the documents pass through the
blocks in one stage and are never shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.words import slices, spare_name, word_array, words

WINDOW = 13
SHINGLE = 3
BLOCK_WORDS = 1_000_000  # words of one block, about 150 MB in a task; one longer item makes a larger block

MARKS = "struct<n_words: bigint, n_hit: bigint, spans: binary, items: array<string>>"


@dataclass
class Block:
    """Distinct windows of some items. Arrays of windows run in parallel."""

    text: list[bytes]  # the words, with a space between
    size: np.ndarray
    words: np.ndarray  # (windows, WINDOW) word hashes, 0 beyond a short window
    items: list[list[str]]  # the items that have the window
    shingles: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # words in a shingle -> hashes, windows, offsets
    probes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # -> hashes, first entry, windows, offsets


def _block(rows: list[tuple[str, list[str]]], window: int) -> Block:
    owners: dict[tuple[str, ...], set[str]] = defaultdict(set)
    for item, its in rows:
        for i in range(max(1, len(its) - window + 1) if its else 0):
            owners[tuple(its[i : i + window])].add(item)
    listed = sorted(owners)
    text = [" ".join(w).encode() for w in listed]
    parsed = words(pa.array([t.decode() for t in text], pa.string()))
    size = parsed.count()
    table = np.zeros((len(listed), window), np.uint64)
    for n in range(len(listed)):
        table[n, : size[n]] = parsed.hash[parsed.first[n] : parsed.first[n + 1]]
    shingles = {}
    owner = parsed.text_of()
    for n in range(1, SHINGLE + 1):
        value, at = parsed.shingles(n)
        of = owner[at]
        mine = np.minimum(size[of], SHINGLE) == n
        if mine.any():
            shingles[n] = (value[mine], of[mine], (at - parsed.first[of])[mine])
    return Block(text, size, table, [sorted(owners[w]) for w in listed], shingles, {})


def _counted(block: Block):
    """A function from batches of texts to (shingle size, hash, count) of the block's shingles in them."""
    known = {n: np.unique(value) for n, (value, _, _) in block.shingles.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {n: np.zeros(len(v), np.int64) for n, v in known.items()}
        for some in (some for batch in batches for some in slices(batch.column(0))):
            parsed = words(some)
            for n, values in known.items():
                found, _ = parsed.shingles(n)
                place = np.minimum(np.searchsorted(values, found), len(values) - 1)
                total[n] += np.bincount(place[values[place] == found], minlength=len(values))
        for n, values in known.items():
            some = total[n] > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(some.sum(), n), pa.int32()), pa.array(values[some].view(np.int64)), pa.array(total[n][some])], ["n", "shingle", "held"]
            )

    return count


def _with_probes(block: Block, held: dict[tuple[int, int], int]) -> Block:
    """Index every window by its rarest shingle, the first of equals."""
    for n, (value, of, offset) in block.shingles.items():
        rarity = np.array([held.get((n, v), 0) for v in value.view(np.int64).tolist()])
        order = np.lexsort((offset, rarity, of))
        pick = order[np.unique(of[order], return_index=True)[1]]
        pick = pick[rarity[pick] > 0]  # a shingle that is nowhere rules its windows out
        pick = pick[np.argsort(value[pick], kind="stable")]
        hashes, first = np.unique(value[pick], return_index=True)
        if len(hashes):
            block.probes[n] = (hashes, np.append(first, len(pick)), of[pick], offset[pick])
    block.shingles = {}
    return block


def _marks(block: Block, texts: pa.Array, before: pa.Array | None) -> pa.Array:
    parts, at = [], 0
    for some in slices(texts):
        parts.append(_marked(block, some, None if before is None else before.slice(at, len(some))))
        at += len(some)
    return pa.concat_arrays(parts) if parts else _marked(block, texts, before)


def _marked(block: Block, texts: pa.Array, before: pa.Array | None) -> pa.Array:
    parsed = words(texts)
    owner = parsed.text_of()
    places, windows = [], []
    for n, (hashes, first, of, offset) in block.probes.items():
        value, at = parsed.shingles(n)
        probe = np.minimum(np.searchsorted(hashes, value), len(hashes) - 1)
        met = np.flatnonzero(hashes[probe] == value)
        probe, at = probe[met], at[met]
        times = first[probe + 1] - first[probe]
        entry = np.repeat(first[probe], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        start, window, text = np.repeat(at, times) - offset[entry], of[entry], owner[np.repeat(at, times)]
        inside = (start >= parsed.first[text]) & (start + block.size[window] <= parsed.first[text + 1])
        start, window = start[inside], window[inside]
        for k in range(block.words.shape[1]):
            same = (k >= block.size[window]) | (parsed.hash[np.minimum(start + k, len(parsed.hash) - 1)] == block.words[window, k])
            start, window = start[same], window[same]
        places.append(start)
        windows.append(window)
    spans: list[list[tuple[int, int]]] = [[] for _ in range(len(texts))]
    items: list[set[str]] = [set() for _ in range(len(texts))]
    if places:
        for start, window in zip(np.concatenate(places).tolist(), np.concatenate(windows).tolist()):
            size = int(block.size[window])
            if parsed.word(start, size) == block.text[window]:
                text = int(owner[start])
                spans[text].append((start - int(parsed.first[text]), start - int(parsed.first[text]) + size))
                items[text].update(block.items[window])
    if before is not None:
        for i, (old, had) in enumerate(zip(before.field("spans").to_pylist(), before.field("items").to_pylist())):
            spans[i] += np.frombuffer(old, np.int64).reshape(-1, 2).tolist()
            items[i].update(had)
    hit, packed = [], []
    for some in spans:
        merged: list[list[int]] = []
        for begin, end in sorted(map(tuple, some)):
            if merged and begin <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], end)
            else:
                merged.append([begin, end])
        hit.append(sum(e - b for b, e in merged))
        packed.append(np.array(merged, np.int64).tobytes())
    columns = [pa.array(parsed.count(), pa.int64()), pa.array(hit, pa.int64()), pa.array(packed, pa.binary()), pa.array([sorted(s) for s in items], pa.list_(pa.string()))]
    return pa.StructArray.from_arrays(columns, ["n_words", "n_hit", "spans", "items"])


def mark(docs: DataFrame, benchmark: DataFrame, name: str, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """`docs` (text) with a struct column `name`: n_words, n_hit, spans (merged word ranges) and items of each row."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), word_array(benchmark["text"]).alias("words"))
    total = items.agg(F.sum(F.size("words"))).first()[0] or 0
    n_blocks = -(-total // block_words)
    texts = docs.select("text")
    struct = None
    for b in range(max(1, n_blocks)):
        mine = items.where(F.pmod(F.xxhash64("item"), F.lit(max(1, n_blocks))) == b).where(F.size("words") > 0)
        block = _block([(r.item, r.words) for r in mine.collect()], window)
        sums = texts.mapInArrow(_counted(block), "n int, shingle long, held long").groupBy("n", "shingle").agg(F.sum("held").alias("held"))
        block = _with_probes(block, {(r.n, r.shingle): r.held for r in sums.collect()} if block.shingles else {})
        sent = spark.sparkContext.broadcast(block)
        if struct is None:
            struct = F.arrow_udf(_first(sent), MARKS)("text")
        else:
            struct = F.arrow_udf(_further(sent), MARKS)("text", struct)
    return docs.withColumn(name, struct)


def _first(sent):
    def marked(text: pa.Array) -> pa.Array:
        return _marks(sent.value, text, None)

    return marked


def _further(sent):
    def marked(text: pa.Array, before: pa.Array) -> pa.Array:
        return _marks(sent.value, text, before)

    return marked


def contaminated(n_words, n_hit):
    """A twentieth of the words or more."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of `docs` (doc_id, text).

    n_hit counts the words inside any window of any item of `benchmark` (item_id, text), each once. Missing texts have
    no words; items without words have no window; a missing item_id counts as an empty one, repeated ones as one item.
    Empty tables on either side give no hits, or no rows. Repeated rows repeat.
    """
    out = mark(docs.select("doc_id", "text"), benchmark, "marks", window, block_words)
    out = out.select("doc_id", "marks.n_words", "marks.n_hit", "marks.items")
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that are not contaminated."""
    (name,) = spare_name(docs, "marks")
    out = mark(docs, benchmark, name)
    return out.where(~contaminated(F.col(f"{name}.n_words"), F.col(f"{name}.n_hit"))).drop(name)
