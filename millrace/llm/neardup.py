"""Near-duplicate join on word shingles with Bayesian pruning of candidate pairs.

1. Every text becomes the set of its five-word shingles. Texts with equal sets are one node.
2. Bands of MinHash values that agree link nodes into candidate groups. A pair at the threshold is missed with a
   probability below 1e-7 (32 bands of 4), so this only says which nodes have to be compared.
3. Within a group, all pairs are compared in square tiles of bounded size, inside the tasks. MinHash values are compared
   sixteen at a time; after each step a pair is dropped when the posterior probability that it reaches the threshold
   (uniform prior) is below TOLERANCE. What is left is verified on the whole sets.
   Only texts of nodes in a group travel, and only to the tiles.
4. A tile returns one row for each node: its number of links and the smallest node it is linked with, directly or not.
   Pairs are never written out. The links give the classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.graph import components
from millrace.llm.sieve import Sieve
from millrace.llm.words import mixed, slices, words
from millrace.session import checkpoint

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 4
HASHES, STEP = BANDS * ROWS, 16
TOLERANCE = 1e-6
TILE = 1024  # nodes on one side of a tile

_draw = np.random.default_rng(7)
_TIMES = _draw.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _draw.integers(1, 2**63, HASHES, dtype=np.uint64)
_BAND = _draw.integers(1, 2**63, BANDS, dtype=np.uint64)


def shingle_sets(texts: pa.Array, n: int = WORDS) -> list[np.ndarray]:
    """The sorted shingle hashes of each text; a text of fewer words has one shingle of all of them, or none."""
    return [s for some in slices(texts) for s in _shingle_sets(some, n)]


def _shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    parsed = words(texts)
    value, at = parsed.shingles(n)
    owner = np.searchsorted(at, parsed.first)
    count, out = parsed.count(), []
    for i in range(len(texts)):
        if count[i] >= n:
            out.append(np.unique(value[owner[i] : owner[i + 1]]))
        elif count[i]:
            some = parsed.hash[parsed.first[i] : parsed.first[i + 1]]
            turn = np.uint64(0xD6E8FEB86659FD93) * np.arange(3, 2 * len(some) + 3, 2, dtype=np.uint64)
            out.append(mixed((some * turn).sum(keepdims=True) + np.uint64(len(some))))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, 2**32 - 1, np.uint64)
    for i in range(0, len(shingles), 1024):
        part = shingles[i : i + 1024, None] * _TIMES + _PLUS
        np.minimum(out, (part >> np.uint64(32)).min(axis=0), out=out)
    return out.astype(np.uint32)


def _signed(n: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, k2, sig = [], [], []
            for s in shingle_sets(b.column(1), n):
                k1.append(int(mixed(s).sum(dtype=np.uint64).view(np.int64)))
                k2.append(int(mixed(s ^ _PLUS[0]).sum(dtype=np.uint64).view(np.int64)) ^ len(s))
                sig.append(signature(s).tobytes() if len(s) else None)
            columns = [b.column(0), b.column(2), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "h", "k1", "k2", "sig"])

    return sign


def _bands(sig: pa.Array) -> pa.Array:
    rows = np.frombuffer(b"".join(sig.to_pylist()), np.uint64).reshape(-1, BANDS, ROWS // 2)
    out = np.zeros(rows.shape[:2], np.uint64) + _BAND
    for k in range(ROWS // 2):
        out = mixed(out + rows[:, :, k])
    return pa.FixedSizeListArray.from_arrays(pa.array(out.ravel().view(np.int64)), BANDS).cast(pa.list_(pa.int64()))


def fewest_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For each number n of compared values, the fewest matches m that keep a pair.

    With a uniform prior, the similarity after m matches of n is Beta(m + 1, n - m + 1), and the probability that it is
    at least t equals that of at most m successes in n + 1 draws of probability t.
    """
    out = []
    for n in range(HASHES + 1):
        reach, m = 0.0, -1
        while reach < tolerance:
            m += 1
            reach += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def _candidates(one: np.ndarray, two: np.ndarray, same: bool, need: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of two signature tables that survive the incremental comparison, some rows of `one` at a time."""
    block = max(1, 500_000 // max(1, len(two)))
    for begin in range(0, len(one), block):
        part = one[begin : begin + block]
        m = np.zeros((len(part), len(two)), np.int16)
        for k in range(STEP):
            m += part[:, k, None] == two[None, :, k]
        alive = m >= need[STEP]
        if same:
            alive &= np.arange(len(two))[None, :] > np.arange(begin, begin + len(part))[:, None]
        i, j = np.nonzero(alive)
        m = m[i, j].astype(np.int64)
        for at in range(STEP, HASHES, STEP):
            if not len(i):
                break
            m = m + (part[i, at : at + STEP] == two[j, at : at + STEP]).sum(axis=1)
            ok = m >= need[at + STEP]
            i, j, m = i[ok], j[ok], m[ok]
        yield i + begin, j


def _common(sets: list[np.ndarray], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets one[k] and two[k]."""
    used = np.unique(np.concatenate([one, two]))
    if len(one) <= 8 * len(used):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(one.tolist(), two.tolist())], np.int64)
    # Many pairs of few sets: number the shingles that two or more sets hold, and multiply incidence tables.
    values = np.concatenate([sets[u] for u in used])
    row = np.repeat(np.arange(len(used)), [len(sets[u]) for u in used])
    _, number, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = times > 1
    new = np.cumsum(shared) - 1
    row, number = row[shared[number]], new[number[shared[number]]]
    order = np.argsort(number, kind="stable")
    row, number = row[order], number[order]
    total = np.zeros((len(used), len(used)), np.float32)
    for begin in range(0, int(shared.sum()), 4096):
        lo, hi = np.searchsorted(number, [begin, begin + 4096])
        held = np.zeros((len(used), 4096), np.float32)
        held[row[lo:hi], number[lo:hi] - begin] = 1
        total += held @ held.T
    return total[np.searchsorted(used, one), np.searchsorted(used, two)].astype(np.int64)


def _group_links(sig: np.ndarray, sets: list[np.ndarray], copies: np.ndarray, left: np.ndarray, right: np.ndarray | None, t: Fraction, need: list[int]):
    """Links of each node, and the first node of what it is joined to."""
    size = np.array([len(s) for s in sets])
    links, label = np.zeros(len(sets), np.int64), np.arange(len(sets))
    pairs = []
    for i, j in _candidates(sig[left], sig[left if right is None else right], right is None, need):
        a, b = left[i], (left if right is None else right)[j]
        low, high = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
        ok = low * t.denominator >= high * t.numerator
        pairs.append((a[ok], b[ok]))
    a, b = (np.concatenate([p[k] for p in pairs]) for k in (0, 1)) if pairs else (np.empty(0, int), np.empty(0, int))
    if len(a):
        common = _common(sets, a, b)
        ok = common * (t.numerator + t.denominator) >= t.numerator * (size[a] + size[b])
        a, b = a[ok], b[ok]
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        while True:
            least = np.minimum(label[a], label[b])
            before = label.copy()
            np.minimum.at(label, a, least)
            np.minimum.at(label, b, least)
            label = label[label]
            if (label == before).all():
                break
    return links, label


def _tile_links(threshold: float, tolerance: float):
    t, need = Fraction(threshold).limit_denominator(1000), fewest_matches(threshold, tolerance)

    def tile(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        group, v, copies, part = (table.column(c).to_numpy() for c in ("root", "v", "copies", "part"))
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(-1, HASHES)
        sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
        one, two = table.column("one")[0].as_py(), table.column("two")[0].as_py()
        order = np.argsort(group, kind="stable")
        out: list[list[np.ndarray]] = [[], [], []]
        for its in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            inner = np.arange(len(its))
            if one == two:
                left, right = inner, None
            else:
                left, right = inner[part[its] == one], inner[part[its] == two]
            links, label = _group_links(sig[its], [sets[k] for k in its], copies[its], left, right, t, need)
            some = links > 0
            for column, x in zip(out, (v[its][some], v[its][label][some], links[some])):
                column.append(x)
        return pa.table({n: pa.array(np.concatenate(x), pa.int64()) for n, x in zip(("v", "to", "links"), out)})

    return tile


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))


def _row_hash(doc_id: str, h: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), h)


def _classes(docs: DataFrame, words_: int, threshold: float, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, h, k1, k2), and nodes that have copies or links: k1, k2, root, links, copies, first (doc_id, h)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = checkpoint(_keyed(docs).mapInArrow(_signed(words_), f"doc_id {kind}, h long, k1 long, k2 long, sig binary"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("first")
    nodes = checkpoint(rows.where("sig IS NOT NULL").groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.first("sig").alias("sig"), first))

    bands = nodes.select(F.col("k1").alias("v"), F.explode(F.arrow_udf(_bands, "array<bigint>")("sig")).alias("band"))
    # Written first, so that the join can be split at a band that very many nodes share.
    met = checkpoint(bands.groupBy("band").agg(F.min("v").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n"))
    groups = components(bands.join(met.hint("merge"), "band").select("a", F.col("v").alias("b")))
    # Written first as well: a group may hold a large share of all nodes.
    groups = checkpoint(groups)
    sizes = checkpoint(groups.groupBy("root").agg(F.count("*").alias("size")))
    member = nodes.join(groups.hint("merge"), nodes["k1"] == groups["v"]).join(sizes.hint("merge"), "root")
    member = checkpoint(member.select("root", "v", "copies", "sig", "first.doc_id", "first.h", F.ceil(F.col("size") / TILE).cast("int").alias("parts")))

    # The sets of the members come from their texts once more: only those travel.
    sieve = Sieve(member.select(_row_hash("doc_id", "h")))
    its = _keyed(docs).where(sieve.may_hold(_row_hash("doc_id", "h"))).alias("d")
    texts = its.join(member.alias("m").hint("merge"), F.col("d.h").eqNullSafe(F.col("m.h")) & F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")))
    texts = texts.select("root", "v", "copies", "sig", "parts", "d.text")

    @F.arrow_udf("binary")
    def packed(text: pa.Array) -> pa.Array:
        return pa.array([s.tobytes() for s in shingle_sets(text, words_)], pa.binary())

    members = texts.select("root", "v", "copies", "sig", "parts", packed("text").alias("shingles")).dropDuplicates(["v"])
    members = members.withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int"))
    n_buckets = max(1, member.count() // TILE)
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    tiles = members.withColumn("other", other).select(
        "*",
        F.least("part", "other").alias("one"),
        F.greatest("part", "other").alias("two"),
        F.when(F.col("parts") == 1, F.pmod(F.xxhash64("root"), F.lit(n_buckets))).otherwise(F.col("root")).alias("place"),
        (F.col("parts") > 1).alias("large"),
    )
    found = tiles.select("place", "large", "one", "two", "root", "v", "copies", "part", "sig", "shingles").groupBy("place", "large", "one", "two")
    links = checkpoint(found.applyInArrow(_tile_links(threshold, tolerance), "v long, to long, links long"))
    classes = components(links.select(F.col("v").alias("a"), F.col("to").alias("b")))
    linked = links.groupBy("v").agg(F.sum("links").alias("links")).join(classes.hint("merge"), "v", "left")
    some = nodes.drop("sig").join(linked.hint("merge"), F.col("k1") == F.col("v"), "left").where("copies > 1 OR links > 0")
    some = some.select("k1", "k2", "copies", "first", F.coalesce("root", "k1").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    return rows.drop("sig"), checkpoint(some)


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, class_id, n_links for every row of `docs` (doc_id, text).

    Two rows are linked if the Jaccard similarity of their sets of `words`-word shingles is `threshold` or more. n_links
    counts the other rows a row is linked with, copies included. A class is what links connect; class_id is its smallest
    doc_id. Texts without words, missing ones too, have no links; texts of fewer words have one shingle of all of them.
    Repeated rows are copies of each other. Missing ids come last. An empty table gives an empty result.
    """
    rows, nodes = _classes(docs, words, threshold, tolerance)
    ids = checkpoint(nodes.groupBy("root").agg(F.min("first").alias("least")))
    nodes = checkpoint(nodes.join(ids.hint("merge"), "root").select(F.col("k1").alias("n1"), F.col("k2").alias("n2"), F.col("least.doc_id").alias("its"), (F.col("links") + F.col("copies") - 1).alias("links")))
    out = rows.join(nodes.hint("merge"), (F.col("k1") == F.col("n1")) & (F.col("k2") == F.col("n2")), "left")
    known = F.col("links").isNotNull()
    return out.select("doc_id", F.when(known, F.col("its")).otherwise(F.col("doc_id")).alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def without_near_duplicates(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with one row of each class: that of the smallest id."""
    rows, nodes = _classes(docs, words, threshold, TOLERANCE)
    ids = checkpoint(nodes.groupBy("root").agg(F.min("first").alias("least")))
    nodes = nodes.join(ids.hint("merge"), "root").select(F.col("k1").alias("n1"), F.col("k2").alias("n2"), "least")
    both = rows.join(nodes.hint("merge"), (F.col("k1") == F.col("n1")) & (F.col("k2") == F.col("n2")))
    stays = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("h") == F.col("least.h"))
    judged = checkpoint(both.groupBy("doc_id", "h", stays.alias("stays")).agg(F.count("*").alias("n")))
    # Rows that stay for sure go straight through; the others meet the judgement.
    sieve = Sieve(judged.where("NOT stays OR n > 1").select(_row_hash("doc_id", "h")))
    doubt = _row_hash("i", "t")
    all_rows = docs.select(F.struct("*").alias("row"), docs["doc_id"].alias("i"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("t"))
    all_rows = all_rows.withColumn("doubt", sieve.may_hold(doubt))
    here = F.col("i").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("h"))
    doubtful = all_rows.where("doubt").join(judged.where("NOT stays").hint("merge"), here, "left_anti")
    again = judged.where("stays AND n > 1").drop("n")
    if not again.isEmpty():  # the same id with the same text: one of the equal rows
        doubtful = doubtful.join(again, here, "left_anti").unionByName(doubtful.join(again, here, "left_semi").dropDuplicates(["i", "t"]))
    return all_rows.where("NOT doubt").unionByName(doubtful).select("row.*")
