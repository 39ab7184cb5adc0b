"""Remove repeated strings with a sparse suffix array, merged from front-coded sorted runs.

A window is a string of SPAN bytes. The GRAM bytes of the lowest hash in a window (the last of equals) are its anchor,
so equal windows have equal anchors at equal offsets, and consecutive windows mostly share theirs: about one suffix in
140 is an anchored one, and only these are sorted.

1. Anchors are counted by the hash of their gram. An anchor that stands once owns no repeated window. Anchors with the
   same gram whose whole context (what their windows cover) is the same own repeated windows only. Neither is sorted.
2. For the rest, the suffix from the anchor, cut where its last window ends, then what precedes the anchor backwards, is
   one string. Each task sorts its strings into runs and sends them front-coded, by ranges of the sort order.
3. Each range merges its runs with a loser tree that keeps, for every loser, the length of the prefix it shares with
   the winner. Prefixes known to be equal are not looked at again, and the shared lengths come out with the order.
4. Two windows with an anchor at offset a are equal if the suffixes share SPAN - a bytes and the a bytes before are equal:
   runs of the sorted suffixes on one side and of the backward contexts on the other, for each a.
5. A window whose suffixes may go on beyond its range is decided by counting its 128-bit hash over all ranges. So a string
   that very many texts share needs no task of its own.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.sieve import Sieve, tested
from millrace.llm.words import flat, mixed
from millrace.session import checkpoint

SPAN, GRAM = 400, 128
PLACES = SPAN - GRAM + 1  # offsets an anchor can have in a window
CHUNK = 1 << 17  # windows hashed at a time
PORTION = 1_000_000  # bytes of texts looked at together
RUN_BYTES = 16_000_000  # strings of one sorted run
RANGE = 20_000  # strings of one range
END = b"\xff"  # in no UTF-8 text, and above every byte of one

_BYTE = np.random.default_rng(31).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOW = np.uint64((1 << 20) - 1)


def anchors(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, first window, last window, gram hash) of every anchor of the texts that stand in `data` at `at`."""
    n = len(data) - SPAN + 1
    nothing = np.empty(0, np.int64)
    if n <= 0:
        return nothing, nothing, nothing, np.empty(0, np.uint64)
    inside = np.ones(n, bool)
    for begin, end in zip(at[:-1].tolist(), at[1:].tolist()):
        inside[max(begin, end - SPAN + 1) : end] = False
    out: list[list[np.ndarray]] = [[], [], [], []]
    for c in range(0, n, CHUNK):
        some = np.flatnonzero(inside[c : c + CHUNK])
        if not len(some):
            continue
        h, power, m = _BYTE[data[c : c + CHUNK + SPAN - 1]], np.uint64(0x9E3779B97F4A7C15), 1
        with np.errstate(over="ignore"):
            while m < GRAM:
                h = h[:-m] * power + h[m:]
                power, m = power * power, 2 * m
        h = mixed(h)
        low = (h & ~_LOW) | (_LOW - np.arange(len(h), dtype=np.uint64))
        m = 1
        while 2 * m <= PLACES:
            low, m = np.minimum(low[:-m], low[m:]), 2 * m
        if m < PLACES:
            low = np.minimum(low[: m - PLACES], low[PLACES - m :])
        place = (_LOW - (low[some] & _LOW)).astype(np.int64)
        first = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (some[1:] != some[:-1] + 1)))
        last = np.append(first[1:], len(some)) - 1
        for column, x in zip(out, (place[first] + c, some[first] + c, some[last] + c, h[place[first]])):
            column.append(x)
    if not out[0]:
        return nothing, nothing, nothing, np.empty(0, np.uint64)
    place, first, last, h = (np.concatenate(x) for x in out)
    # An anchor's windows may go on in the next chunk.
    new = np.append(True, (place[1:] != place[:-1]) | (first[1:] != last[:-1] + 1))
    begin = np.flatnonzero(new)
    return place[begin], first[begin], last[np.append(begin[1:], len(place)) - 1], h[begin]


def _portions(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Some texts at a time: number of the first, bytes, places."""
    data, at = flat(texts)
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + PORTION, "right")) - 1)
        yield begin, data[at[begin] : at[end]], at[begin : end + 1] - at[begin]
        begin = end


def _context_hash(context, offset: int) -> bytes:
    return xxhash.xxh3_128_digest(context, seed=offset)


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for begin, data, at in _portions(b.column(1)):
            place, first, last, h = anchors(data, at)
            if not len(place):
                continue
            view, digests = memoryview(data.tobytes()), []
            for s, e, offset in zip(first.tolist(), (last + SPAN).tolist(), (place - first).tolist()):
                digests.append(_context_hash(view[s:e], offset))
            c = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            text = np.searchsorted(at, place, "right") - 1
            row = pa.array(text + begin)
            columns = [b.column(0).take(row), b.column(2).take(row), pa.array(place - at[text]), pa.array((place - last).astype(np.int16)), pa.array((place - first).astype(np.int16))]
            columns += [pa.array(h.view(np.int64)), pa.array(c[:, 0].copy()), pa.array(c[:, 1].copy())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "place", "low", "high", "h", "c1", "c2"])


def _strings(texts: pa.Array, bits: np.ndarray) -> Iterator[bytes]:
    """For each anchor whose gram passes: the suffix from it, END, and backwards what its windows hold before it."""
    for _, data, at in _portions(texts):
        place, first, last, h = anchors(data, at)
        some = np.flatnonzero(tested(bits, h))
        raw = data.tobytes()
        for p, s, e in zip(place[some].tolist(), first[some].tolist(), (last[some] + SPAN).tolist()):
            yield raw[p:e] + END + raw[s:p][::-1]


def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """The length of the common prefix, of which `known` bytes are not looked at."""
    n, step = min(len(a), len(b)), 32
    while known < n:
        x, y = a[known : known + step], b[known : known + step]
        if x != y:
            m = min(len(x), len(y))
            differ = int.from_bytes(x[:m], "big") ^ int.from_bytes(y[:m], "big")
            return known + (m - (differ.bit_length() + 7) // 8)
        known, step = known + step, 2 * step
    return n


def encoded(run: list[bytes]) -> bytes:
    """A sorted run, each string as the length it shares with the one before, and the rest."""
    common = np.array([0] + [shared(a, b) for a, b in zip(run, run[1:])], np.uint16)[: len(run)]
    rest = np.array([len(s) for s in run], np.uint16) - common
    head = np.array([len(run)], np.uint32).tobytes() + common.tobytes() + rest.tobytes()
    return head + b"".join(s[c:] for s, c in zip(run, common.tolist()))


def decoded(blob: bytes) -> Iterator[tuple[bytes, int]]:
    """The strings of a run, with what each shares with the one before."""
    n = int(np.frombuffer(blob[:4], np.uint32)[0])
    common, rest = (np.frombuffer(blob, np.uint16, n, 4 + 2 * n * k).tolist() for k in (0, 1))
    at, last = 4 + 4 * n, b""
    for c, r in zip(common, rest):
        last = last[:c] + blob[at : at + r]
        at += r
        yield last, c


def merged(runs: list[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[bytes, int]]:
    """All strings of sorted runs in order, each with the length it shares with the one before (loser tree).

    A node keeps the loser of its match and what that shares with the winner. A new string shares a known length with
    the one just put out, as does every loser on its way up, so a match compares lengths first, and bytes only beyond equal ones.
    """
    k = 1 << max(0, (len(runs) - 1).bit_length())
    now: list[bytes | None] = [None] * k
    known = [0] * k

    def advance(i: int) -> None:
        now[i], known[i] = next(runs[i], (None, 0)) if i < len(runs) else (None, 0)

    def match(a: int, b: int) -> tuple[int, int]:
        x, y = now[a], now[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        n = shared(x, y, known[a])
        if x[n : n + 1] <= y[n : n + 1]:
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    for i in range(k):
        advance(i)
    winners, losers = [0] * k + list(range(k)), [0] * k
    for node in range(k - 1, 0, -1):
        winners[node], losers[node] = match(winners[2 * node], winners[2 * node + 1])
    best = winners[1]
    while now[best] is not None:
        yield now[best], known[best]
        advance(best)
        node = (best + k) // 2
        while node:
            best, losers[node] = match(best, losers[node])
            node //= 2


def _runs(sent, cuts: list[bytes]):
    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(strings: set[bytes]) -> Iterator[pa.RecordBatch]:
            run = sorted(strings)
            edges = [0, *(bisect_right(run, c) for c in cuts), len(run)]
            parts = [(i, encoded(run[a:b])) for i, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())], ["range", "run"])

        strings: set[bytes] = set()
        size = 0
        for b in batches:
            for s in _strings(b.column(0), sent.value):
                if s not in strings:
                    strings.add(s)
                    size += len(s)
                    if size > RUN_BYTES:
                        yield from out(strings)
                        strings, size = set(), 0
        yield from out(strings)

    return sort


def repeated_offsets(strings: list[bytes], common: list[int]) -> np.ndarray:
    """(strings, PLACES): whether the window with its anchor at offset a is that of another string too.

    `strings` are distinct and in order, `common` what each shares with the one before.
    """
    n = len(strings)
    right = np.array([s.index(END) for s in strings])
    back = [s[r + 1 :] for s, r in zip(strings, right.tolist())]
    low, high = SPAN - right, np.array([len(b) for b in back])
    suffix = np.minimum(np.array(common), right)
    suffix[1:] = np.minimum(suffix[1:], right[:-1])
    gram = np.cumsum(suffix < GRAM)
    order = sorted(range(n), key=lambda i: (gram[i], back[i]))
    before = np.array([-1] + [shared(back[i], back[j]) if gram[i] == gram[j] else -1 for i, j in zip(order, order[1:])])
    out, left = np.zeros((n, PLACES), bool), np.zeros(n, np.int64)
    for a in range(PLACES):
        some = np.flatnonzero((low <= a) & (a <= high))
        if len(some) < 2:
            continue
        left[order] = np.cumsum(before < a)
        both = np.cumsum(suffix < SPAN - a)[some] * (n + 1) + left[some]
        _, which, times = np.unique(both, return_inverse=True, return_counts=True)
        out[some, a] = times[which] > 1
    return out


def _judged(cuts: list[bytes]):
    def judge(table: pa.Table) -> pa.Table:
        number = table.column("range")[0].as_py()
        edges = [cuts[i] for i in (number - 1, number) if 0 <= i < len(cuts)]
        strings, common, least = [], [], 0
        for s, c in merged([decoded(r) for r in table.column("run").to_pylist()]):
            if strings and c == len(s) == len(strings[-1]):
                continue
            strings.append(s)
            common.append(c)
        found = repeated_offsets(strings, common)
        rows: list[tuple] = []
        for i, s in enumerate(strings):
            right = s.index(END)
            back = s[right + 1 :][::-1]
            reach = min(right, max((shared(s, e) for e in edges), default=0))
            c = np.frombuffer(_context_hash(back + s[:right], len(back)), ">i8").tolist()
            edge = np.flatnonzero(np.diff(np.concatenate([[0], found[i].view(np.int8), [0]])))
            rows += [(*c, a, b - 1, None, None) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]
            for a in range(max(SPAN - right, SPAN - reach), len(back) + 1) if reach >= GRAM else ():
                if not found[i, a]:
                    w = xxhash.xxh3_128_digest(back[len(back) - a :] + s[: SPAN - a], seed=a)
                    rows.append((*c, a, a, *np.frombuffer(w, ">i8").tolist()))
                else:  # it may still be what a string of another range looks for
                    w = xxhash.xxh3_128_digest(back[len(back) - a :] + s[: SPAN - a], seed=a)
                    rows.append((*c, -1, -1, *np.frombuffer(w, ">i8").tolist()))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        columns = list(zip(*rows)) or [()] * 6
        return pa.table({n: pa.array(x, k) for n, x, k in zip(("c1", "c2", "begin", "end", "w1", "w2"), columns, kinds)})

    return judge


def _sorted_out(texts: DataFrame, mixed_grams: DataFrame, n: int) -> DataFrame:
    """(c1, c2, begin, end): offsets a of repeated windows, by context, for grams with several contexts."""
    sent = Sieve(mixed_grams.select("h"), n).sent
    ranges, cuts = -(-n // RANGE), []
    if ranges > 1:
        # The cuts only balance the ranges; a few strings from some texts are enough.
        share = max(1, min(1000, 1 + 1000 * 256 * ranges // n))

        def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                drawn = sorted(set(_strings(b.column(0), sent.value)), key=lambda s: xxhash.xxh3_64_intdigest(s))
                yield pa.RecordBatch.from_arrays([pa.array(drawn[:2000], pa.binary())], ["s"])

        some = texts.where(F.pmod(F.xxhash64("key", F.lit(3)), F.lit(1000)) < share).select("text")
        drawn = sorted(r.s for r in some.mapInArrow(sample, "s binary").orderBy(F.xxhash64("s")).limit(256 * ranges).collect())
        cuts = sorted({bytes(drawn[len(drawn) * i // ranges]) for i in range(1, ranges)}) if drawn else []
    runs = texts.select("text").mapInArrow(_runs(sent, cuts), "range int, run binary")
    judged = checkpoint(runs.groupBy("range").applyInArrow(_judged(cuts), "c1 long, c2 long, begin int, end int, w1 long, w2 long"))
    met = judged.where("w1 IS NOT NULL").groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    met = checkpoint(met)
    late = judged.where("w1 IS NOT NULL AND begin >= 0").join(met.hint("merge"), ["w1", "w2"])
    return judged.where("w1 IS NULL").unionByName(late).select("c1", "c2", "begin", "end")


def _row_hash(doc_id: str, key: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), key)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, key, spans: byte ranges (begin, end) that cover every window standing elsewhere too; key hashes the text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key")).where(F.length("text") * 4 >= SPAN)
    columns = f"doc_id {kind}, key long, place long, low short, high short, h long, c1 long, c2 long"
    every = checkpoint(texts.mapInArrow(_anchored, columns))
    least = [F.min("c1").alias("a1"), F.max("c1").alias("z1"), F.min("c2").alias("a2"), F.max("c2").alias("z2")]
    grams = every.groupBy("h").agg(F.count("*").alias("n"), *least).where("n > 1").select("h", (F.expr("a1 <> z1 OR a2 <> z2")).alias("several"))
    grams = checkpoint(grams)  # so that the join can be split at a gram that very many texts share
    again = checkpoint(every.join(grams.hint("merge"), "h"))
    begin, end = F.col("place") - F.col("high"), F.col("place") - F.col("low") + SPAN
    who = ["doc_id", "key"]
    spans = again.where("NOT several").select(*who, begin.alias("begin"), end.alias("end"))
    several = again.where("several")
    n = several.agg(F.approx_count_distinct("c1")).first()[0]
    if n:
        counts = checkpoint(several.groupBy("c1", "c2").agg(F.count("*").alias("n")))
        several = checkpoint(several.join(counts.hint("merge"), ["c1", "c2"]))
        spans = spans.unionByName(several.where("n > 1").select(*who, begin.alias("begin"), end.alias("end")))
        found = _sorted_out(texts, several, n)
        some = several.where("n = 1").join(found.withColumnsRenamed({"begin": "a", "end": "b"}).hint("merge"), ["c1", "c2"])
        spans = spans.unionByName(some.select(*who, (F.col("place") - F.col("b")).alias("begin"), (F.col("place") - F.col("a") + SPAN).alias("end")))
    return spans.groupBy(*who).agg(F.collect_set(F.struct("begin", "end")).alias("spans"))


def without_repeats(docs: DataFrame, give_kept: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept for every row of `docs` (doc_id, text).

    A byte goes if a string of SPAN bytes that covers it starts anywhere else too, in another row or the same one. `kept`
    holds the bytes that stay, one after another; a missing text is empty. Shorter texts stay whole. Repeated rows lose what
    their windows cover. An empty table gives an empty result.
    """
    found = checkpoint(repeated_spans(docs)).withColumnsRenamed({"doc_id": "its", "key": "of"})
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    if not give_kept:
        names, kinds = names[:-1], kinds[:-1]

    @F.arrow_udf("struct<n_bytes: bigint, n_removed: bigint, n_spans: bigint, kept_sha256: string" + ", kept: binary>" * give_kept + ">" * (not give_kept))
    def cut(text: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, some in zip(text, spans):
            raw = (t.as_py() or "").encode()
            runs: list[list[int]] = []
            for begin, end in sorted((s["begin"], s["end"]) for s in some.as_py() or ()):
                if runs and begin <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], end)
                else:
                    runs.append([begin, end])
            edges = [0, *(x for run in runs for x in run), len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
            out.append((len(raw), len(raw) - len(kept), len(runs), sha256(kept).hexdigest(), kept))
        columns = list(zip(*out)) or [()] * 5
        return pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names)

    # Only texts that may lose something travel.
    sieve = Sieve(found.select(_row_hash("its", "of")))
    keyed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))
    keyed = keyed.withColumn("doubt", sieve.may_hold(_row_hash("doc_id", "key")))
    some = keyed.where("doubt").join(found.hint("merge"), F.col("doc_id").eqNullSafe(F.col("its")) & (F.col("key") == F.col("of")), "left")
    whole = keyed.where("NOT doubt").withColumn("spans", F.lit(None).cast(found.schema["spans"].dataType))
    out = some.select("doc_id", "text", "spans").unionByName(whole.select("doc_id", "text", "spans"))
    return out.select("doc_id", cut("text", "spans").alias("c")).select("doc_id", *[f"c.{n}" for n in names])
