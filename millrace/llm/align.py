"""Which tokens of two tokenizers cover the same bytes.

The spans of the libraries are coarse cuts: character offsets of the tokenizers library and the surface spans of a
sentencepiece proto. Where a token is part of a character, or a byte-fallback piece, its span says less than its bytes, and
the decoded bytes of the token place its end.

No token of either side goes over a space that follows a character other than white space, so both end there: a text is
cut at such spaces, and a worker aligns each distinct part once. A corpus-wide count is needed before a link can be judged.
It is summed over distributed rows of id pairs, of which a document keeps each once with its number of links.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.words import slices
from millrace.session import checkpoint

MOST_SENT = 4_000_000  # id pairs whose counts may be broadcast, 17 bytes each; with more they are joined
CACHED = 500_000  # distinct parts that a worker remembers; of more, the half seen most often
JOINED = 100  # parts that are encoded as one text
PORTION = 4_000_000  # bytes of texts looked at together, or one longer text
SUMMED_PAIRS = 2_000_000  # id pairs that a task sums before it hands them on
# White space of any kind before a space keeps the two together, and a last space stays with what is before it.
_NOT_CUT = re.compile("[\\s\x85\u180e\u200b\ufeff] | \\Z")
_CUT = re.compile("(?<=[^\\s\x85\u180e\u200b\ufeff]) (?!\\Z)")
# The same for RE2, which knows white space of ASCII only: texts that a split at single spaces would not do for.
_HARD = "(^|[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200b}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]) | \\z"


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself if printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Aligner:
    def __init__(self, a: str, b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        byte_of, self.a_bytes = _byte_of(), {}
        for token, i in self.a.get_vocab(with_added_tokens=False).items():
            self.a_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else None
        self.n_b = self.b.get_piece_size()
        self.b_bytes: list[bytes | None] = []
        for i in range(self.n_b):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                self.b_bytes.append(bytes([int(piece[3:-1], 16)]))
            else:
                self.b_bytes.append(None if self.b.is_control(i) or self.b.is_unknown(i) else piece.replace("▁", " ").encode())
        self.a_size = np.zeros(max(self.a_bytes) + 1, np.int64)
        for i, x in self.a_bytes.items():
            self.a_size[i] = len(x or b"")
        self.b_size = np.array([len(x or b"") for x in self.b_bytes])
        self.wide = (max(self.a_bytes) + 1) * self.n_b >= 2**31
        pieces = [self.b.encode(s, out_type=str) for s in (" a  b ", " a", " b")]
        inner = any(re.search("[^▁]▁", self.b.id_to_piece(i)) for i in range(self.n_b))
        by_word = type(self.a.pre_tokenizer).__name__ == "ByteLevel" and self.a.normalizer is None
        self.splits = by_word and not inner and pieces[0] == pieces[1] + pieces[2] + ["▁"]
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        # For each part tokens, tokens, groups, links, bytes (-1 if the tokens are other bytes); then the links and group ends of all.
        self.sizes, self.links, self.ends = np.empty((0, 5), np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.seen = np.empty(0, np.int64)  # how often each part stood in a text

    def trim(self) -> None:
        """Forget all but the parts seen most often."""
        kept = np.sort(np.argsort(-self.seen, kind="stable")[: CACHED // 2])
        place = np.full(len(self.seen), -1)
        place[kept] = np.arange(len(kept))
        self.number = {p: n for p, i in self.number.items() if (n := int(place[i])) >= 0}
        self.groups = [self.groups[i] for i in kept.tolist()]
        for name, column in (("links", 3), ("ends", 2)):
            size = self.sizes[:, column]
            setattr(self, name, _gathered(getattr(self, name), (np.cumsum(size) - size)[kept], size[kept]))
        self.sizes, self.seen = self.sizes[kept], self.seen[kept] // 2

    def parts(self, text: str) -> list[str]:
        """Parts that align on their own, each without the space before it."""
        if not self.splits:
            return [text]
        return _CUT.split(text) if _NOT_CUT.search(" " + text) else text.split(" ")

    def learn(self, parts: list[str]) -> None:
        new = [p for p in parts if p not in self.number]
        # Parts behind which a space could be cut are encoded many at a time, as one text.
        joined = [p for p in new if self.splits and p and not _NOT_CUT.search(p[-1] + " x")]
        alone = [[p] for p in set(new).difference(joined)]
        groups = [joined[i : i + JOINED] for i in range(0, len(joined), JOINED)] + alone
        made = []
        for at in range(0, len(groups), 100):
            again = self._align(groups[at : at + 100], made)
            self._align([[p] for g in again for p in g], made)
        if made:
            self.sizes, self.links, self.ends = (np.concatenate(x) for x in zip((self.sizes, self.links, self.ends), *made))
            self.seen = np.append(self.seen, np.zeros(len(self.sizes) - len(self.seen), np.int64))

    def _align(self, groups: list[list[str]], made: list) -> list[list[str]]:
        """Align each group as one text; gives back groups of several parts that have to be looked at one by one."""
        if not groups:
            return []
        texts = [" ".join(g) for g in groups]
        one = self.a.encode_batch([" " + t for t in texts], add_special_tokens=False)
        two = [p.pieces for p in self.b.encode(texts, return_type="proto", num_threads=1)]
        raw = (" " + " ".join(texts)).encode()
        chars = np.array([len(t) + 1 for t in texts])
        place = np.append(np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80), len(raw))  # where characters begin
        first = np.cumsum(chars) - chars
        edge = place[np.append(first, chars.sum())]  # where each text begins in bytes, and the end
        n_a, n_b = np.array([len(e) for e in one]), np.array([len(p) for p in two])
        a = np.fromiter(chain.from_iterable(e.ids for e in one), np.int64)
        span = np.fromiter(chain.from_iterable(chain.from_iterable(e.offsets for e in one)), np.int64).reshape(-1, 2)
        span = place[span + np.repeat(first, n_a)[:, None]]
        a_ends, a_bad = _ends(raw, edge, n_a, a, span, self.a_bytes, self.a_size)
        read = np.array([(p.id, p.begin, p.end) for some in two for p in some], np.int64).reshape(-1, 3)
        b, span = read[:, 0], read[:, 1:] + np.repeat(edge[:-1] + 1, n_b)[:, None]
        opening = np.cumsum(n_b) - n_b
        span[opening[n_b > 0], 0] -= 1  # the added space has no span of its own
        b_ends, b_bad = _ends(raw, edge, n_b, b, span, self.b_bytes, self.b_size)
        # Where each part ends; all are ends of tokens of both sides, or the parts are looked at one by one.
        length = np.array([len(p.encode()) + 1 for g in groups for p in g])
        several = np.array([len(g) for g in groups])
        stop, text = np.cumsum(length), np.repeat(np.arange(len(groups)), several)
        loose = ~(np.isin(stop, a_ends) & np.isin(stop, b_ends))
        bad = a_bad | b_bad
        unclear = (several > 1) & (bad | (np.bincount(text, loose, len(groups)) > 0))
        a, a_ends, b, b_ends = (x[~np.repeat(bad | unclear, n)] for x, n in ((a, n_a), (a_ends, n_a), (b, n_b), (b_ends, n_b)))
        # Each end of either side is that of one link, with the token of the other side it falls in.
        cuts, both = np.union1d(a_ends, b_ends), np.intersect1d(a_ends, b_ends)
        links = a[np.searchsorted(a_ends, cuts)] * self.n_b + b[np.searchsorted(b_ends, cuts)]
        part_of = lambda ends: np.searchsorted(stop, ends)
        count = lambda ends: np.bincount(part_of(ends), minlength=len(stop))
        sizes = np.stack([count(a_ends), count(b_ends), count(both), count(cuts), np.where(bad[text], -1, length)], 1).astype(np.int64)
        shown = _shown(a, b, a_ends, b_ends, both, part_of(both), bad[text] | unclear[text])
        kept = ~unclear[text]
        made.append((sizes[kept], links, both - (stop - length)[part_of(both)]))
        names = [p for g, x in zip(groups, unclear.tolist()) if not x for p in g]
        self.number.update(zip(names, range(len(self.groups), len(self.groups) + len(names))))
        self.groups += [x for x, k in zip(shown, kept.tolist()) if k]
        return [g for g, x in zip(groups, unclear.tolist()) if x]


def _ends(raw: bytes, edge: np.ndarray, n: np.ndarray, ids: np.ndarray, span: np.ndarray, known: dict | list, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each token ends in `raw`, and for each part whether its tokens are other bytes than its own.

    The ends of the spans are the cuts. A span is coarse if it does not begin at the cut before or is not as long as the token:
    there the tokens' own bytes count, from the last cut that is sure.
    """
    length = size[ids]
    ends = span[:, 1].copy()
    begin = np.cumsum(n) - n
    before = np.append(0, ends[:-1])[: len(ends)]
    before[begin[n > 0]] = edge[:-1][n > 0]
    coarse = (span[:, 0] != before) | (ends - span[:, 0] != length)
    if coarse.any():
        total = np.cumsum(length)
        sure = np.maximum.accumulate(np.where(coarse, -1, np.arange(len(ids))))
        start = np.repeat(begin, n)
        inside = sure >= start
        from_part = np.repeat(edge[:-1], n) + total - (total - length)[start]
        ends = np.where(coarse, np.where(inside, ends[sure] + total - total[sure], from_part), ends)
    bytes_of = [known[i] for i in ids.tolist()]
    bad = np.zeros(len(n), bool)
    if None in bytes_of or b"".join(bytes_of) != raw:
        for k, (at, m) in enumerate(zip(begin.tolist(), n.tolist())):
            mine = bytes_of[at : at + m]
            bad[k] = None in mine or b"".join(mine) != raw[edge[k] : edge[k + 1]]
    return ends, bad


def _shown(a, b, a_ends, b_ends, both, theirs, bad) -> list[str]:
    """The groups of each part as text."""
    tokens = np.concatenate([a, b])
    side = np.repeat([0, 1], [len(a), len(b)])
    group = np.searchsorted(both, np.concatenate([a_ends, b_ends]))
    order = np.lexsort((side, group))
    tokens, side, group = tokens[order].tolist(), side[order], group[order]
    if not len(tokens):
        return [""] * len(bad)
    # After a token: a comma inside a side, a bar between sides, a semicolon after a group, a line feed after a part.
    new_group, new_part = np.append(group[1:] != group[:-1], True), np.append(theirs[group[1:]] != theirs[group[:-1]], True)
    after = np.where(new_part, 3, np.where(new_group, 2, np.append(side[1:] != side[:-1], True).astype(int))).tolist()
    lines = iter("".join([str(t) + ",|;\n"[x] for t, x in zip(tokens, after)]).split("\n"))
    return ["" if x else next(lines) for x in bad.tolist()]


@lru_cache(2)
def aligner(a: str | None = None, b: str | None = None) -> Aligner:
    """One for each worker and pair of files; None is the public 50k byte model and the public 32k piece model."""
    if a is None or b is None:
        import public_tokenizers

    return Aligner(a or public_tokenizers.path("byte_bpe_50k.json"), b or public_tokenizers.path("piece_bpe_32k.model"))


def _gathered(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of `flat` that begin at `first`, one after another."""
    total = np.cumsum(size)
    return flat[np.arange(total[-1] if len(total) else 0) + np.repeat(first - (total - size), size)]


def _words(al: Aligner, texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many parts each text has, and the parts of all."""
    texts = texts.fill_null("").cast(pa.large_string())
    plain = pc.and_(pc.invert(pc.match_substring_regex(texts, _HARD)), pc.greater(pc.binary_length(texts), 0)) if al.splits else pa.array([False] * len(texts))
    easy = pc.split_pattern(texts.filter(plain), " ")
    hard = pa.array([al.parts(t) if t else [] for t in texts.filter(pc.invert(plain)).to_pylist()], easy.type)
    # Back in the order of the texts.
    order = np.argsort(np.argsort(~np.asarray(plain), kind="stable"), kind="stable")
    lists = pa.concat_arrays([easy, hard]).take(pa.array(order))
    return np.asarray(lists.value_lengths(), np.int64), lists.flatten()


def _counted(owner: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair of each owner once, and how often it stood there."""
    if not len(pairs):
        return owner, pairs, pairs
    if int(pairs.max()) < 2**40:  # both fit in one number
        both, times = np.unique((owner << 40) | pairs, return_counts=True)
        return both >> 40, both & ((1 << 40) - 1), times
    order = np.lexsort((pairs, owner))
    owner, pairs = owner[order], pairs[order]
    begin = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (pairs[1:] != pairs[:-1])))
    return owner[begin], pairs[begin], np.diff(np.append(begin, len(owner)))


def _listed(values: np.ndarray, size: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(values, kind))


def _aligned(a: str | None, b: str | None, wide: bool, give_groups: bool):
    kind = pa.int64() if wide else pa.int32()

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = aligner(a, b)
        for batch in batches:
            at = 0
            for texts in slices(batch.column(1), PORTION):
                n, words = _words(al, texts)
                if len(al.number) > CACHED:
                    al.trim()
                words = words.dictionary_encode()
                distinct = words.dictionary.to_pylist()
                al.learn(distinct)
                known = np.fromiter(map(al.number.__getitem__, distinct), np.int64, len(distinct))
                part = known[np.asarray(words.indices)]
                al.seen += np.bincount(part, minlength=len(al.seen))
                sizes, links, ends = al.sizes, al.links, al.ends
                doc = np.repeat(np.arange(len(n)), n)
                bad = np.zeros(len(n), bool)
                bad[doc[sizes[part, 4] < 0]] = True
                good = ~bad[doc]
                named = pa.array([al.groups[i] for i in known.tolist()], pa.string()).take(words.indices.filter(pa.array(good)))
                part, doc = part[good], doc[good]
                n = np.where(bad, 0, n)
                sums = [np.bincount(doc, sizes[part, k], len(n)).astype(np.int64) for k in range(4)]
                first = np.cumsum(sizes[:, 3]) - sizes[:, 3]
                pairs = _gathered(links, first[part], sizes[part, 3]) if len(part) else np.empty(0, np.int64)
                owner, pairs, times = _counted(np.repeat(doc, sizes[part, 3]), pairs)
                size = np.bincount(owner, minlength=len(n))
                groups = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), named), ";").to_pylist()
                digest = [sha256(g.encode()).hexdigest() if g else "" for g in groups]
                columns = [batch.column(0).slice(at, len(texts)), *map(pa.array, sums), pa.array(digest, pa.string())]
                columns += [_listed(pairs, size, kind), _listed(times, size, pa.int32())]
                names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
                if give_groups:
                    length = sizes[part, 4]
                    before = np.cumsum(length) - length
                    zero = np.append(before, 0)[np.minimum(np.searchsorted(doc, np.arange(len(n))), len(before))]
                    first = np.cumsum(sizes[:, 2]) - sizes[:, 2]
                    own = _gathered(ends, first[part], sizes[part, 2]) if len(part) else np.empty(0, np.int64)
                    own = own + np.repeat(before - zero[doc], sizes[part, 2])
                    columns += [pa.array(groups, pa.string()), _listed(own, sums[2], pa.int64())]
                    names += ["groups", "ends"]
                at += len(texts)
                yield pa.RecordBatch.from_arrays(columns, names)

    return align


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, n) with each pair at most a few times for a task."""
    pairs, n = np.empty(0, np.int64), np.empty(0, np.int64)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])

    for b in batches:
        p = np.concatenate([pairs, np.asarray(b.column(0).flatten(), np.int64)])
        t = np.concatenate([n, np.asarray(b.column(1).flatten(), np.int64)])
        pairs, where = np.unique(p, return_inverse=True)
        n = np.zeros(len(pairs), np.int64)
        np.add.at(n, where, t)
        if len(pairs) > SUMMED_PAIRS:
            yield out()
            pairs, n = np.empty(0, np.int64), np.empty(0, np.int64)
    if len(pairs):
        yield out()


def _sent_sums(spark, counts: DataFrame):
    """A function of (pairs, times) that gives n_best and count_sum, with all counts in every worker."""
    table = counts.orderBy("pair").toArrow()
    sent = spark.sparkContext.broadcast((np.asarray(table["pair"]), np.asarray(table["n"]), np.asarray(table["best"])))

    @F.arrow_udf("struct<n_best: bigint, count_sum: bigint>")
    def judged(pairs: pa.Array, times: pa.Array) -> pa.Array:
        pair, n, best = sent.value
        size = np.asarray(pairs.value_lengths().fill_null(0), np.int64)
        doc = np.repeat(np.arange(len(pairs)), size)
        t = np.asarray(times.flatten(), np.int64)
        out = np.zeros((2, len(pairs)), np.int64)
        if len(t):
            at = np.searchsorted(pair, np.asarray(pairs.flatten(), np.int64))
            np.add.at(out[0], doc, t * best[at])
            np.add.at(out[1], doc, t * n[at])
        return pa.StructArray.from_arrays([pa.array(out[0]), pa.array(out[1])], ["n_best", "count_sum"])

    return judged


def align(docs: DataFrame, a: str | None = None, b: str | None = None, give_groups: bool = False, most_sent: int = MOST_SENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of `docs` (doc_id, text).

    Tokenizer `a` (a byte-level tokenizers file) sees a space and the text, `b` (a sentencepiece model) the text. Both end
    a token at the ends of the groups; a link is a token of each whose bytes overlap. An id pair counts its links over
    all rows, repeated rows included. Missing and empty texts, and texts that the tokens do not give back byte for byte,
    have no tokens: zeros and ''. With `give_groups` also `groups` (`a1,a2|b1;a3|b2,b3`) and `ends`, where each group
    ends in the bytes of space and text. An empty table gives an empty result.

    Counts of up to `most_sent` id pairs are broadcast; more are joined.
    """
    spark, al = docs.sparkSession, aligner(a, b)
    kind, number = docs.schema["doc_id"].dataType.simpleString(), "long" if al.wide else "int"
    columns = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<{number}>, times array<int>"
    columns += ", groups string, ends array<long>" if give_groups else ""
    rows = docs.select("doc_id", "text").mapInArrow(_aligned(a, b, al.wide, give_groups), columns)
    rows = checkpoint(rows.withColumn("row", F.monotonically_increasing_id()))
    sums = rows.select("pairs", "times").mapInArrow(_summed, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    sums = checkpoint(sums)
    mine = sums.withColumn("b", F.pmod("pair", F.lit(al.n_b)))
    most = mine.groupBy("b").agg(F.max("n").alias("most"))
    counts = checkpoint(mine.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))
    if counts.count() <= most_sent:
        out = rows.withColumn("judged", _sent_sums(spark, counts)("pairs", "times")).select("*", "judged.n_best", "judged.count_sum")
    else:
        each = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").cast("long").alias("pair"), "x.times")
        each = each.join(counts.hint("merge"), "pair")
        best = F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best")
        own = each.groupBy("row").agg(best, F.sum(F.col("times") * F.col("n")).alias("count_sum"))
        out = rows.join(own, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    more = ["groups", "ends"] if give_groups else []
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256", *more)
