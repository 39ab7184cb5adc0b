"""Exact token counts by dynamic programming over prefixes.

Whole texts: no piece of the vocabulary has a space after another character, so a merge never joins what stands before
a space with what follows. The count at a boundary is the count at the boundary before plus that of the segment
between, and each distinct segment is encoded once by the library.

Inside a segment: the encoding of a prefix is that of a shorter prefix plus one piece, and of all pieces that end there
just one is compatible with the last piece of the shorter prefix. So one step for each character gives the exact count
at every prefix, and questions about budgets and cuts need no further encoding.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHED = 1_000_000  # distinct segments a worker remembers; more are encoded again
LONGEST_CACHED = 64
_SEGMENT = re.compile(" +[^ ]*")


@lru_cache(4)
def counter(model: str | None = None) -> PrefixCounter:
    """One counter for each worker and model file; None is the public 32k piece model."""
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    return PrefixCounter(model)


class PrefixCounter:
    def __init__(self, model: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        special = [self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) for i in range(len(pieces))]
        self.pieces = {p for p, s in zip(pieces, special) if not s}
        self.longest = max(map(len, self.pieces))
        # Segments are independent if no piece has a space mark after another character and white space is kept.
        self.splits = not any(re.search("[^▁]▁", p) for p in self.pieces) and self.library.encode(" a  b ", out_type=str) == self.library.encode(" a", out_type=str) + self.library.encode(" b", out_type=str) + ["▁"]
        self.seen: dict[str, int] = {"": 1}  # a lone space
        self.fits: dict[tuple[str, str], bool] = {}

    def segments(self, text: str) -> list[str]:
        """The parts of a text between which no merge goes, each without its first space, which the library adds."""
        text = text.replace("▁", " ")
        if not self.splits:
            return [text] if text else []
        if "  " not in text and text[:1] != " " and text[-1:] != " ":
            return text.split(" ") if text else []
        return [s[1:] for s in _SEGMENT.findall(" " + text)]

    def learn(self, parts: set[str]) -> None:
        new = [p for p in parts if p not in self.seen]
        if len(self.seen) + len(new) > CACHED:
            self.seen = {"": 1}
            new = [p for p in parts if p]
        for at in range(0, len(new), 10_000):
            some = new[at : at + 10_000]
            self.seen.update(zip(some, map(len, self.library.encode(some, num_threads=1))))

    def prefixes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Counts before each segment boundary of all texts, one text after another, and how many boundaries each text has.

        The count at a boundary is that at the boundary before plus the tokens of the segment between; the first one is 0.
        """
        split = [self.segments(t) for t in texts]
        self.learn({p for parts in split for p in parts if len(p) <= LONGEST_CACHED})
        seen, size = self.seen, np.array([len(parts) for parts in split], np.int64)
        tokens = (seen[p] if len(p) <= LONGEST_CACHED else len(self.library.encode(p)) for parts in split for p in parts)
        running = np.append(0, np.cumsum(np.fromiter(tokens, np.int64, int(size.sum()))))
        first = np.cumsum(size) - size
        text = np.repeat(np.arange(len(split)), size + 1)
        return running[np.arange(len(text)) - text] - running[first][text], size + 1

    def at_boundaries(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Characters before each segment boundary, and the exact count of tokens there."""
        parts = self.segments(text)
        self.learn({p for p in parts if len(p) <= LONGEST_CACHED})
        tokens = [self.seen[p] if len(p) <= LONGEST_CACHED else len(self.library.encode(p)) for p in parts]
        ends = np.cumsum([0] + [len(p) + 1 for p in parts]) - 1
        return np.maximum(ends, 0), np.cumsum([0] + tokens)

    def _fit(self, one: str, two: str) -> bool:
        """Whether two pieces side by side stay two pieces."""
        known = self.fits.get((one, two))
        if known is None:
            # A line feed is no piece, so it keeps the library's own first space away.
            got = self.library.encode("\n" + (one + two).replace("▁", " "), out_type=str)[2:]
            known = self.fits[one, two] = got == [one, two]
        return known

    def in_segment(self, part: str) -> np.ndarray:
        """Tokens of part[:i] for every i, with the space that comes first; entry 0 is the lone space."""
        text = "▁" + part.replace(" ", "▁")
        count, last = [0] * (len(text) + 1), [""] * (len(text) + 1)
        for end in range(1, len(text) + 1):
            for begin in range(max(0, end - self.longest), end):
                piece = text[begin:end]
                if piece not in self.pieces:
                    continue
                before = last[begin]
                if not begin or not before or self._fit(before, piece):
                    count[end], last[end] = count[begin] + 1, piece
                    break
            else:  # no piece for this character: its bytes, which join with nothing
                count[end] = count[end - 1] + len(text[end - 1].encode())
        return np.array(count[1:])

    def everywhere(self, text: str) -> np.ndarray:
        """Tokens of text[:i] for every i from 0 to its length."""
        out = np.zeros(len(text) + 1, np.int64)
        at, so_far = 0, 0
        for part in self.segments(text):
            inner = self.in_segment(part)
            begin = at if at else 1
            out[begin : at + len(part) + 1] = so_far + inner[begin - at :]
            at, so_far = at + len(part) + 1, so_far + int(inner[-1])
        return out

    def cut(self, text: str, budget: int) -> int:
        """The most characters of the text whose tokens number at most `budget`.

        Prefix counts can fall by a piece or two as a piece closes, so segments beyond the first over budget are
        looked at until none can come back under it.
        """
        ends, tokens = self.at_boundaries(text)
        under = np.flatnonzero(tokens <= budget)[-1]
        best, parts = int(ends[under]), self.segments(text)
        if under < len(parts):
            inner = self.in_segment(parts[under]) + tokens[under]
            ok = np.flatnonzero(inner <= budget)
            begin = int(ends[under]) + 1 if under else 0
            best = max([best, *(begin + ok[-1:]).tolist()])
        return best


def count_tokens(docs: DataFrame, limit: int = 4096, model: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of `docs` (doc_id, text); a missing text is empty.

    The count is the last of the stored prefix counts. Counts are those of the library without added tokens. Empty tables give empty results, repeated rows repeat.
    """

    @F.arrow_udf("struct<n_bytes: bigint, tokens: array<bigint>>")
    def counted(text: pa.Array) -> pa.Array:
        text = text.fill_null("")
        counts, size = counter(model).prefixes(text.to_pylist())
        tokens = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(counts))
        return pa.StructArray.from_arrays([pc.binary_length(text).cast(pa.int64()), tokens], ["n_bytes", "tokens"])

    out = docs.select("doc_id", counted("text").alias("prefix"))
    out = out.select("doc_id", "prefix.n_bytes", F.element_at("prefix.tokens", -1).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def cut_to_budget(docs: DataFrame, budget: int, model: str | None = None) -> DataFrame:
    """`docs` with each text cut to its longest prefix of at most `budget` tokens; a missing text stays missing."""

    @F.arrow_udf("string")
    def shorter(text: pa.Array) -> pa.Array:
        c = counter(model)
        return pa.array([None if t is None else t[: c.cut(t, budget)] for t in text.to_pylist()], pa.string())

    return docs.withColumn("text", shorter("text"))


def token_prefixes(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, chars, tokens: for each text the segment boundaries and the exact count of tokens before each."""

    @F.arrow_udf("struct<chars: array<bigint>, tokens: array<bigint>>")
    def stored(text: pa.Array) -> pa.Array:
        rows = [counter(model).at_boundaries(t) for t in text.fill_null("").to_pylist()]
        kind = pa.list_(pa.int64())
        return pa.StructArray.from_arrays([pa.array([r[0].tolist() for r in rows], kind), pa.array([r[1].tolist() for r in rows], kind)], ["chars", "tokens"])

    out = docs.select("doc_id", stored("text").alias("prefix"))
    return out.select("doc_id", "prefix.chars", "prefix.tokens")
