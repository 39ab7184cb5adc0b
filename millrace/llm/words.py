"""Words and word hashes of a batch of texts, as numpy arrays.

A word is a longest run of digits, a-z and characters outside ASCII, after lowering A-Z only. Since every byte of a
character outside ASCII is 0x80 or more, the split works on UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The same split for SQL functions.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True

_draw = np.random.default_rng(20240229)
_BYTE = _draw.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _draw.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER_AZ)


def word_array(text: Column) -> Column:
    return F.filter(F.split(lowered(text), NO_WORD), lambda w: w != "")


def spare_name(df: DataFrame, *names: str) -> list[str]:
    """Column names that the table does not have yet."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each begins. A missing text is empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, places, data = texts.buffers()
    at = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    if data is None or at[-1] == at[0]:
        return np.empty(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


@dataclass
class Words:
    data: np.ndarray  # lowered bytes of all words in a row
    start: np.ndarray  # where each word begins in data, and the end
    first: np.ndarray  # the first word of each text, and the number of words
    hash: np.ndarray  # 64 bits for each word

    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.count())

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of n words in a row, and the number of the first word; none reaches into another text."""
        if n == 1:
            return self.hash, np.arange(len(self.hash))
        total = len(self.hash) - n + 1
        if total <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        out = np.zeros(total, np.uint64)
        for k in range(n):
            out += self.hash[k : k + total] * _PLACE[k]
        left = np.repeat(self.first[1:], self.count())[:total] - np.arange(total)
        at = np.flatnonzero(left >= n)
        return mixed(out[at]), at

    def word(self, i: int, n: int = 1) -> bytes:
        """n words from word i, with a space between."""
        return b" ".join(self.data[self.start[k] : self.start[k + 1]].tobytes() for k in range(i, i + n))


def slices(texts: pa.Array, most: int = 1_000_000) -> Iterator[pa.Array]:
    """The texts in order, some at a time, of about `most` bytes or one longer text."""
    _, at = flat(texts)
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, "right")) - 1)
        yield texts.slice(begin, end - begin)
        begin = end


def words(texts: pa.Array) -> Words:
    """Takes about thirty bytes of memory for each byte of the texts; `slices` keeps that small."""
    data, at = flat(texts)
    data = _LOWER[data]
    inside = _IN_WORD[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = at[:-1][np.diff(at) > 0]
    begins[edge] = inside[edge]
    edge = at[1:][np.diff(at) > 0] - 1
    ends[edge] = inside[edge]
    here = np.flatnonzero(begins)
    size = np.flatnonzero(ends) - here + 1
    first, kept = np.searchsorted(here, at), data[inside]
    start = np.concatenate([[0], np.cumsum(size)])
    if not len(here):
        return Words(kept, start, first, np.empty(0, np.uint64))
    # Bytes weigh by their place among all; dividing by the weight of a word's place makes equal words equal.
    value = np.cumprod(np.full(len(kept), _BASE, np.uint64))
    undo = _undone(len(kept))[start[:-1]]
    value *= _BYTE[kept]
    return Words(kept, start, first, mixed(np.add.reduceat(value, start[:-1]) * undo + size.astype(np.uint64)))


def _undone(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(0, n - 1), _BASE_INVERSE, np.uint64)]))
