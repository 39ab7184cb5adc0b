"""A Bloom filter of bounded size, to leave rows out of a shuffle that a join would drop anyway.

Rows that the filter turns away are surely not in the table; an exact join decides about the others. Beyond 17 million
values the filter grows no more and turns fewer rows away, with the same results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.words import mixed

LEAST_BITS, MOST_BITS = 16, 28  # powers of two; 32 MB at most


def places(values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(size - 1)
    values = mixed(values.view(np.uint64))
    return values & mask, (values >> np.uint64(32)) & mask


class Sieve:
    def __init__(self, values: DataFrame, n: int | None = None):
        """Of the one long column of `values`; n is their number, counted if not given."""
        spark = values.sparkSession
        n = values.count() if n is None else n
        size = 1 << min(MOST_BITS, max(LEAST_BITS, (16 * n).bit_length()))

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros(size // 8, np.uint8)
            for b in batches:
                for at in places(np.asarray(b.column(0)), size):
                    np.bitwise_or.at(held, (at >> np.uint64(3)).astype(np.int64), np.uint8(128) >> (at & np.uint64(7)).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], ["bits"])

        parts = values.mapInArrow(part, "bits binary").rdd.map(lambda r: np.frombuffer(r[0], np.uint8))
        self.bits = parts.treeAggregate(np.zeros(size // 8, np.uint8), np.bitwise_or, np.bitwise_or, depth=3)
        self.sent = spark.sparkContext.broadcast(self.bits)

    def may_hold(self, value: Column) -> Column:
        sent = self.sent

        @F.arrow_udf("boolean")
        def held(v: pa.Array) -> pa.Array:
            return pa.array(tested(sent.value, np.asarray(v.fill_null(0))))

        return held(value)


def tested(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    one, two = places(values, 8 * len(bits))
    bit = lambda at: (bits[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1
    return (bit(one) & bit(two)).astype(bool)
