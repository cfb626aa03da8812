"""A Bloom filter of 64-bit keys for the scans of large tables: built in parallel, of bounded size.

It only spares a scan the rows that a later join would drop; the join stays exact, so a filter that is too small
for its keys costs time and loses nothing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits a key, the bounds of the filter's size in bits (32 MB at most, whatever the number of keys), and the probes a key.
BITS_A_KEY, LEAST_BITS, MOST_BITS, PROBES = 64, 1 << 16, 1 << 28, 3
_STEPS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _probe(keys: np.ndarray, step: int, shift: int) -> np.ndarray:
    x = (keys ^ (keys >> np.uint64(31))) * _STEPS[step]
    x = (x ^ (x >> np.uint64(29))) * _STEPS[0]
    return (x >> np.uint64(shift)).astype(np.int64)


def _words(shift: int):
    schema = pa.schema([("word", pa.int32()), ("bits", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy().view(np.uint64)
            at = np.unique(np.concatenate([_probe(keys, k, shift) for k in range(PROBES)]))
            word = at >> 6
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if at.size else at
            bits = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first) if at.size else np.empty(0, np.uint64)
            yield pa.record_batch([pa.array(word[first].astype(np.int32)), pa.array(bits.view(np.int64))], schema=schema)

    return run


class Membership:
    """Whether keys may be among those that the filter was built from."""

    def __init__(self, words: np.ndarray, shift: int):
        self.bytes, self.shift = words.view(np.uint8), shift

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The places of the keys (int64 or uint64) that pass."""
        keys = keys.view(np.uint64)
        at = np.arange(keys.size)
        for k in range(PROBES):
            bit = _probe(keys if k == 0 else keys[at], k, self.shift)
            at = at[(self.bytes[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)]
        return at


def membership(keys: DataFrame, column: str, count: int):
    """A broadcast Membership of the bigint column's `count` values. Its words come to the driver: 32 MB at most."""
    bits = int(min(MOST_BITS, max(LEAST_BITS, 1 << (max(1, count) * BITS_A_KEY - 1).bit_length())))
    shift = 64 - (bits.bit_length() - 1)
    rows = keys.select(column).mapInArrow(_words(shift), "word int, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(bits >> 6, np.int64)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return keys.sparkSession.sparkContext.broadcast(Membership(words, shift))
