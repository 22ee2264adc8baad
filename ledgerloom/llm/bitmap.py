"""A membership bitmap of bounded size (a Bloom filter) for longs.

Built on the executors by or-ing words, at most 2**26 bits (8 MB) whatever the
input's size. It only thins what is shuffled next: a false positive costs a
row, and an exact join follows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.textkernel import mix

MOST_BITS = 26
_SEEDS = [np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9FB21C651E98DF25)]


def _spots(values: np.ndarray, bits: int) -> list[np.ndarray]:
    return [mix(values.view(np.uint64) ^ s) >> np.uint64(64 - bits) for s in _SEEDS]


class Bitmap:
    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    def has(self, values: np.ndarray) -> np.ndarray:
        """Whether each (unsigned or signed 64-bit) value may be in the set."""
        out = np.ones(len(values), bool)
        for spot in _spots(values, self.bits):
            out &= (self.words[spot >> np.uint64(6)] >> (spot & np.uint64(63))) & np.uint64(1) > 0
        return out


def bitmap_of(values: DataFrame, count: int) -> Bitmap:
    """A bitmap of a frame's first (long) column; count: about how many values."""
    bits = max(12, min(MOST_BITS, (16 * max(count, 1)).bit_length()))

    def run(parts):
        import pyarrow as pa

        words = np.zeros(1 << (bits - 6), np.uint64)
        for part in parts:
            v = part.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
            for spot in _spots(v, bits):
                np.bitwise_or.at(words, spot >> np.uint64(6), np.uint64(1) << (spot & np.uint64(63)))
        at = np.flatnonzero(words)
        if len(at):
            yield from pa.Table.from_arrays([pa.array(at), pa.array(words[at].view(np.int64))], names=["word", "bits"]).to_batches(50_000)

    found = values.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[found.column(0).to_numpy()] = found.column(1).to_numpy().astype(np.int64).view(np.uint64)
    return Bitmap(words, bits)
