"""A Bloom filter of a table's keys: asked by every record before a join, so that only those that may match are shuffled."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One in a hundred other keys passes.
BITS_A_KEY, HASHES = 10, 7
#: Larger filters aren't made: their tables are joined without.
MOST_BYTES = 64 << 20


def _places(h: np.ndarray, n_bits: int) -> np.ndarray:
    """The bits of 64-bit hashes, a row each: two halves and their sums."""
    h = h.view(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
    return (low[:, None] + np.arange(HASHES, dtype=np.uint64) * high[:, None]) % np.uint64(n_bits)


@dataclass(frozen=True)
class Bloom:
    """May a key be in the table?  Never wrong when it says no."""

    words: np.ndarray

    @classmethod
    def of(cls, keys: DataFrame, column: str, most_bytes: int = MOST_BYTES) -> Bloom | None:
        """From a table's keys; None if the filter would be larger than ``most_bytes``.  Tasks set their bits, and equal words are or-ed before they come back."""
        n = keys.count()
        n_bits = max(64, math.ceil(n * BITS_A_KEY / 64) * 64)
        if n_bits // 8 > most_bytes:
            return None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.unique(_places(batch.column(0).to_numpy(), n_bits))
                word, first = np.unique(at >> np.uint64(6), return_index=True)
                if len(at):
                    bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)
                    yield pa.record_batch([pa.array(word.view(np.int64)), pa.array(bits.view(np.int64))], ["word", "bits"])

        hashed = keys.where(F.col(column).isNotNull()).select(F.xxhash64(column))
        found = hashed.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        words = np.zeros(n_bits // 64, np.int64)
        words[found["word"].to_numpy()] = found["bits"].to_numpy()
        return cls(words.view(np.uint64))

    def passes(self, h: np.ndarray) -> np.ndarray:
        at = _places(h, 64 * len(self.words))
        return ((self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)

    def may_hold(self, df: DataFrame, key: Column) -> Column:
        """Whether a (non-null) key may be among the table's."""
        sent = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("boolean")
        def asked(h: pd.Series) -> pd.Series:
            return pd.Series(sent.value.passes(h.to_numpy(np.int64)))

        return asked(F.xxhash64(key))
