"""A bounded filter of keys, so that rows that surely have no partner need no shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter: at least, for each key, and at most (32 MB). Beyond the last the filter lets more rows pass, and nothing is lost.
LEAST, PER_KEY, MOST = 1 << 16, 16, 1 << 28
PROBES = 4
_LOW = (1 << 40) - 1


def key_filter(keys: DataFrame, key: str) -> KeyFilter:
    """A Bloom filter of a column of hashes, put together from words of 64 bits in partial aggregates."""
    count = keys.count()
    bits = LEAST
    while bits < min(PER_KEY * count, MOST):
        bits *= 2
    low = F.col(key).bitwiseAND(F.lit(_LOW))
    places = [(low + k * _step(F.col(key))).bitwiseAND(F.lit(bits - 1)) for k in range(PROBES)]
    words = (
        keys.select(F.explode(F.array(*places)).alias("at"))
        .groupBy(F.shiftright("at", 6).alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63)).cast("int"))).alias("mask"))
        .toArrow()
    )
    mask = np.zeros(bits // 64, dtype=np.int64)
    mask[words["word"].to_numpy()] = words["mask"].to_numpy()
    return KeyFilter(keys, mask)


def _step(key: Column) -> Column:
    """An odd stride from the upper 24 bits; places begin at the lower 40."""
    return F.call_function("shiftrightunsigned", key, F.lit(40)).bitwiseOR(F.lit(1))


def may_hold(keys: np.ndarray, mask: np.ndarray, bits: int) -> np.ndarray:
    """Which of the hashes may be keys of the filter."""
    step = (keys.view(np.uint64) >> np.uint64(40)).astype(np.int64) | 1
    found = np.ones(len(keys), dtype=bool)
    for k in range(PROBES):
        at = ((keys & _LOW) + k * step) & (bits - 1)
        found &= (mask[at >> 6] >> (at & 63)) & 1 == 1
    return found


class KeyFilter:
    def __init__(self, df: DataFrame, mask: np.ndarray):
        self.shared = df.sparkSession.sparkContext.broadcast(mask)
        self.bits = len(mask) * 64

    def may_hold(self, key: Column) -> Column:
        """True for every key of the filter, and for few others."""
        shared, bits = self.shared, self.bits

        @F.arrow_udf("boolean")
        def test(keys: pa.Array) -> pa.Array:
            return pa.array(may_hold(keys.to_numpy(zero_copy_only=False), shared.value, bits))

        return test(key)
