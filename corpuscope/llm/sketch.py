"""A filter of fixed size over 64-bit keys, to keep rows that cannot match from being moved."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTER_BITS = 24  # 2 MB, whatever the input


def key_filter(keys: DataFrame, key: str) -> np.ndarray:
    """A bit for each value of a key's first FILTER_BITS bits that occurs; NULL keys are left aside."""
    word = F.shiftrightunsigned(key, 64 - FILTER_BITS + 6)
    bit = F.shiftrightunsigned(key, 64 - FILTER_BITS).bitwiseAND(F.lit(63)).cast("int")
    found = keys.where(F.col(key).isNotNull()).groupBy(word.alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits")).toPandas()
    out = np.zeros(1 << FILTER_BITS - 6, np.int64)
    out[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return out.view(np.uint8)


def may_have(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key's bit is set: true for all keys that were given, and for a few others."""
    slot = (keys.view(np.uint64) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
    return (bits[slot >> 3] >> (slot & 7) & 1).astype(bool)
