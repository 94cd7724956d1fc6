"""A bitmap of hashed ids, to leave rows out of a shuffle: broadcast while its size has a bound, not used beyond."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a filter at most, 16 an id: 2 MB, and 262,144 rows of the driver's.
FILTER_BITS = 1 << 24


def bits_for(n: int) -> int | None:
    """The bits of a filter of ``n`` ids; none if they would pass the bound."""
    bits = max(1 << 12, 1 << (16 * n).bit_length())
    return bits if bits <= FILTER_BITS else None


def bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """The bit map, built by Spark, of the hashes in the only column of ``hashes``."""
    at = F.pmod(F.col(hashes.columns[0]), F.lit(bits))
    words = hashes.groupBy(F.floor(at / 64).cast("long").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))).alias("b")).toArrow()
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return out


def bits_at(found: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The bits of a bit map at places ``at``."""
    return (found[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
