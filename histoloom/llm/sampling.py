"""Bounded training samples, drawn by a hash of the id so that every run draws the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; -1 for a null key, which so is in no fold."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds, F.lit(-1))


def bounded(rows: DataFrame, key: str, most: int) -> DataFrame:
    """About ``most`` rows: all if there are no more, else those whose hash lies below the share
    wanted, and never more than 1.2 times ``most``. Rows with a null key are left out."""
    rows = rows.where(F.col(key).isNotNull())
    n = rows.select(key).count()
    if n <= most:
        return rows
    share = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(7)), F.lit(1 << 30)) < int(most / n * (1 << 30))
    return rows.where(share).limit(most * 6 // 5)
