"""Exact quantiles by distributed selection: no task holds the values of a column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import with_running_sums


def _name(p: float) -> str:
    return f"q{p:g}"


def melted(df: DataFrame, keys: Sequence[str], columns: Sequence[str] | Mapping[str, Column]) -> DataFrame:
    """(keys, column, value) with values as doubles."""
    named = dict(columns) if isinstance(columns, Mapping) else {c: F.col(c) for c in columns}
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), v.cast("double").alias("value")) for c, v in named.items()])
    return df.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.column", "_p.value")


def quantiles(df: DataFrame, columns: Sequence[str] | Mapping[str, Column], probabilities: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, column, q0.5, ...): linear interpolation between the two values next to p * (n - 1), nulls left out.

    Equal values are counted before they are shuffled; the counts are range-partitioned by key, column and value and summed up, which tells
    the value at each wanted rank. All columns and probabilities share the pass; a key or a value may hold most rows. A column without values
    has no row."""
    rows = melted(df, keys, columns).where("value IS NOT NULL")
    counts = rows.groupBy(*keys, "column", "value").agg(F.count("*").alias("_n"))
    summed = with_running_sums(counts, [*keys, "column"], [F.col("value")], {"_n": "_upto"}, totals=True)
    found = []
    for p in probabilities:
        place = F.lit(float(p)) * (F.col("_upto_all") - 1)
        at = lambda rank: F.max(F.when((rank >= F.col("_upto") - F.col("_n")) & (rank < F.col("_upto")), F.col("value")))
        found += [at(F.floor(place)).alias(f"_low{p:g}"), at(F.ceil(place)).alias(f"_high{p:g}"), F.max(place - F.floor(place)).alias(f"_part{p:g}")]
    wide = summed.groupBy(*keys, "column").agg(*found)
    low, high, part = (lambda p, n=n: F.col(f"`_{n}{p:g}`") for n in ("low", "high", "part"))
    return wide.select(*keys, "column", *[F.when(part(p) == 0, low(p)).otherwise(low(p) + (high(p) - low(p)) * part(p)).alias(_name(p)) for p in probabilities])


def quantile_row(df: DataFrame, columns: Sequence[str], p: float, prefix: str) -> DataFrame:
    """One row with a quantile of each column, named ``prefix`` and the column; null for a column without values."""
    found = quantiles(df, columns, [p])
    return found.agg(*[F.max(F.when(F.col("column") == c, F.col(f"`{_name(p)}`"))).alias(f"{prefix}{c}") for c in columns])
