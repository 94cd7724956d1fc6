"""Exploratory statistics as tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import melted, quantiles
from ..functions.scalars import delay_bin, delay_hours
from ..functions.shared import with_running_sums, written


def missing_share(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    row = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns])
    return melted(row, [], columns).withColumnRenamed("value", "missing")


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """(value, n, share), nulls counted as a value."""
    counts = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    every = df.agg(F.count("*").alias("_all"))
    return counts.join(F.broadcast(every)).withColumn("share", F.col("n") / F.col("_all")).drop("_all")  # one row


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """The ``k`` most frequent values, ties by value."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    row = df.agg(*[F.count_distinct(c).alias(c) for c in columns])
    return melted(row, [], columns).select("column", F.col("value").cast("long").alias("n_distinct"))


def _beside(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``left`` with the columns of ``right``, which has a row a key; null keys are equal."""
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    return left.join(right.withColumnsRenamed({k: f"_right_{k}" for k in keys}), same).drop(*[f"_right_{k}" for k in keys])


def describe(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Count, mean, sample deviation, extremes and interpolated percentiles of each column."""
    v = F.col("value")
    rows = melted(df, keys, columns).where(v.isNotNull()).groupBy(*keys, "column").agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    found = quantiles(df, columns, [0.5, 0.9, 0.95, 0.99], keys).withColumnsRenamed({"q0.5": "p50", "q0.9": "p90", "q0.95": "p95", "q0.99": "p99"})
    return _beside(rows, found, [*keys, "column"]).select(*keys, "column", "n", "mean", "std", "min", "p50", "p90", "p95", "p99", "max")


def yearly(df: DataFrame, date: str) -> DataFrame:
    return df.groupBy(F.year(date).cast("long").alias("year")).agg(F.count("*").alias("n"), F.date_format(F.min(date), "yyyy-MM-dd").alias("first"), F.date_format(F.max(date), "yyyy-MM-dd").alias("last"))


def row_shares(df: DataFrame, label: str, bucket: Column) -> DataFrame:
    """(label, bucket, n, share of the label)."""
    counts = df.groupBy(F.col(label).alias("label"), bucket.alias("bucket")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("label")))


def hour_pivot(df: DataFrame, label: str, ts: str) -> DataFrame:
    """Weekday by hour, in percent of the label's rows, 0 where there is none. Shares are taken of counts, at most 168 a label."""
    counts = df.groupBy(F.col(label).alias("label"), F.weekday(ts).cast("long").alias("weekday"), F.hour(ts).alias("h")).agg(F.count("*").alias("n"))
    shares = counts.withColumn("w", 100 * F.col("n") / F.sum("n").over(Window.partitionBy("label")))
    wide = shares.groupBy("label", "weekday").pivot("h", list(range(24))).agg(F.sum("w"))
    return wide.na.fill(0.0).select("label", "weekday", *[F.col(str(h)).alias(f"h{h}") for h in range(24)])


def delay_crosstab(df: DataFrame, label: str, author: str, committer: str) -> DataFrame:
    """(bin, label, n, percent of the label) of the delay from authoring to committing."""
    rows = df.where(F.col(author).isNotNull() & F.col(committer).isNotNull())
    counts = rows.groupBy(delay_bin(delay_hours(F.col(author), F.col(committer))).alias("bin"), F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy("label")))


def median_delay(df: DataFrame, label: str, author: str, committer: str) -> DataFrame:
    """(label, median_hours), null for a label without a delay."""
    rows = df.select(F.col(label).alias("label"), delay_hours(F.col(author), F.col(committer)).alias("hours"))
    found = quantiles(rows, ["hours"], [0.5], ["label"]).select(F.col("label").alias("_label"), F.col("`q0.5`").alias("median_hours"))
    return rows.select("label").distinct().join(found, F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")


def pearson(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r) for each ordered pair of columns, over complete rows."""
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = rows.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{x}|{y}`").alias("r")) for x, y in pairs for a, b in {(x, y), (y, x)}]
    return one.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")


def average_ranks(df: DataFrame, column: str, keys: Sequence[str], into: str) -> DataFrame:
    """``df`` with the average rank of ``column`` within ``keys``; ties share the mean of their places.

    Ranks come from the running counts of distinct values, so a key's ties meet in one aggregated row and no task sees all values.
    """
    counts = df.groupBy(*keys, column).agg(F.count("*").alias("_n"))
    summed = with_running_sums(counts, keys, [F.col(column)], {"_n": "_s"})
    return df.join(summed.select(*keys, column, (F.col("_s") - (F.col("_n") - 1) / 2).alias(into)), [*keys, column])


def spearman(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r): Pearson's r of the average ranks over complete rows.

    All columns are ranked in one pass over their distinct values, and the ranks come back to the rows in one join; a frequent value is a
    skewed key of it that the adaptive skew join splits."""
    whole = written(df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna().withColumn("_row", F.monotonically_increasing_id()), "complete")
    ranked = average_ranks(melted(whole, ["_row"], columns), "value", ["column"], "rank")
    return pearson(ranked.groupBy("_row").agg(*[F.max(F.when(F.col("column") == c, F.col("rank"))).alias(c) for c in columns]), columns)


def mann_whitney(df: DataFrame, value: str, label: str) -> DataFrame:
    """(u, z, p): two-sided, ties corrected, without continuity correction; label 1 against 0. Runs when called: p is one row's."""
    rows = df.where(F.col(value).isNotNull() & F.col(label).isin(0, 1)).select(F.col(value).cast("double").alias("v"), F.col(label).alias("l"))
    by_value = rows.groupBy("v").agg(F.count("*").cast("double").alias("t"), F.sum("l").cast("double").alias("ones"))
    ranked = with_running_sums(by_value, [], [F.col("v")], {"t": "top"}).withColumn("rank", F.col("top") - (F.col("t") - 1) / 2)
    sums = ranked.agg(F.sum("t").alias("n"), F.sum("ones").alias("n1"), F.sum(F.col("rank") * F.col("ones")).alias("r1"), F.sum(F.col("t") ** 3 - F.col("t")).alias("ties"))
    n, n1, n0 = F.col("n"), F.col("n1"), F.col("n") - F.col("n1")
    u = F.col("r1") - n1 * (n1 + 1) / 2
    deviation = F.sqrt(n1 * n0 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    out = sums.select(u.alias("u"), ((u - n1 * n0 / 2) / deviation).alias("z"))
    z = [r.z for r in out.collect()]  # one row
    p = math.erfc(abs(z[0]) / math.sqrt(2)) if z and z[0] is not None else None
    return out.withColumn("p", F.lit(p).cast("double"))


def flag_share(df: DataFrame, flag: Column, label: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label")).agg(F.avg(flag.cast("double")).alias("share"), F.count("*").alias("n"))


def box(df: DataFrame, value: str, label: str) -> DataFrame:
    """Quartiles and whiskers by class."""
    rows = df.select(F.col(label).alias("label"), F.col(value).cast("double").alias("v"))
    ends = rows.groupBy("label").agg(F.min("v").alias("min"), F.max("v").alias("max"))
    found = quantiles(rows, ["v"], [0.25, 0.5, 0.75], ["label"]).drop("column").withColumnsRenamed({"label": "_label", "q0.25": "q1", "q0.5": "median", "q0.75": "q3"})
    q = ends.join(found, F.col("label").eqNullSafe(F.col("_label")), "left").select("label", "q1", "median", "q3", "min", "max")
    return q.withColumn("low", F.greatest("min", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")))).withColumn("high", F.least("max", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))))


def variance_inflation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, vif): uncentred, without intercept. Spark sums the products; the matrix of the columns is inverted here."""
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    sums = rows.agg(*[F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"s{i}_{j}") for i, j in pairs]).first()
    gram = np.zeros((len(columns), len(columns)))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = sums[f"s{i}_{j}"] or 0.0
    vif = np.diag(gram) * np.diag(np.linalg.pinv(gram))
    return df.sparkSession.createDataFrame([(c, float(x)) for c, x in zip(columns, vif, strict=True)], "column string, vif double")
