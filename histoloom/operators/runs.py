"""Tables of experiment results: (run, seed, epoch, split, metrics)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_epochs(runs: DataFrame, metric: str, keys: Sequence[str], tie: str | None = None) -> DataFrame:
    """(keys, epoch, val and train metric): the first epoch of the best val metric (then of ``tie``), with train's at the epoch or, failing that, its nearest."""
    order = [F.desc(metric), *([F.desc(tie)] if tie else []), F.col("epoch")]
    val = runs.where("split = 'val'").withColumn("_p", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_p = 1").select(*keys, "epoch", F.col(metric).alias(f"val_{metric}"))
    train = runs.where("split = 'train'").select(*keys, F.col("epoch").alias("_e"), F.col(metric).alias("_m"))
    both = val.join(train, list(keys), "left").groupBy(*keys, "epoch", f"val_{metric}").agg(F.min_by("_m", F.struct(F.abs(F.col("_e") - F.col("epoch")), "_e")).alias(f"train_{metric}"))
    return both


def result_rows(runs: DataFrame, metric: str, keys: Sequence[str], splits: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """(keys, epoch, <split>_<metric>...): each run's metric on all splits at its best val epoch, best first; runs without val go."""
    best = best_epochs(runs, metric, keys).select(*keys, "epoch")
    wide = runs.join(best, [*keys, "epoch"]).groupBy(*keys, "epoch").agg(*[F.max(F.when(F.col("split") == s, F.col(metric))).alias(f"{s}_{metric}") for s in splits])
    return wide.where(F.col(f"val_{metric}").isNotNull()).orderBy(F.desc(f"val_{metric}"), *keys)


def early_stop(runs: DataFrame, metric: str, keys: Sequence[str], patience: int) -> DataFrame:
    """(keys, stop_epoch): the first epoch that ends ``patience`` epochs without improvement; null if none does."""
    w = Window.partitionBy(*keys).orderBy("epoch")
    rows = runs.where("split = 'val'").withColumn("_best", F.max(metric).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_up", F.col("_best").isNull() | (F.col(metric) > F.col("_best"))).withColumn("_n", F.row_number().over(w))
    rows = rows.withColumn("_last", F.max(F.when(F.col("_up"), F.col("_n"))).over(w))
    return rows.groupBy(*keys).agg(F.min(F.when(F.col("_n") - F.col("_last") >= patience, F.col("epoch"))).alias("stop_epoch"))


def _fixed(places: int):
    """Numbers with that many places as C's printf writes them, rounded by their exact value: ``format_number`` makes 0.000 of 0.0005, and sets
    commas from 1,000 on. A row a result."""
    return F.udf(lambda v: None if v is None else f"{v:.{places}f}", "string")


def result_text(summary: DataFrame, places: int = 4) -> DataFrame:
    """``summary`` (mean, std, n) with result: mean and, of several seeds, the deviation."""
    number = _fixed(places)
    return summary.withColumn("result", F.when(F.col("n") > 1, F.concat(number("mean"), F.lit(" ±"), number("std"))).otherwise(number("mean")))


def run_name(name: str = "run") -> Column:
    """A run's name without its seed suffix."""
    return F.regexp_replace(F.col(name), r"_s\d+$", "")


def deltas(results: DataFrame, reference: str, metric: str, run: str = "run") -> DataFrame:
    """``results`` with delta to the reference run, place from the worst, and class."""
    ref = results.where(F.col(run) == reference).agg(F.max(metric).alias("_ref"))
    rows = results.join(F.broadcast(ref)).withColumn("delta", F.col(metric) - F.col("_ref")).drop("_ref")
    kind = F.when(F.col("delta") < -0.03, "critical").when(F.col("delta") < -0.01, "notable").otherwise("marginal")
    return rows.withColumn("importance", kind).withColumn("place", F.row_number().over(Window.orderBy("delta", run)).cast("long"))  # a row a run


def threshold_shift(results: DataFrame, reference: str, column: str = "threshold", run: str = "run") -> DataFrame:
    """(run, shift, direction): up or down where a best threshold moved by 0.1 or more."""
    ref = results.where(F.col(run) == reference).agg(F.max(column).alias("_ref"))
    shift = F.col(column) - F.col("_ref")
    return results.join(F.broadcast(ref)).select(run, shift.alias("shift"), F.when(shift >= 0.1, "up").when(shift <= -0.1, "down").otherwise("same").alias("direction"))


def precision_recall_ratio(precision: Column, recall: Column) -> Column:
    return precision / F.greatest(recall, F.lit(0.001))


def peaks(runs: DataFrame, metrics: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(keys, <metric>_epoch, <metric>_best): the first epoch of each metric's best."""
    return runs.groupBy(*keys).agg(*[x for m in metrics for x in (F.max_by("epoch", F.struct(m, -F.col("epoch"))).alias(f"{m}_epoch"), F.max(m).alias(f"{m}_best"))])


def progress(runs: DataFrame, expected: DataFrame, metric: str, last: int) -> DataFrame:
    """(run, last_epoch, best, status) of each expected run."""
    seen = runs.groupBy("run").agg(F.max("epoch").alias("last_epoch"), F.max(metric).alias("best"))
    status = F.when(F.col("last_epoch").isNull(), "not started").when(F.col("last_epoch") >= last, "done").otherwise("running")
    return expected.select("run").join(seen, "run", "left").withColumn("status", status)


def union_results(**tables: DataFrame) -> DataFrame:
    """Tables of several splits as one, marked by split; missing columns are null."""
    out = None
    for name, t in tables.items():
        part = t.withColumn("split_name", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
