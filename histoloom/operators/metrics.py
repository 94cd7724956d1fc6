"""Classification metrics over scored rows: any key columns, ``label`` (0 or 1) and ``score``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import with_running_sums


def _over(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / b)


def confusion(scored: DataFrame, keys: Sequence[str] = (), threshold: Column | float = 0.5) -> DataFrame:
    """(keys, tp, fp, fn, tn); a score at the threshold counts as positive."""
    pos, one = F.col("score") >= threshold, F.col("label") == 1
    return scored.groupBy(*keys).agg(F.count_if(pos & one).alias("tp"), F.count_if(pos & ~one).alias("fp"), F.count_if(~pos & one).alias("fn"), F.count_if(~pos & ~one).alias("tn"))


def rates(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and Matthews' coefficient, 0 on an empty margin, and Cohen's kappa."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    chance = ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)
    return counts.withColumns({
        "precision": _over(tp, tp + fp), "recall": _over(tp, tp + fn), "f1": _over(2 * tp, 2 * tp + fp + fn),
        "mcc": _over(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))), "accuracy": (tp + tn) / n, "kappa": _over((tp + tn) / n - chance, 1 - chance),
    })


def class_report(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, class, precision, recall, f1, support) for 0, 1, the macro and the weighted mean."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))

    def of(name, t, p, n):
        return F.struct(F.lit(name).alias("class"), _over(t, t + p).alias("precision"), _over(t, t + n).alias("recall"), _over(2 * t, 2 * t + p + n).alias("f1"), (t + n).alias("support"))

    both = counts.withColumn("zero", of("0", tn, fn, fp)).withColumn("one", of("1", tp, fp, fn))

    def mean(name, w0, w1):
        return F.struct(F.lit(name).alias("class"), *[(w0 * F.col(f"zero.{m}") + w1 * F.col(f"one.{m}")).alias(m) for m in ("precision", "recall", "f1")], (F.col("zero.support") + F.col("one.support")).alias("support"))

    n = F.col("zero.support") + F.col("one.support")
    rows = F.array("zero", "one", mean("macro", F.lit(0.5), F.lit(0.5)), mean("weighted", _over(F.col("zero.support"), n), _over(F.col("one.support"), n)))
    return both.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.*")


def best_threshold_sweep(scored: DataFrame, keys: Sequence[str] = (), steps: int = 18) -> DataFrame:
    """(keys, best_f1, threshold) over thresholds 0.05, 0.10, ...; the lowest of equals; (0, 0.5) where no F1 is above 0.

    Each score falls into one step, so counts are aggregated before thresholds are compared."""
    grid = [0.05 + i * 0.05 for i in range(steps)]
    reached = sum((F.col("score") >= t).cast("int") for t in grid)
    # A step's rows are positive for that many thresholds.
    by_step = scored.groupBy(*keys, reached.alias("_k")).agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") != 1).alias("q"))
    totals = by_step.groupBy(*keys).agg(F.sum("p").alias("all_p"), *[F.sum(F.when(F.col("_k") > i, F.col("p")).otherwise(0)).alias(f"tp{i}") for i in range(steps)], *[F.sum(F.when(F.col("_k") > i, F.col("q")).otherwise(0)).alias(f"fp{i}") for i in range(steps)])
    f1 = [_over(2.0 * F.col(f"tp{i}"), F.col(f"tp{i}") + F.col(f"fp{i}") + F.col("all_p")) for i in range(steps)]
    best = F.array_max(F.array(*[F.struct(f.alias("f1"), F.lit(-t).alias("t")) for f, t in zip(f1, grid, strict=True)]))
    return totals.select(*keys, best.alias("_b")).select(*keys, F.col("_b.f1").alias("best_f1"), F.when(F.col("_b.f1") > 0, -F.col("_b.t")).otherwise(0.5).alias("threshold"))


def curve(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, score, tp, fp, positives, negatives, p, q): cumulative counts at each distinct score, from the highest."""
    by_score = scored.groupBy(*keys, "score").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") != 1).alias("q"))
    summed = with_running_sums(by_score, keys, [F.desc("score")], {"p": "tp", "q": "fp"}, totals=True)
    return summed.select(*keys, "score", "tp", "fp", F.col("tp_all").alias("positives"), F.col("fp_all").alias("negatives"), "p", "q")


def average_precision(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, ap): the sum of precision times the gain in recall, tied scores as one step; 0 without positives."""
    points = curve(scored, keys)
    step = F.col("tp") / (F.col("tp") + F.col("fp")) * F.col("p") / F.col("positives")
    return points.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("positives") > 0, step)), F.lit(0.0)).alias("ap"))


def roc_auc(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, auc): ties at half credit; 0 for one class only."""
    points = curve(scored, keys)
    area = F.col("q") * (F.col("tp") - F.col("p") / 2) / (F.col("positives") * F.col("negatives"))
    return points.groupBy(*keys).agg(F.coalesce(F.sum(F.when((F.col("positives") > 0) & (F.col("negatives") > 0), area)), F.lit(0.0)).alias("auc"))


def precision_recall_points(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    points = curve(scored, keys)
    return points.select(*keys, "score", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), _over(F.col("tp"), F.col("positives")).alias("recall"), _over(F.col("fp"), F.col("negatives")).alias("fpr"))


def best_f1_point(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, threshold, best_f1): the best point of the exact curve, the lowest score of equals."""
    points = precision_recall_points(scored, keys)
    f1 = _over(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    best = points.groupBy(*keys).agg(F.max(F.struct(f1.alias("f1"), (-F.col("score")).alias("s"))).alias("_b"))
    return best.select(*keys, (-F.col("_b.s")).alias("threshold"), F.col("_b.f1").alias("best_f1"))


def tuned(train: DataFrame, test: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rates on ``test`` at the threshold of the best F1 on ``train``, by ``keys``."""
    points = best_f1_point(train, keys).select(*keys, F.col("threshold"))
    rows = test.join(points, list(keys)) if keys else test.join(F.broadcast(points))
    return rates(confusion(rows, [*keys, "threshold"], F.col("threshold")))


def calibration(scored: DataFrame, keys: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """(keys, bin, mean_score, positive_share, n) over equal-width bins; a score of 1 falls into the last."""
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("long")
    return scored.groupBy(*keys, b.alias("bin")).agg(F.avg("score").alias("mean_score"), F.avg(F.col("label").cast("double")).alias("positive_share"), F.count("*").alias("n"))


def focal_loss(scored: DataFrame, keys: Sequence[str] = (), alpha: float = 0.25, gamma: float = 2.0, logit: str = "logit") -> DataFrame:
    """(keys, loss): mean of alpha_t (1 - p_t)^gamma times the log loss, by a log-sigmoid that can't overflow."""
    z = F.when(F.col("label") == 1, F.col(logit)).otherwise(-F.col(logit))
    log_p = F.least(z, F.lit(0.0)) - F.log1p(F.exp(-F.abs(z)))
    weight = F.when(F.col("label") == 1, alpha).otherwise(1 - alpha)
    return scored.groupBy(*keys).agg(F.avg(-weight * F.pow(1 - F.exp(log_p), F.lit(gamma)) * log_p).alias("loss"))


def seed_summary(runs: DataFrame, keys: Sequence[str], metrics: Sequence[str], places: int = 4) -> DataFrame:
    """(keys, metric, mean, std, n): population deviation, both rounded."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])
    long = runs.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.metric", "_p.v")
    return long.groupBy(*keys, "metric").agg(F.round(F.avg("v"), places).alias("mean"), F.round(F.stddev_pop("v"), places).alias("std"), F.count("v").alias("n"))


def train_val_gap(runs: DataFrame, keys: Sequence[str], metric: str) -> DataFrame:
    """(keys, gap): the metric of train less that of val, where both are there."""
    wide = runs.groupBy(*keys).agg(F.max(F.when(F.col("split") == "train", F.col(metric))).alias("_t"), F.max(F.when(F.col("split") == "val", F.col(metric))).alias("_v"))
    return wide.where("_t IS NOT NULL AND _v IS NOT NULL").select(*keys, (F.col("_t") - F.col("_v")).alias("gap"))
