"""Metric queries over scored rows and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import sigmoid
from ..operators import metrics as m
from .common import oracle, query, rs

_COUNTS = "SELECT grp, count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (score < 0.5 AND label = 1) AS fn, count(*) FILTER (score < 0.5 AND label = 0) AS tn FROM fx_scores GROUP BY 1"
_CURVE = "SELECT grp, score, p, q, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER (PARTITION BY grp) AS positives, sum(q) OVER (PARTITION BY grp) AS negatives FROM (SELECT grp, score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS q FROM fx_scores GROUP BY 1, 2) WINDOW w AS (PARTITION BY grp ORDER BY score DESC)"
_ALL = _CURVE.replace("PARTITION BY grp ORDER", "ORDER").replace("PARTITION BY grp", "").replace("grp, score, p", "score, p").replace("SELECT grp, score, count", "SELECT score, count").replace("GROUP BY 1, 2", "GROUP BY 1")
_POINTS = "SELECT *, tp / (tp + fp) AS precision, CASE WHEN positives = 0 THEN 0 ELSE tp / positives END AS recall, CASE WHEN negatives = 0 THEN 0 ELSE fp / negatives END AS fpr FROM curve"
_SWEEP = "SELECT grp, t, coalesce(2.0 * count(*) FILTER (score >= t AND label = 1) / nullif(count(*) FILTER (score >= t) + count(*) FILTER (label = 1), 0), 0) AS f1 FROM fx_scores, (SELECT CAST(0.05 AS DOUBLE) + i * CAST(0.05 AS DOUBLE) AS t FROM range(18) r(i)) GROUP BY 1, 2"


def _rates(source: str) -> str:
    return f"""SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1,
coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) AS mcc, (tp + tn) / (tp + fp + fn + tn) AS accuracy,
((tp + fp)::DOUBLE * (tp + fn) + (fn + tn)::DOUBLE * (fp + tn)) / ((tp + fp + fn + tn)::DOUBLE ** 2) AS chance FROM {source}"""


QUERIES = {
    "metric_rates": (
        query(lambda s: m.rates(m.confusion(s, ["grp"])), "fx_scores"),
        oracle(f"SELECT grp, tp, fp, fn, tn, {rs('precision', 'recall', 'f1', 'mcc', 'accuracy')}, round(CASE WHEN chance = 1 THEN 0 ELSE (accuracy - chance) / (1 - chance) END, 6) AS kappa FROM rates", counts=_COUNTS, rates=_rates("counts")),
    ),
    "metric_class_report": (
        query(lambda s: m.class_report(m.confusion(s, ["grp"]), ["grp"]), "fx_scores"),
        oracle(
            f"""SELECT grp, class, {rs('precision', 'recall', 'f1', 'support')} FROM per UNION ALL
SELECT grp, 'macro', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), round(sum(support), 6) FROM per GROUP BY grp UNION ALL
SELECT grp, 'weighted', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), round(sum(support), 6) FROM per GROUP BY grp""",
            counts=_COUNTS,
            per="SELECT grp, '1' AS class, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, CAST(tp + fn AS DOUBLE) AS support FROM counts UNION ALL SELECT grp, '0', coalesce(tn / nullif(tn + fn, 0), 0), coalesce(tn / nullif(tn + fp, 0), 0), coalesce(2.0 * tn / nullif(2 * tn + fp + fn, 0), 0), CAST(tn + fp AS DOUBLE) FROM counts",
        ),
    ),
    "metric_threshold_sweep": (
        query(lambda s: m.best_threshold_sweep(s, ["grp"]), "fx_scores"),
        oracle("SELECT grp, round(f1, 6) AS best_f1, round(CASE WHEN f1 > 0 THEN t ELSE 0.5 END, 6) AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY f1 DESC, t) AS rn FROM sweep) WHERE rn = 1", sweep=_SWEEP),
    ),
    "metric_average_precision": (
        query(lambda s: m.average_precision(s, ["grp"]), "fx_scores"),
        oracle("SELECT grp, round(coalesce(sum(CASE WHEN positives > 0 THEN tp / (tp + fp) * p / positives END), 0), 6) AS ap FROM curve GROUP BY 1", curve=_CURVE),
    ),
    "metric_average_precision_all": (query(lambda s: m.average_precision(s), "fx_scores"), oracle("SELECT round(coalesce(sum(CASE WHEN positives > 0 THEN tp / (tp + fp) * p / positives END), 0), 6) AS ap FROM curve", curve=_ALL)),
    "metric_roc_auc": (
        query(lambda s: m.roc_auc(s, ["grp"]), "fx_scores"),
        oracle("SELECT grp, round(coalesce(sum(CASE WHEN positives > 0 AND negatives > 0 THEN q * (tp - p / 2) / (positives * negatives) END), 0), 6) AS auc FROM curve GROUP BY 1", curve=_CURVE),
    ),
    "metric_curve_points": (query(lambda s: m.precision_recall_points(s, ["grp"]), "fx_scores"), oracle(f"SELECT grp, {rs('score', 'precision', 'recall', 'fpr')} FROM points", curve=_CURVE, points=_POINTS)),
    "metric_best_f1_point": (
        query(lambda s: m.best_f1_point(s, ["grp"]), "fx_scores"),
        oracle(
            "SELECT grp, round(score, 6) AS threshold, round(f1, 6) AS best_f1 FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY f1 DESC, score) AS rn FROM (SELECT grp, score, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM points)) WHERE rn = 1",
            curve=_CURVE, points=_POINTS,
        ),
    ),
    "metric_tuned": (
        query(lambda s: m.tuned(s.where("ts < TIMESTAMP '2024-01-08'"), s.where("ts >= TIMESTAMP '2024-01-08'"), ["grp"]).select("grp", "threshold", "tp", "fp", "fn", "tn"), "fx_scores"),
        oracle(
            "SELECT s.grp, round(t.score, 6) AS threshold, count(*) FILTER (s.score >= t.score AND label = 1) AS tp, count(*) FILTER (s.score >= t.score AND label = 0) AS fp, count(*) FILTER (s.score < t.score AND label = 1) AS fn, count(*) FILTER (s.score < t.score AND label = 0) AS tn FROM fx_scores s JOIN best t USING (grp) WHERE ts >= TIMESTAMP '2024-01-08' GROUP BY s.grp, t.score",
            curve=_CURVE.replace("FROM fx_scores GROUP", "FROM fx_scores WHERE ts < TIMESTAMP '2024-01-08' GROUP"), points=_POINTS,
            best="SELECT grp, score FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) DESC, score) AS rn FROM points) WHERE rn = 1",
        ),
    ),
    "metric_sigmoid": (query(lambda s: s.select("id", sigmoid(6 * F.col("score") - 3).alias("prob")), "fx_scores"), oracle("SELECT id, round(1 / (1 + exp(3 - 6 * score)), 6) AS prob FROM fx_scores")),
    "metric_calibration": (
        query(lambda s: m.calibration(s, ["grp"]), "fx_scores"),
        oracle("SELECT grp, CAST(least(floor(score * 10), 9) AS BIGINT) AS bin, round(avg(score), 6) AS mean_score, round(avg(label), 6) AS positive_share, count(*) AS n FROM fx_scores GROUP BY 1, 2"),
    ),
    "metric_focal_loss": (
        query(lambda s: m.focal_loss(s.withColumn("logit", 6 * F.col("score") - 3), ["grp"]), "fx_scores"),
        oracle("SELECT grp, round(avg(-CASE WHEN label = 1 THEN 0.25 ELSE 0.75 END * (1 - p) ** 2 * ln(p)), 6) AS loss FROM (SELECT grp, label, 1 / (1 + exp(-CASE WHEN label = 1 THEN 6 * score - 3 ELSE 3 - 6 * score END)) AS p FROM fx_scores) GROUP BY 1"),
    ),
    "metric_seed_summary": (
        query(lambda r: m.seed_summary(r, ["run", "split", "epoch"], ["auc_pr", "mcc"], 6).withColumn("epoch", F.col("epoch").cast("long")), "fx_runs"),
        oracle(" UNION ALL ".join(f"SELECT run, split, epoch, '{c}' AS metric, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, count({c}) AS n FROM fx_runs GROUP BY 1, 2, 3" for c in ("auc_pr", "mcc"))),
    ),
    "metric_train_val_gap": (
        query(lambda r: m.train_val_gap(r, ["run", "seed", "epoch"], "auc_pr").selectExpr("run", "cast(seed as long) seed", "cast(epoch as long) epoch", "gap"), "fx_runs"),
        oracle("SELECT run, seed, epoch, round(max(auc_pr) FILTER (split = 'train') - max(auc_pr) FILTER (split = 'val'), 6) AS gap FROM fx_runs GROUP BY 1, 2, 3 HAVING count(DISTINCT split) = 2"),
    ),
}
