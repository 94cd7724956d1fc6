"""Queries on result tables, and the Spark ML baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import api
from ..functions.shared import with_global_rank, written
from ..operators import baselines as b
from ..operators import graphs as g
from ..operators import metrics as m
from ..operators import nodes as n
from ..operators import runs as r
from ..operators import splits as p
from .common import oracle, query

_KEYS = ["run", "seed"]
_FEATURES = ["num_lines_changed", "num_files_changed", "dmm_unit_size", "dmm_unit_complexity"]
_LONG = "SELECT run, CAST(seed AS BIGINT) AS seed, CAST(epoch AS BIGINT) AS epoch, split, auc_pr, mcc FROM fx_runs"
_BEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run, seed ORDER BY auc_pr DESC, epoch) AS rn FROM runs WHERE split = 'val') WHERE rn = 1"


def _long(f):
    return f.select("run", F.col("seed").cast("long").alias("seed"), F.col("epoch").cast("long").alias("epoch"), "split", "auc_pr", "mcc")


def _results(f):
    return r.best_epochs(_long(f), "auc_pr", ["run"]).select("run", F.col("val_auc_pr").alias("auc_pr"))


_RESULTS = "SELECT run, max(auc_pr) AS auc_pr FROM fx_runs WHERE split = 'val' GROUP BY 1"


def _rows(c):
    return c.select("hash", "label", "repo_url", "author_date", *[F.coalesce(F.col(x).cast("double"), F.lit(0.0)).alias(x) for x in _FEATURES])


def _baseline(kind, **params):
    def run(c):
        split = written(p.by_time(written(_rows(c), "rows")).select("hash", "label", "repo_split", *_FEATURES), "split")
        model = b.fit(split.where("repo_split = 'train'"), kind, _FEATURES, **params)
        return b.scored(model, split.where("repo_split = 'test'"))

    return query(run, "fx_commit")


def _importance(c):
    rows = written(_rows(c), "rows")
    return b.permutation_importance(b.fit(rows, "logistic", _FEATURES), rows, _FEATURES, 1)


def _calibrated(s):
    """The first half of the events by time calibrates; the second half gets its scores."""
    placed = with_global_rank(s.select("id", "label", "score", "ts"), [F.col("ts"), F.col("id")])
    first = F.col("rank") * 2 <= F.col("total")
    return b.calibrated(placed.where(first).select(F.col("label").cast("double").alias("label"), "score"), placed.where(~first).select("id", "label", "score"))


def _neighbourhood(c, f):
    """Commit features alone against those of the files around it, by mean."""
    nodes = n.file_nodes(f).select("hash", F.lit("file").alias("type"), "node_key", "x")
    edges = f.select("hash", F.lit("modified_by").alias("rel"), F.lit("file").alias("src_type"), F.col("filename").alias("src_key"), F.lit("commit").alias("dst_type"), F.col("hash").alias("dst_key"))
    around = g.commit_readout(nodes, edges).groupBy("hash").pivot("dim", [0, 1, 2]).agg(F.first("value")).toDF("hash", "near_0", "near_1", "near_2")
    split = written(p.by_time(written(_rows(c), "rows")).join(around, "hash", "left").na.fill(0.0), "split")
    return b.compare_features(split.where("repo_split = 'train'"), split.where("repo_split = 'test'"), "logistic", flat=_FEATURES, neighbourhood=[*_FEATURES, "near_0", "near_1", "near_2"])


QUERIES = {
    "runs_best_epochs": (
        query(lambda f: r.best_epochs(_long(f), "auc_pr", _KEYS), "fx_runs"),
        oracle("SELECT run, seed, epoch, round(val, 6) AS val_auc_pr, round(train, 6) AS train_auc_pr FROM (SELECT v.run, v.seed, v.epoch, v.auc_pr AS val, t.auc_pr AS train, row_number() OVER (PARTITION BY v.run, v.seed ORDER BY abs(t.epoch - v.epoch), t.epoch) AS k FROM best v LEFT JOIN (SELECT * FROM runs WHERE split = 'train') t ON t.run = v.run AND t.seed = v.seed) WHERE k = 1", runs=_LONG, best=_BEST),
    ),
    "runs_best_checkpoint": (
        query(lambda f: r.best_epochs(_long(f), "auc_pr", _KEYS, "mcc").select("run", "seed", "epoch"), "fx_runs"),
        oracle("SELECT run, seed, epoch FROM (SELECT *, row_number() OVER (PARTITION BY run, seed ORDER BY auc_pr DESC, mcc DESC, epoch) AS rn FROM runs WHERE split = 'val') WHERE rn = 1", runs=_LONG),
    ),
    "runs_early_stop": (
        query(lambda f: r.early_stop(_long(f), "auc_pr", _KEYS, 3).na.fill(-1, ["stop_epoch"]), "fx_runs"),
        oracle(
            "SELECT run, seed, coalesce(min(epoch) FILTER (n - last >= 3), -1) AS stop_epoch FROM (SELECT *, max(CASE WHEN up THEN n END) OVER w AS last FROM marked WINDOW w AS (PARTITION BY run, seed ORDER BY epoch)) GROUP BY 1, 2", runs=_LONG,
            marked="SELECT *, row_number() OVER w AS n, coalesce(auc_pr > max(auc_pr) OVER (PARTITION BY run, seed ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS up FROM runs WHERE split = 'val' WINDOW w AS (PARTITION BY run, seed ORDER BY epoch)",
        ),
    ),
    "runs_result_rows": (
        query(lambda f: r.result_text(m.seed_summary(r.best_epochs(_long(f), "auc_pr", _KEYS), ["run"], ["val_auc_pr"], 4), 3).select("run", "metric", "n", "result"), "fx_runs"),
        oracle("SELECT run, 'val_auc_pr' AS metric, count(*) AS n, printf('%.3f', round(avg(auc_pr), 4)) || CASE WHEN count(*) > 1 THEN ' ±' || printf('%.3f', round(stddev_pop(auc_pr), 4)) ELSE '' END AS result FROM best GROUP BY 1", runs=_LONG, best=_BEST),
    ),
    "runs_split_rows": (
        query(lambda f: r.result_rows(_long(f).withColumn("split", F.when((F.col("split") == "train") & (F.col("seed") == 1), "test").otherwise(F.col("split"))), "auc_pr", _KEYS), "fx_runs"),
        oracle("SELECT v.run, v.seed, v.epoch, round(t.auc_pr, 6) AS train_auc_pr, round(v.auc_pr, 6) AS val_auc_pr, round(s.auc_pr, 6) AS test_auc_pr FROM best v LEFT JOIN (SELECT * FROM runs WHERE split = 'train' AND seed <> 1) t ON t.run = v.run AND t.seed = v.seed AND t.epoch = v.epoch LEFT JOIN (SELECT * FROM runs WHERE split = 'train' AND seed = 1) s ON s.run = v.run AND s.seed = v.seed AND s.epoch = v.epoch", runs=_LONG, best=_BEST),
    ),
    "runs_summary": (
        query(lambda f: api.summarise_runs(_long(f), ("auc_pr", "mcc"), "auc_pr").select("run", "metric", "mean", "n"), "fx_runs"),
        oracle("SELECT run, 'auc_pr' AS metric, round(avg(auc_pr), 4) AS mean, count(auc_pr) AS n FROM best GROUP BY 1 UNION ALL SELECT run, 'mcc', round(avg(mcc), 4), count(mcc) FROM best GROUP BY 1", runs=_LONG, best=_BEST),
    ),
    "runs_seed_names": (
        query(lambda f: _long(f).withColumn("run", F.concat_ws("_s", "run", F.col("seed").cast("string"))).groupBy(r.run_name().alias("name")).agg(F.count("*").alias("n"), F.count_distinct("run").alias("seeds")), "fx_runs"),
        oracle("SELECT run AS name, count(*) AS n, count(DISTINCT seed) AS seeds FROM fx_runs GROUP BY 1"),
    ),
    "runs_deltas": (
        query(lambda f: r.deltas(_results(f), "view", "auc_pr"), "fx_runs"),
        oracle("SELECT run, round(auc_pr, 6) AS auc_pr, round(d, 6) AS delta, CASE WHEN d < -0.03 THEN 'critical' WHEN d < -0.01 THEN 'notable' ELSE 'marginal' END AS importance, row_number() OVER (ORDER BY d, run) AS place FROM (SELECT *, auc_pr - (SELECT auc_pr FROM results WHERE run = 'view') AS d FROM results)", results=_RESULTS),
    ),
    "runs_threshold_shift": (
        query(lambda s: r.threshold_shift(m.best_threshold_sweep(s, ["grp"]).withColumnRenamed("grp", "run"), "1"), "fx_scores"),
        oracle(
            "SELECT grp AS run, round(t - ref, 6) AS shift, CASE WHEN t - ref >= 0.1 THEN 'up' WHEN t - ref <= -0.1 THEN 'down' ELSE 'same' END AS direction FROM (SELECT grp, t, max(t) FILTER (grp = '1') OVER () AS ref FROM best)",
            sweep="SELECT grp, t, coalesce(2.0 * count(*) FILTER (score >= t AND label = 1) / nullif(count(*) FILTER (score >= t) + count(*) FILTER (label = 1), 0), 0) AS f1 FROM fx_scores, (SELECT CAST(0.05 AS DOUBLE) + i * CAST(0.05 AS DOUBLE) AS t FROM range(18) r(i)) GROUP BY 1, 2",
            best="SELECT grp, CASE WHEN f1 > 0 THEN t ELSE 0.5 END AS t FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY f1 DESC, t) AS rn FROM sweep) WHERE rn = 1",
        ),
    ),
    "runs_precision_recall_ratio": (
        query(lambda s: m.rates(m.confusion(s, ["grp"])).select("grp", r.precision_recall_ratio(F.col("precision"), F.col("recall")).alias("ratio")), "fx_scores"),
        oracle("SELECT grp, round(coalesce(tp / nullif(tp + fp, 0), 0) / greatest(coalesce(tp / nullif(tp + fn, 0), 0), 0.001), 6) AS ratio FROM (SELECT grp, count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (score < 0.5 AND label = 1) AS fn FROM fx_scores GROUP BY 1)"),
    ),
    "runs_peaks": (
        query(lambda f: r.peaks(_long(f).where("split = 'val'"), ["auc_pr", "mcc"], _KEYS), "fx_runs"),
        oracle("SELECT run, seed, arg_max(epoch, {'m': auc_pr, 'e': -epoch}) AS auc_pr_epoch, round(max(auc_pr), 6) AS auc_pr_best, arg_max(epoch, {'m': mcc, 'e': -epoch}) AS mcc_epoch, round(max(mcc), 6) AS mcc_best FROM runs WHERE split = 'val' GROUP BY 1, 2", runs=_LONG),
    ),
    "runs_progress": (
        query(lambda f: r.progress(_long(f).where("run <> 'view'"), _long(f).select("run").distinct(), "auc_pr", 20).select("run", "status"), "fx_runs"),
        oracle("SELECT run, CASE WHEN run = 'view' THEN 'not started' WHEN max(epoch) >= 20 THEN 'done' ELSE 'running' END AS status FROM runs GROUP BY 1", runs=_LONG),
    ),
    "runs_union": (
        query(lambda f: r.union_results(a=_results(f), b=_results(f).drop("auc_pr")).groupBy("split_name").agg(F.count("*").alias("n"), F.count("auc_pr").alias("known")), "fx_runs"),
        oracle("SELECT 'a' AS split_name, count(*) AS n, count(*) AS known FROM (SELECT DISTINCT run FROM fx_runs) UNION ALL SELECT 'b', count(*), 0 FROM (SELECT DISTINCT run FROM fx_runs)"),
    ),
    "baseline_logistic": (_baseline("logistic"), None),
    "baseline_tree": (_baseline("tree", maxDepth=4), None),
    "baseline_forest": (_baseline("forest", numTrees=10, maxDepth=4), None),
    "baseline_mlp": (_baseline("mlp", maxIter=20), None),
    "baseline_random_search": (query(lambda c: b.search(_rows(c), p.expanding_folds(c, 2), "tree", _FEATURES, {"maxDepth": [2, 3, 4], "minInstancesPerNode": [1, 5]}, n=2), "fx_commit"), None),
    "baseline_neighbourhood": (query(_neighbourhood, "fx_commit", "fx_file"), None),
    "baseline_search": (query(lambda c: b.search(_rows(c), p.expanding_folds(c, 2), "logistic", _FEATURES, {"regParam": [0.0, 0.1]}), "fx_commit"), None),
    "baseline_grouped_search": (query(lambda c: b.grouped_search(_rows(c).join(p.repo_folds(c, 3).select("hash", "fold"), "hash"), "tree", _FEATURES, {"maxDepth": [2, 4]}, 3), "fx_commit"), None),
    "baseline_calibrated": (query(_calibrated, "fx_scores"), None),
    "baseline_coefficients": (query(lambda c: b.coefficients(_rows(c), _FEATURES), "fx_commit"), None),
    "baseline_impurity_importance": (query(lambda c: b.impurity_importance(b.fit(_rows(c), "forest", _FEATURES, numTrees=5), _FEATURES, c.sparkSession), "fx_commit"), None),
    "baseline_permutation_importance": (query(_importance, "fx_commit"), None),
}
