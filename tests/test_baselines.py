"""The Spark ML baselines on hand-made data: known scores, splits, steps, coefficients and drops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from histoloom.operators import baselines, metrics, splits

FEATURES = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    """The label follows a alone; b is noise."""
    r = random.Random(12)
    made = [(f"h{i:03d}", f"r{i % 7}", i, r.uniform(-1, 1), r.uniform(-1, 1)) for i in range(210)]
    df = spark.createDataFrame([(h, g, i, x + (0.3 if x > 0 else -0.3), y, int(x > 0)) for h, g, i, x, y in made], "hash string, repo_url string, day int, a double, b double, label int")
    return df.withColumn("author_date", F.timestamp_seconds(F.col("day").cast("long") * 86400)).persist()


@pytest.mark.parametrize("kind, params", [("logistic", {}), ("tree", {"maxDepth": 2}), ("forest", {"numTrees": 5, "maxDepth": 3, "featureSubsetStrategy": "all"}), ("mlp", {"maxIter": 60})])
def test_separable_rows_are_ranked_rightly(spark, rows, kind, params):
    train, test = rows.where("day % 3 > 0"), rows.where("day % 3 = 0")
    model = baselines.fit(train, kind, FEATURES, **params)
    got = baselines.scored(model, test)
    assert metrics.average_precision(got).first().ap == pytest.approx(1.0) and got.count() == 70
    assert got.where("(score > 0.5) <> (label = 1)").count() == 0


def test_classes_weigh_alike(spark):
    df = spark.createDataFrame([(0,)] * 30 + [(1,)] * 10, "label int")
    got = {(r.label, r.weight) for r in baselines.weighted(df).collect()}
    assert got == {(0, 40 / 60), (1, 40 / 20)}


def test_tree_splits_on_the_only_informative_column(spark, rows):
    model = baselines.fit(rows, "tree", FEATURES, maxDepth=1)
    assert {r.feature: r.importance for r in baselines.impurity_importance(model, FEATURES, spark).collect()} == {"a": 1.0, "b": 0.0}
    drops = {r.feature: r for r in baselines.permutation_importance(model, rows, FEATURES, repeats=3).collect()}
    assert drops["b"].mean_drop == drops["b"].std_drop == 0.0 and drops["a"].mean_drop > 0.2 and drops["a"].std_drop > 0


def test_informative_features_score_higher(spark, rows):
    got = {r.features: r.ap for r in baselines.compare_features(rows.where("day < 150"), rows.where("day >= 150"), "logistic", good=["a"], poor=["b"]).collect()}
    assert got["good"] == pytest.approx(1.0) and got["poor"] < 0.8


def test_isotonic_steps(spark):
    held = [(0.1, 0.0), (0.2, 1.0), (0.3, 0.0), (0.4, 0.0), (0.6, 1.0), (0.9, 1.0)]
    # Pooled neighbours: (0.1), (0.2, 0.3, 0.4) with a third of ones, (0.6, 0.9).
    df = spark.createDataFrame(held, "score double, label double")
    got = {round(r.score, 2): r.calibrated for r in baselines.calibrated(df, spark.createDataFrame([(x,) for x in (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.95)], "score double")).collect()}
    third = 1 / 3
    assert [got[x] for x in (0.05, 0.1, 0.2, 0.3, 0.4, 0.6, 0.95)] == pytest.approx([0, 0, third, third, third, 1, 1])
    assert got[0.5] == pytest.approx(third + (1 - third) / 2)


def test_coefficients_and_p_values(spark):
    r = random.Random(4)
    data = [(x := r.gauss(0, 1), y := r.gauss(0, 1), int(r.random() < 1 / (1 + math.exp(-(0.4 + 1.1 * x))))) for _ in range(400)]
    x = np.array([(u, v, 1.0) for u, v, _ in data])
    t, w = np.array([z for *_, z in data], dtype=float), np.zeros(3)
    for _ in range(50):  # Newton's steps
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (t - p))
    z = w / np.sqrt(np.diag(np.linalg.inv((x * (p * (1 - p))[:, None]).T @ x)))
    got = {q.feature: q for q in baselines.coefficients(spark.createDataFrame(data, "a double, b double, label int"), FEATURES).collect()}
    for i, name in enumerate(["a", "b", "intercept"]):
        assert got[name].coefficient == pytest.approx(w[i], abs=1e-5) and got[name].p_value == pytest.approx(math.erfc(abs(z[i]) / math.sqrt(2)), abs=1e-5)
    assert got["a"].p_value < 1e-6 < 0.01 < got["b"].p_value


def test_search_equals_hand_made_folds(spark, rows):
    noisy = rows.withColumn("a", F.col("a") + F.when(F.col("day") % 4 == 0, F.col("b") * 3).otherwise(0.0)).persist()
    folds = splits.expanding_folds(noisy, 2).persist()
    got = {r.params: r for r in baselines.search(noisy, folds, "tree", FEATURES, {"maxDepth": [1, 3]}).collect()}
    assert set(got) == {"{'maxDepth': 1}", "{'maxDepth': 3}"}
    for depth in (1, 3):
        aps = []
        for f in (0, 1):
            train, val = (noisy.join(folds.where(f"fold = {f} AND part = '{part}'").select("hash"), "hash", "left_semi") for part in ("train", "val"))
            aps.append(metrics.average_precision(baselines.scored(baselines.fit(train, "tree", FEATURES, maxDepth=depth), val)).first().ap)
        found = got[f"{{'maxDepth': {depth}}}"]
        assert found.mean_ap == pytest.approx(np.mean(aps)) and found.std_ap == pytest.approx(np.std(aps)) and found.margin == pytest.approx(1.96 * np.std(aps))
    drawn = baselines.search(noisy, folds, "tree", FEATURES, {"maxDepth": [1, 2, 3], "minInstancesPerNode": [1, 5]}, n=2).collect()
    assert len(drawn) == 2


def test_grouped_search_equals_hand_made_folds(spark, rows):
    noisy = rows.withColumn("a", F.col("a") + F.when(F.col("day") % 4 == 0, F.col("b") * 3).otherwise(0.0))
    noisy = noisy.where("label = 0 OR day % 3 = 0").join(splits.repo_folds(rows, 3).select("hash", "fold"), "hash").persist()
    got = {r.params: r for r in baselines.grouped_search(noisy, "tree", FEATURES, {"maxDepth": [1, 3]}, 3).collect()}
    for depth in (1, 3):
        aps = [metrics.average_precision(baselines.scored(baselines.fit(noisy.where(f"fold <> {f}"), "tree", FEATURES, maxDepth=depth), noisy.where(f"fold = {f}"))).first().ap for f in range(3)]
        found = got[f"{{'maxDepth': {depth}}}"]
        assert found.mean_ap == pytest.approx(np.mean(aps)) and found.margin == pytest.approx(1.96 * found.std_ap)


def test_a_model_scores_in_a_session_that_observed_a_query(spark, rows):
    seen = Observation("rows")
    rows.observe(seen, F.count(F.lit(1)).alias("n")).count()
    assert seen.get["n"] == 210
    model = baselines.fit(rows, "logistic", FEATURES)
    assert not model.stages[-1].hasSummary and baselines.scored(model, rows).agg(F.sum("score")).first()[0] > 0
