"""Tabular baselines with Spark ML: balanced linear, tree and neural classifiers, search, calibration, importance."""

from __future__ import annotations

import itertools
import random
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import SparkContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression, IsotonicRegression
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import md5_order, with_global_rank, written, written_together
from .metrics import average_precision

KINDS = ("logistic", "tree", "forest", "mlp")


class Logistic(LogisticRegression):
    """Spark ML's logistic regression, whose models come without their training summary.

    A summary holds the session. A model goes to the tasks that score with it, and a session that has observed a query can't be serialized."""

    def _create_model(self, java_model):
        java_model.setSummary(SparkContext._active_spark_context._jvm.scala.Option.empty())
        return super()._create_model(java_model)


def weighted(rows: DataFrame) -> DataFrame:
    """``rows`` with the balanced class weight."""
    n = rows.groupBy("label").agg(F.count("*").alias("_n"))
    total = rows.agg(F.count("*").alias("_t"))
    return rows.join(F.broadcast(n), "label").join(F.broadcast(total)).withColumn("weight", F.col("_t") / (2 * F.col("_n"))).drop("_n", "_t")


def classifier(kind: str, features: Sequence[str], seed: int = 42, **params):
    """Assembling, scaling (for the linear and neural ones) and the classifier, weighted by class where it can be."""
    assemble = VectorAssembler(inputCols=list(features), outputCol="raw", handleInvalid="keep")
    scale = StandardScaler(inputCol="raw", outputCol="features", withMean=True)
    if kind == "logistic":
        stages = [assemble, scale, Logistic(weightCol="weight", **{"maxIter": 50, **params})]
    elif kind == "tree":
        stages = [assemble, DecisionTreeClassifier(featuresCol="raw", weightCol="weight", seed=seed, **params)]
    elif kind == "forest":
        stages = [assemble, RandomForestClassifier(featuresCol="raw", weightCol="weight", seed=seed, **{"numTrees": 20, **params})]
    elif kind == "mlp":
        stages = [assemble, scale, MultilayerPerceptronClassifier(layers=[len(features), *params.pop("hidden", [16]), 2], seed=seed, **params)]
    else:
        raise ValueError(f"unknown kind {kind}")
    return Pipeline(stages=stages)


def fit(train: DataFrame, kind: str, features: Sequence[str], **params) -> PipelineModel:
    return classifier(kind, features, **params).fit(weighted(train))


def scored(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """(hash, label, score)."""
    return model.transform(rows.withColumn("weight", F.lit(1.0))).select("hash", "label", vector_to_array("probability")[1].alias("score"))


class AveragePrecision(Evaluator):
    """The exact average precision of label 1, as an evaluator for Spark ML's searches."""

    def __init__(self, label: str = "label", probability: str = "probability"):
        super().__init__()
        self.label, self.probability = label, probability

    def _evaluate(self, dataset: DataFrame) -> float:
        return average_precision(dataset.select(F.col(self.label).alias("label"), vector_to_array(self.probability)[1].alias("score"))).first().ap

    def isLargerBetter(self) -> bool:
        return True


def _points(grid: dict[str, Sequence], n: int | None, seed: int) -> list[dict]:
    points = [dict(zip(grid, values, strict=True)) for values in itertools.product(*grid.values())]
    return points if n is None else random.Random(seed).sample(points, min(n, len(points)))


def _summary(spark, found: list[tuple[str, float]]) -> DataFrame:
    rows = spark.createDataFrame(found, "params string, ap double")
    return rows.groupBy("params").agg(F.avg("ap").alias("mean_ap"), F.stddev_pop("ap").alias("std_ap"), (1.96 * F.stddev_pop("ap")).alias("margin"))


def search(rows: DataFrame, folds: DataFrame, kind: str, features: Sequence[str], grid: dict[str, Sequence], n: int | None = None, seed: int = 42, parallel: int = 4) -> DataFrame:
    """(params, mean_ap, std_ap, margin): each point of the grid, or ``n`` of them drawn at random, by average precision over the folds
    (hash, fold, part), which may expand in time.

    Models are fitted when this is called, ``parallel`` at a time, one for each point and fold. Each fold's two parts are written once."""
    source, parts = written(rows.select("hash", "label", *features), "rows"), {}
    for f in [r.fold for r in folds.select("fold").distinct().collect()]:
        of = folds.where(F.col("fold") == f)
        parts[f] = [written(source.join(of.where(F.col("part") == part).select("hash"), "hash", "left_semi"), part) for part in ("train", "val")]

    def one(job: tuple[dict, object]) -> tuple[str, float]:
        params, (train, val) = job[0], parts[job[1]]
        return str(params), average_precision(scored(fit(train, kind, features, **params), val)).first().ap

    with ThreadPoolExecutor(parallel) as pool:
        found = list(pool.map(one, itertools.product(_points(grid, n, seed), sorted(parts))))
    return _summary(rows.sparkSession, found)


#: Balanced class weights of the rows that a pipeline is fitted on.
_WEIGHTS = "SELECT t.*, a.n / (2 * c.n) AS weight FROM __THIS__ t JOIN (SELECT label, count(*) AS n FROM __THIS__ GROUP BY label) c ON t.label = c.label CROSS JOIN (SELECT count(*) AS n FROM __THIS__) a"


def grouped_search(rows: DataFrame, kind: str, features: Sequence[str], grid: dict[str, Sequence], k: int, fold: str = "fold", n: int | None = None, seed: int = 42, parallel: int = 4) -> DataFrame:
    """(params, mean_ap, std_ap, margin) over ``k`` folds of whole groups: column ``fold`` has 0 to k - 1, and each fold is validated by models of all
    others. Spark ML's cross-validator runs them, ``parallel`` at a time; class weights are those of the rows that a model is fitted on."""
    pipeline = classifier(kind, features)
    model, points = pipeline.getStages()[-1], _points(grid, n, seed)
    pipeline = Pipeline(stages=[SQLTransformer(statement=_WEIGHTS), *pipeline.getStages()])
    maps = [{model.getParam(name): value for name, value in point.items()} for point in points]
    validator = CrossValidator(estimator=pipeline, estimatorParamMaps=maps, evaluator=AveragePrecision(), numFolds=k, foldCol=fold, parallelism=parallel)
    source = written(rows.select("label", F.col(fold).cast("int").alias(fold), *features), "rows")
    found = validator.fit(source)
    out = [(str(p), float(m), float(s)) for p, m, s in zip(points, found.avgMetrics, found.stdMetrics, strict=True)]
    return rows.sparkSession.createDataFrame(out, "params string, mean_ap double, std_ap double").withColumn("margin", 1.96 * F.col("std_ap"))


def compare_features(train: DataFrame, test: DataFrame, kind: str, **sets: Sequence[str]) -> DataFrame:
    """(features, ap): one classifier fitted and scored on each named set of feature columns, say flat and neighbourhood ones.

    Every fit reads its rows several times, so both tables are written once."""
    columns = ["hash", "label", *dict.fromkeys(f for features in sets.values() for f in features)]
    train, test = written_together({"train": train.select(*columns), "test": test.select(*columns)}).values()
    out = None
    for name, features in sets.items():
        ap = average_precision(scored(fit(train, kind, features), test)).select(F.lit(name).alias("features"), "ap")
        out = ap if out is None else out.unionByName(ap)
    return out


def calibrated(held_out: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (hash, label, score) with calibrated, by isotonic regression on held-out scores."""
    model = IsotonicRegression(featuresCol="score", labelCol="label", predictionCol="calibrated").fit(held_out)
    return model.transform(rows)


def coefficients(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, coefficient, p_value) of a binomial regression with intercept."""
    data = VectorAssembler(inputCols=list(features), outputCol="features").transform(rows.dropna(subset=list(features)))
    model = GeneralizedLinearRegression(family="binomial", link="logit", labelCol="label").fit(data)
    names = [*features, "intercept"]
    values = [*model.coefficients.toArray().tolist(), model.intercept]
    return rows.sparkSession.createDataFrame(list(zip(names, map(float, values), map(float, model.summary.pValues), strict=True)), "feature string, coefficient double, p_value double")


def impurity_importance(model: PipelineModel, features: Sequence[str], spark) -> DataFrame:
    values = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(features, map(float, values), strict=True)), "feature string, importance double")


def permutation_importance(model: PipelineModel, rows: DataFrame, features: Sequence[str], repeats: int = 2, seed: int = 42) -> DataFrame:
    """(feature, mean_drop, std_drop): loss of average precision when a column is shuffled, by joining rows with shuffled places."""
    base = average_precision(scored(model, rows)).select(F.col("ap").alias("_base"))
    placed = with_global_rank(rows.select("hash", "label", *features), [F.col("hash")]).drop("total")
    out = None
    for f in features:
        for r in range(repeats):
            rest = [x for x in placed.columns if x not in (f, "rank")]
            moved = with_global_rank(rows.select("hash", F.col(f).alias("_moved")), md5_order(seed + r, F.concat(F.lit(f), F.col("hash")))).select("rank", "_moved")
            shuffled = placed.join(moved, "rank").select(*rest, F.col("_moved").alias(f))
            drop = average_precision(scored(model, shuffled)).join(F.broadcast(base)).select(F.lit(f).alias("feature"), (F.col("_base") - F.col("ap")).alias("d"))
            out = drop if out is None else out.unionByName(drop)
    return out.groupBy("feature").agg(F.avg("d").alias("mean_drop"), F.stddev_pop("d").alias("std_drop"))
