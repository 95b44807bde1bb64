"""Base models, ensemble scoring and evaluation on ``pyspark.ml``."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import TypeVar

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspark.functions.columns import score_vector, threshold, weighted_probability
from driftspark.operators.ensemble import MODEL_TYPES, best_by, join_scores, majority_vote
from driftspark.operators.sampling import split

# Hyperparameters of the base models, two sets.
STANDARD = {
    "dt": (DecisionTreeClassifier, dict(maxDepth=10), True),
    "rf": (RandomForestClassifier, dict(numTrees=50, maxDepth=10), True),
    "gbt": (GBTClassifier, dict(maxIter=20, maxDepth=6), True),
    "lr": (LogisticRegression, dict(maxIter=100, regParam=0.01), False),
}
NOTEBOOK = {
    "dt": (DecisionTreeClassifier, dict(maxDepth=10), False),
    "rf": (RandomForestClassifier, dict(numTrees=30), False),
    "gbt": (GBTClassifier, dict(maxIter=50, maxDepth=3, stepSize=0.1, subsamplingRate=0.6,
                                minInstancesPerNode=500, maxBins=32, seed=42), False),
    "lr": (LogisticRegression, dict(maxIter=50, regParam=0.0), False),
}
MODEL_SETS = {"standard": STANDARD, "notebook": NOTEBOOK}
PARALLEL = 4  # fits at a time
# Columns a fitted model adds besides its score.
MODEL_COLUMNS = ["features_raw", "features", "rawPrediction", "probability", "prediction"]


def build_model(features: Sequence[str], label: str, model_type: str = "dt", seed: int = 42,
                scale: str = "mean_std", model_set: str = "standard") -> Pipeline:
    """Assembler, optional scaler (``mean_std``, ``std`` or ``none``), classifier."""
    if not features:
        raise ValueError("feature columns must be non-empty")
    kinds = MODEL_SETS[model_set]
    if model_type not in kinds:
        raise ValueError(f"unknown model type {model_type!r}")
    make, params, seeded = kinds[model_type]
    model = make(labelCol=label, featuresCol="features", **params)
    if seeded:
        model = model.setSeed(seed)
    if scale == "none":
        stages = [VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip")]
    elif scale in ("mean_std", "std"):
        stages = [VectorAssembler(inputCols=list(features), outputCol="features_raw", handleInvalid="skip"),
                  StandardScaler(inputCol="features_raw", outputCol="features",
                                 withMean=scale == "mean_std", withStd=True)]
    else:
        raise ValueError(f"unknown scale mode {scale!r}")
    return Pipeline(stages=[*stages, model])


def evaluators(label: str, raw: str = "rawPrediction", prediction: str = "prediction") -> dict:
    return {
        "auc": BinaryClassificationEvaluator(labelCol=label, rawPredictionCol=raw, metricName="areaUnderROC",
                                             numBins=0),  # every distinct score, no binning
        "f1": MulticlassClassificationEvaluator(labelCol=label, predictionCol=prediction, metricName="f1"),
        "accuracy": MulticlassClassificationEvaluator(labelCol=label, predictionCol=prediction,
                                                      metricName="accuracy"),
    }


def evaluate_frame(scored: DataFrame, label: str, raw: str = "rawPrediction",
                   prediction: str = "prediction") -> dict[str, float]:
    """AUC, weighted F1 and accuracy; the scores are computed once."""
    small = scored.select(F.col(label).cast("double").alias(label), raw, prediction)
    small = small.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return {k: e.evaluate(small) for k, e in evaluators(label, raw, prediction).items()}
    finally:
        small.unpersist()


@dataclass
class Fitted:
    """A trained base model with its validation metrics."""

    model: PipelineModel
    model_type: str
    window_idx: int
    auc: float
    f1: float
    accuracy: float
    seconds: float

    @property
    def model_id(self) -> str:
        return f"w{self.window_idx:05d}-{self.model_type}"


A, B = TypeVar("A"), TypeVar("B")


def side_by_side(spark: SparkSession, work: Callable[[A], B], items: Sequence[A], parallel: int = PARALLEL) -> list[B]:
    """``work`` of every item, in their order; the Spark jobs of up to
    ``parallel`` items run at once, each item in a scheduler pool of its own
    (these share the executors evenly where ``spark.scheduler.mode`` is FAIR).
    The stages of one fit are short and many, so alone it leaves cores idle.
    The first error is raised when the items at work have ended; none is begun
    after it."""
    def run(item: A) -> B:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"item-{item}")
        return work(item)

    with ThreadPoolExecutor(max(1, min(parallel, len(items)))) as pool:
        jobs = [pool.submit(inheritable_thread_target(spark)(run), i) for i in items]
        try:
            return [j.result() for j in jobs]
        except BaseException:
            pool.shutdown(wait=True, cancel_futures=True)
            raise


def fit_all(train: DataFrame, valid: DataFrame, features: Sequence[str], label: str, window_idx: int = 0,
            seed: int = 42, types: Sequence[str] = MODEL_TYPES, parallel: int = PARALLEL, **build) -> list[Fitted]:
    """Fit every model type, ``parallel`` at a time. Training and validation
    rows are cut to the columns in use and kept for all fits."""
    cols = [*features, label]
    train, valid = (d.select(*cols).persist(StorageLevel.MEMORY_AND_DISK) for d in (train, valid))

    def one(t: str) -> Fitted:
        start = time.perf_counter()
        model = build_model(features, label, t, seed, **build).fit(train)
        seconds = time.perf_counter() - start
        m = evaluate_frame(model.transform(valid), label)
        return Fitted(model, t, window_idx, m["auc"], m["f1"], m["accuracy"], seconds)

    try:
        for d in (train, valid):
            d.count()  # kept before the fits begin, so that no two of them read the source
        return side_by_side(train.sparkSession, one, list(types), parallel)
    finally:
        train.unpersist()
        valid.unpersist()


def best_of(fitted: Sequence[Fitted]) -> Fitted:
    """Highest validation AUC; of equals, the first."""
    return max(fitted, key=lambda f: f.auc)


def metrics_table(spark, fitted: Sequence[Fitted]) -> DataFrame:
    rows = [(f.model_id, f.model_type, f.window_idx, f.auc, f.f1, f.accuracy, f.seconds) for f in fitted]
    return spark.createDataFrame(
        rows, "model_id string, model_type string, window_idx int, auc double, f1 double, "
              "accuracy double, seconds double")


def ensemble_predict(df: DataFrame, members: Sequence[tuple[PipelineModel, float]]) -> DataFrame:
    """Weighted soft vote. Scoring is row-local, so the models are chained on
    the same rows: no row ids, no joins, no shuffle."""
    if not members:
        raise RuntimeError("ensemble is empty")
    cols = df.columns
    for i, (model, weight) in enumerate(members):
        df = (model.transform(df).withColumn(f"_w{i}", weighted_probability(weight))
              .drop(*[c for c in MODEL_COLUMNS if c not in cols]))
    total = sum((F.col(f"_w{i}") for i in range(1, len(members))), F.col("_w0"))
    return df.select(*cols, total.alias("ensemble_score"),
                     threshold(total).alias("ensemble_prediction"))


def model_scores(df: DataFrame, key: Sequence[str], model: PipelineModel, name: str) -> DataFrame:
    """Stored-score form: ``key`` and the probability of class 1 as ``name``."""
    return model.transform(df).select(*key, weighted_probability(1.0).alias(name))


def ensemble_by_join(df: DataFrame, key: Sequence[str], scores: Sequence[DataFrame],
                     names: Sequence[str], weights: Sequence[float], merge: bool = False) -> DataFrame:
    """The same vote from score tables kept apart, joined by row key."""
    total = sum((F.col(n) * w for n, w in zip(names[1:], weights[1:])), F.col(names[0]) * weights[0])
    return (join_scores(df, scores, key, merge).withColumn("ensemble_score", total)
            .withColumn("ensemble_prediction", threshold(F.col("ensemble_score")))
            .drop(*names))


def evaluate_ensemble(df: DataFrame, members, label: str) -> dict[str, float]:
    scored = ensemble_predict(df, members)
    return evaluate_frame(scored.withColumn("_raw", score_vector(F.col("ensemble_score"))),
                          label, "_raw", "ensemble_prediction")


def static_baseline(first_window: DataFrame, features: Sequence[str], label: str, key: Sequence[str],
                    seed: int = 42, **build) -> PipelineModel:
    """A single gbt trained on the first window's training part, never renewed."""
    train, _ = split(first_window, key, 0.8, seed)
    return build_model(features, label, "gbt", seed, **build).fit(train.select(*features, label))


def compare_training(full: DataFrame, sample: DataFrame, features: Sequence[str], label: str,
                     key: Sequence[str], types: Sequence[str] = ("lr", "dt", "rf", "gbt"),
                     seed: int = 42, model_set: str = "notebook", save_to: str | None = None) -> DataFrame:
    """AUC on the full test part and fit time: trained on all data or on the
    sample. With ``save_to`` the full-data models are saved there."""
    train, test = split(full, key, 0.8, seed)
    small, _ = split(sample, key, 0.8, seed)
    rows = []
    for name, data in (("full", train), ("sample", small)):
        for f in fit_all(data, test, features, label, seed=seed, types=types, scale="std", model_set=model_set):
            rows.append((name, f.model_type, f.auc, f.seconds))
            if save_to and name == "full":
                save_model(f.model, f"{save_to}/{f.model_type}")
    return full.sparkSession.createDataFrame(
        rows, "training_data string, model_type string, auc double, seconds double")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def rescore_saved(paths: dict[str, str], data: dict[str, DataFrame], label: str) -> DataFrame:
    """Load saved models and score every data set: ``(model, data, auc)``."""
    spark = next(iter(data.values())).sparkSession
    rows = []
    for name, path in paths.items():
        model = load_model(path)
        for part, df in data.items():
            scored = model.transform(df).select(F.col(label).cast("double").alias(label), "rawPrediction")
            rows.append((name, part, evaluators(label)["auc"].evaluate(scored)))
    return spark.createDataFrame(rows, "model string, data string, auc double")


def block_trees(blocks: DataFrame, test: DataFrame, features: Sequence[str], label: str,
                key: Sequence[str], block_ids: Sequence[int], seed: int = 42, parallel: int = PARALLEL) -> DataFrame:
    """One tree per sample block, ``parallel`` at a time, then a majority vote:
    ``key, label, vote``."""
    def fit(b: int) -> PipelineModel:
        train = blocks.where(F.col("block_id") == b).select(*features, label)
        return build_model(features, label, "dt", seed, scale="none").fit(train)

    votes = None
    for model in side_by_side(blocks.sparkSession, fit, list(block_ids), parallel):
        v = model.transform(test).select(*key, label, F.col("prediction").cast("int").alias("prediction"))
        votes = v if votes is None else votes.unionByName(v)
    return majority_vote(votes, [*key, label])


def cluster(df: DataFrame, features: Sequence[str], k: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """k-means: rows with ``cluster``, and ``(cluster, size)``."""
    model = Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip"),
        KMeans(k=k, seed=seed, predictionCol="cluster")]).fit(df.select(*features))
    out = model.transform(df).drop("features")
    return out, out.groupBy("cluster").agg(F.count("*").alias("size"))


def pick_best(table: DataFrame) -> DataFrame:
    """Arg-max over the metrics table, per window."""
    order = F.array_position(F.array(*[F.lit(t) for t in MODEL_TYPES]), F.col("model_type"))
    return best_by(table.withColumn("_order", order), "auc", "_order", ["window_idx"]).drop("_order")
