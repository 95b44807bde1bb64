"""Ensemble arithmetic on tables of members and of scores.

members: ``model_id, model_type, window_idx``; scores: ``row key, model_id, p``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Kinds of base model.
MODEL_TYPES = ["dt", "rf", "gbt", "lr"]


def _newest(by: Sequence[str]) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("window_idx"), F.desc("model_id")))


def recency_weights(members: DataFrame, decay: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """Add ``weight``: decay^age, oldest smallest, summing to one per group."""
    return (members.withColumn("_raw", F.pow(F.lit(float(decay)), _newest(by) - 1))
            .withColumn("weight", F.col("_raw") / F.sum("_raw").over(Window.partitionBy(*by)))
            .drop("_raw"))


def evict(members: DataFrame, max_size: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """The newest ``max_size`` members."""
    return members.withColumn("_age", _newest(by)).where(F.col("_age") <= max_size).drop("_age")


def soft_vote(scores: DataFrame, members: DataFrame, key: Sequence[str], at: float = 0.5) -> DataFrame:
    """Weighted vote on stored scores: ``key, ensemble_score, ensemble_prediction``.

    The members table is bounded by the ensemble size, so it is broadcast.
    """
    return (scores.join(F.broadcast(members.select("model_id", "weight")), "model_id")
            .groupBy(*key).agg(F.sum(F.col("p") * F.col("weight")).alias("ensemble_score"))
            .withColumn("ensemble_prediction", (F.col("ensemble_score") >= at).cast("double")))


def store_bucketed(df: DataFrame, name: str, path: str, key: Sequence[str], buckets: int) -> DataFrame:
    """``df`` as table ``name`` in files at ``path``, bucketed and sorted by
    ``key``. Tables of one bucket count are joined, or grouped, on the key
    without moving rows; the rows are dealt once, when they are written."""
    (df.repartition(buckets, *key).write.mode("overwrite").bucketBy(buckets, *key).sortBy(*key)
     .option("path", path).saveAsTable(name))
    return df.sparkSession.table(name)


def join_scores(df: DataFrame, scores: Sequence[DataFrame], key: Sequence[str],
                merge: bool = False) -> DataFrame:
    """Stored score tables side by side with the rows, by key.

    ``merge`` asks for a sort-merge join. All joins share the key, so the rows
    are shuffled and sorted once for any number of tables.
    """
    for s in scores:
        df = (df.hint("merge") if merge else df).join(s, list(key), "inner")
    return df


def majority_vote(votes: DataFrame, key: Sequence[str], prediction: str = "prediction") -> DataFrame:
    """Most frequent prediction per row; a tie goes to the lowest label."""
    return (votes.groupBy(*key, prediction).agg(F.count("*").alias("_n"))
            .groupBy(*key)
            .agg(F.max_by(F.col(prediction), F.struct("_n", -F.col(prediction))).alias("vote")))


def best_by(models: DataFrame, metric: str, order: str, by: Sequence[str] = ()) -> DataFrame:
    """The model with the highest metric; of equals, the first by ``order``."""
    w = Window.partitionBy(*by).orderBy(F.desc(metric), order)
    return models.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def ensemble_by_window(members: DataFrame, last_window: int | Column, max_size: int = 5,
                       decay: float = 0.5) -> DataFrame:
    """Which members are alive, with which weight, in every window.

    A member lives until ``max_size`` newer ones have been added.
    """
    w = Window.orderBy("window_idx", "model_id")  # one row per model ever trained
    end = F.coalesce(F.lead("window_idx", max_size).over(w) - 1,
                     last_window if isinstance(last_window, Column) else F.lit(last_window))
    alive = (members.withColumn("_end", end).where(F.col("_end") >= F.col("window_idx"))
             .withColumn("window", F.explode(F.sequence("window_idx", "_end"))).drop("_end"))
    return recency_weights(alive, decay, by=["window"])


def composition(alive: DataFrame) -> DataFrame:
    """Weight per model type and window, one column per type."""
    return (alive.groupBy("window").pivot("model_type", MODEL_TYPES).agg(F.sum("weight"))
            .na.fill(0.0, MODEL_TYPES))
