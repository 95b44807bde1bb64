"""Evaluation from scored rows ``(label, score, prediction)``, overall or per
group (``by``), and the data behind the usual plots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftspark.plans.buckets import NULL_BUCKET, fit_cuts, group_key, no_nan, running, subdivided, tile_by_cuts
from driftspark.plans.workdir import new_path


def _score_steps(df: DataFrame, label: str, score: str, by: Sequence[str]) -> DataFrame:
    """Per distinct score: positives and negatives there, strictly below, in all.

    Rows are first counted per (group, score), so neither a large group nor a
    popular score makes a large task; the running counts go by score bucket.
    """
    rows = df.select(group_key(by).alias("_g"), F.col(label).cast("double").alias("_y"),
                     no_nan(score).alias("_s")).dropna(subset=["_s", "_y"])
    n = rows.count()
    rows = tile_by_cuts(rows, F.col("_s"), fit_cuts(rows, ["_s"], 256, n)["_s"], "bucket", NULL_BUCKET)
    rows = subdivided(rows, n, 256, "_s", ["bucket"])
    counts = rows.groupBy("_g", "bucket", "_s").agg(
        F.sum(F.when(F.col("_y") == 1, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col("_y") == 1, 0).otherwise(1)).alias("neg"))
    hist = counts.groupBy("_g", "bucket").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    hist = running(hist, ["_g"], ["p", "n"]).drop("p", "n")
    w = (Window.partitionBy("_g", "bucket").orderBy("_s")
         .rowsBetween(Window.unboundedPreceding, -1))
    return (counts.join(hist, ["_g", "bucket"])
            .select(*[F.col(f"_g.{c}").alias(c) for c in by], F.col("_s").alias("score"), "pos", "neg",
                    (F.coalesce(F.sum("pos").over(w), F.lit(0)) + F.col("p_before")).alias("pos_below"),
                    (F.coalesce(F.sum("neg").over(w), F.lit(0)) + F.col("n_before")).alias("neg_below"),
                    F.col("p_all").alias("n_pos"), F.col("n_all").alias("n_neg")))


def auc(df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve; ties count one half."""
    won = F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)
    return (_score_steps(df, label, score, by).groupBy(*by)
            .agg((F.sum(won) / F.nullif(F.max("n_pos") * F.max("n_neg"), F.lit(0))).alias("auc")))


def roc_points(df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """``(threshold, fpr, tpr)`` for every distinct score."""
    c = F.col
    return _score_steps(df, label, score, by).select(
        *by, c("score").alias("threshold"),
        ((c("n_neg") - c("neg_below")) / F.nullif(c("n_neg"), F.lit(0))).alias("fpr"),
        ((c("n_pos") - c("pos_below")) / F.nullif(c("n_pos"), F.lit(0))).alias("tpr"))


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction",
             by: Sequence[str] = ()) -> DataFrame:
    """Share of right predictions, any number of classes."""
    return df.groupBy(*by).agg(
        F.avg((F.col(prediction) == F.col(label)).cast("double")).alias("accuracy"))


def weighted_f1(df: DataFrame, label: str = "label", prediction: str = "prediction",
                by: Sequence[str] = ()) -> DataFrame:
    """F1 per class, weighted by the class's share of the labels."""
    cells = df.groupBy(*by, F.col(label).cast("double").alias("y"),
                       F.col(prediction).cast("double").alias("p")).agg(F.count("*").alias("n"))
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)
    sides = F.explode(F.array(
        F.struct(F.col("y").alias("c"), F.col("n").alias("is"), F.lit(0).cast("long").alias("said"), hit.alias("hit")),
        F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("is"), F.col("n").alias("said"), F.lit(0).cast("long").alias("hit")),
    )).alias("_x")
    per_class = (cells.select(*by, sides).groupBy(*by, "_x.c")
                 .agg(F.sum("_x.is").alias("is"), F.sum("_x.said").alias("said"), F.sum("_x.hit").alias("hit")))
    f1 = 2 * F.col("hit") / (F.col("is") + F.col("said"))
    return per_class.groupBy(*by).agg((F.sum(F.col("is") * f1) / F.sum("is")).alias("f1"))


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction",
              by: Sequence[str] = (), classes: Sequence[int] = (0, 1)) -> DataFrame:
    """Rows per (label, prediction) on the grid of ``classes`` and of whatever
    other labels and predictions the data holds: no row is left out. A null
    label or prediction is a class of its own, shown where it occurs."""
    counts = df.groupBy(*by, F.col(label).cast("int").alias("_y"), F.col(prediction).cast("int").alias("_p")).agg(
        F.count("*").alias("_n"))
    # small from here on: one row per group and cell
    grid = F.array_sort(F.array_distinct(F.concat(F.array(*[F.lit(c) for c in classes]), F.flatten(F.collect_set(
        F.filter(F.array("_y", "_p"), lambda x: x.isNotNull())).over(Window.partitionBy())))))
    cells = counts.withColumn("_grid", grid).groupBy(*by).agg(
        F.collect_list(F.struct("_y", "_p", "_n")).alias("_seen"), F.first("_grid").alias("_grid"))
    if not by:  # without rows there is no group to carry the grid
        cells = cells.withColumn("_grid", F.coalesce("_grid", F.array(*[F.lit(c) for c in classes])))

    def seen(a, b):
        return F.aggregate(F.filter("_seen", lambda x: x["_y"].eqNullSafe(a) & x["_p"].eqNullSafe(b)),
                           F.lit(0).cast("long"), lambda n, x: n + x["_n"])

    full = F.flatten(F.transform("_grid", lambda a: F.transform("_grid", lambda b: F.struct(
        a.alias("label"), b.alias("prediction"), seen(a, b).alias("cnt")))))
    missing = F.transform(F.filter("_seen", lambda x: x["_y"].isNull() | x["_p"].isNull()), lambda x: F.struct(
        x["_y"].alias("label"), x["_p"].alias("prediction"), x["_n"].alias("cnt")))
    return cells.select(*by, F.explode(F.concat(full, missing)).alias("_x")).select(*by, "_x.*")


def _bin(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    """0-based bin of equal width; one value only lies in the middle bin."""
    at = F.when(lo == hi, F.lit(0.5)).otherwise((value - lo) / (hi - lo))
    return F.least(F.floor(at * bins), F.lit(bins - 1)).cast("int")


def histogram(df: DataFrame, value: str, bins: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """Rows per bin between each group's own smallest and largest value."""
    rows = df.select(group_key(by).alias("_g"), no_nan(value).alias("_v")).dropna(subset=["_v"])
    # one small row per group; written, so that Spark knows its size when it picks the join
    span = rows.groupBy("_g").agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    path = new_path(df.sparkSession, "spans")
    span.write.parquet(path)
    span = df.sparkSession.read.schema(span.schema).parquet(path)
    at = _bin(F.col("_v"), F.col("lo"), F.col("hi"), bins)
    return (rows.join(span, "_g").groupBy("_g", at.alias("bin"))
            .agg(F.count("*").alias("cnt"), F.min("lo").alias("lo"), F.min("hi").alias("hi"))
            .select(*[F.col(f"_g.{c}").alias(c) for c in by], "bin", "cnt", "lo", "hi"))


def null_density(null: DataFrame, bins: int = 30) -> DataFrame:
    """Histogram of the null distances, with density."""
    h = histogram(null.where("perm > 0"), "swd", bins)
    n = F.sum("cnt").over(Window.partitionBy())
    width = F.when(F.col("lo") == F.col("hi"), F.lit(1.0)).otherwise(F.col("hi") - F.col("lo")) / bins
    return h.withColumn("density", F.col("cnt") / (n * width))
