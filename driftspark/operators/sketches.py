"""Stored quantile sketches: compare windows without reading their rows again.

One KLL sketch per window and feature is made in one aggregate (map-side, so a
large window is no large task) and appended to a table. Sketches merge: any
union of windows is compared with any other from a few kilobytes a feature,
whatever the number of rows behind them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspark.plans.buckets import no_nan

# Size parameter of a sketch, and quantiles at which two are compared.
SIZE, POINTS = 1024, 250


def ks_error(size: int = SIZE, points: int = POINTS) -> float:
    """How far the distance of two sketches may lie from the exact one, at 99 %:
    the rank error of either (a known property of KLL sketches) and the share
    of rows between two of the points, on either side."""
    return 2 * 2.296 / size**0.9723 + 2 / points


def window_sketches(df: DataFrame, window: str, features: Sequence[str], size: int = SIZE) -> DataFrame:
    """``(window, feature, n, sketch)``; ``n`` values went in, nulls and NaN
    did not. A window without values of a feature has no row for it."""
    made = df.groupBy(F.col(window).alias("window")).agg(
        *[F.kll_sketch_agg_double(no_nan(c), size).alias(f"_k{i}") for i, c in enumerate(features)])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_k{i}").alias("sketch")) for i, c in enumerate(features)])
    long = made.select("window", F.explode(cells).alias("_x")).select("window", "_x.*")
    return (long.withColumn("n", F.kll_sketch_get_n_double("sketch")).where("n > 0")
            .select("window", "feature", "n", "sketch"))


def append_sketches(sketches: DataFrame, path: str) -> None:
    """Adds windows to a stored table. Part of a window may come later: its
    sketches are merged when they are read."""
    sketches.write.mode("append").parquet(path)


def merged(sketches: DataFrame, *by: str) -> DataFrame:
    """One sketch per feature and group of ``by``."""
    return (sketches.groupBy(*by, "feature").agg(F.kll_merge_agg_double("sketch").alias("sketch"))
            .withColumn("n", F.kll_sketch_get_n_double("sketch")).select(*by, "feature", "n", "sketch"))


def read_sketches(spark: SparkSession, path: str) -> DataFrame:
    return merged(spark.read.parquet(path), "window")


def sketch_ks(a: str, b: str, points: int = POINTS) -> Column:
    """KS distance of two sketch columns: the largest gap of the numbers of
    their quantiles up to a quantile of either."""
    probs = "array(" + ", ".join(f"{i / points!r}D" for i in range(points + 1)) + ")"
    qa, qb = (F.expr(f"kll_sketch_get_quantile_double({c}, {probs})") for c in (a, b))
    upto = lambda q, v: F.size(F.filter(q, lambda x: x <= v))
    pair = F.struct(qa.alias("a"), qb.alias("b"))
    # the quantiles are taken once, as the only element of an array
    gaps = F.transform(F.array(pair), lambda p: F.array_max(F.transform(
        F.array_union(p["a"], p["b"]), lambda v: F.abs(upto(p["a"], v) - upto(p["b"], v)))))
    return F.element_at(gaps, 1) / F.lit(float(points))


def union_ks(sketches: DataFrame, first: Column, second: Column, points: int = POINTS) -> DataFrame:
    """``(feature, n, n_other, ks)`` of two unions of windows, each given as a
    condition on ``window``; null where one side is empty."""
    one = merged(sketches.where(first))
    other = merged(sketches.where(second)).select("feature", F.col("n").alias("n_other"), F.col("sketch").alias("_other"))
    both = one.join(other, "feature", "full")
    there = F.col("sketch").isNotNull() & F.col("_other").isNotNull()
    return both.select("feature", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_other", F.lit(0)).alias("n_other"),
                       F.when(there, sketch_ks("sketch", "_other", points)).alias("ks"))


def sketch_drift(sketches: DataFrame, against: str = "before", points: int = POINTS) -> DataFrame:
    """Every window against the union of all earlier ones (``before``) or the
    one before it (``previous``): ``(window, feature, n, n_before, ks)``. The
    first window of a feature has no row."""
    if against not in ("before", "previous"):
        raise ValueError(f"unknown comparison {against!r}")
    frame = "UNBOUNDED PRECEDING" if against == "before" else "1 PRECEDING"
    # sketches, not rows: one per window of a feature
    earlier = F.expr("kll_merge_agg_double(sketch) OVER (PARTITION BY feature ORDER BY window "
                     f"ROWS BETWEEN {frame} AND 1 PRECEDING)")
    rows = sketches.withColumn("_before", earlier).withColumn("n_before", F.kll_sketch_get_n_double("_before"))
    return rows.where("n_before > 0").select("window", "feature", "n", "n_before", F.when(
        F.col("n_before") > 0, sketch_ks("sketch", "_before", points)).alias("ks"))
