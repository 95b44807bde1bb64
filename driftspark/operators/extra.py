"""Smaller operators: equal-height histograms, block picks, range keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftspark.functions.hashing import hash_key
from driftspark.operators.metrics import histogram
from driftspark.plans.buckets import NULL_BUCKET, fit_cuts, order_statistics, running, subdivided, tile_by_cuts, to_long


def equal_height_bounds(df: DataFrame, value: str, k: int) -> DataFrame:
    """Smallest value, every (n div k)-th value, largest: ``(i, bound)``."""
    def ranks(_, n):
        return [1, *[max(1, i * (n // k)) for i in range(1, k)], n]

    found, totals = order_statistics(to_long(df, [value], fit_cuts(df, [value], 256)), ranks)
    rows = [(i, float(found[0, r])) for i, r in enumerate(ranks(0, totals[0]))] if totals else []
    return df.sparkSession.createDataFrame(rows, "i int, bound double")


def split_overshoot(df: DataFrame, value: str, split_num: int, k: int) -> DataFrame:
    """Largest excess over n div k when equal-width bins fill ``k`` groups.

    Bins are added to a group until it holds n div k rows. The fold runs over
    the ``split_num`` bin counts, not over rows.
    """
    h = histogram(df, value, split_num)
    bins = h.agg(F.array_sort(F.collect_list(F.struct("bin", "cnt"))).alias("b"),
                 F.sum("cnt").alias("n")).withColumn("goal", F.floor(F.col("n") / k))
    step = ("aggregate(b, named_struct('here', 0L, 'groups', 0, 'worst', cast(null as bigint)), (s, x) -> "
            f"CASE WHEN s.groups >= {k} THEN s "
            "WHEN s.here + x.cnt >= goal THEN named_struct('here', 0L, 'groups', s.groups + 1, "
            "'worst', greatest(s.worst, s.here + x.cnt - goal)) "
            "ELSE named_struct('here', s.here + x.cnt, 'groups', s.groups, 'worst', s.worst) END)")
    return bins.select(F.expr(step).alias("s"), "goal").select(
        F.when((F.col("s.here") > 0) & (F.col("s.groups") < k),
               F.greatest(F.col("s.worst"), F.col("s.here") - F.col("goal")))
        .otherwise(F.col("s.worst")).cast("double").alias("overshoot"))


def pick_blocks(blocks: DataFrame, col: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` different block ids, at random."""
    return (blocks.select(col).distinct().withColumn("_h", hash_key([col], seed))
            .orderBy("_h", col).limit(n).drop("_h"))


def range_part(key: Column, records: int) -> Column:
    """Partition number of a key when each partition spans ``records`` keys."""
    return F.floor(key / records).cast("long")


def range_partition(df: DataFrame, key: str, records: int) -> DataFrame:
    """Rows laid out by :func:`range_part`."""
    return df.withColumn("part", range_part(F.col(key), records)).repartitionByRange("part", key)


def running_total(df: DataFrame, order: str, amount: Column, out: str = "total_before") -> DataFrame:
    """Sum of ``amount`` over all earlier rows by a unique numeric position."""
    from pyspark.sql import Window

    n = df.count()
    rows = tile_by_cuts(df.withColumn("_amount", amount), F.col(order),
                        fit_cuts(df, [order], 256, n)[order], "bucket", NULL_BUCKET)
    rows = subdivided(rows, n, 256, order, ["bucket"])
    hist = running(rows.groupBy("bucket").agg(F.sum("_amount").alias("_s")), [], ["_s"])
    w = Window.partitionBy("bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (rows.join(hist.select("bucket", "_s_before"), "bucket")
            .withColumn(out, F.coalesce(F.sum("_amount").over(w), F.lit(0)) + F.col("_s_before"))
            .drop("_amount", "bucket", "_s_before"))


def distinct_sorted(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct().orderBy(col)


def stack_rows(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; a column a frame lacks is null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
