"""Kolmogorov-Smirnov distances, for many samples and features in one plan."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftspark.plans.buckets import (
    MOST_SPANS,
    NULL_BUCKET,
    feature_name,
    fit_cuts,
    no_nan,
    order_statistics,
    running,
    subdivided,
    tile_by_cuts,
    to_long,
)


def stack_sides(ref: DataFrame, det: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Both samples in one frame, ``side`` 0 for ``ref`` and 1 for ``det``."""
    if not cols:
        raise ValueError("feature columns must be non-empty")
    if "side" in cols:
        raise ValueError("a column may not be named side: rename it first")
    cols = list(dict.fromkeys(cols))
    return (ref.select(*cols, F.lit(0).alias("side"))
            .unionByName(det.select(*cols, F.lit(1).alias("side"))))


def _gap(ci: str, cj: str, ni: str, nj: str) -> str:
    return f"CASE WHEN {ni} > 0 AND {nj} > 0 THEN abs(({ci}) / {ni} - ({cj}) / {nj}) ELSE 0D END"


def count_cube(long: DataFrame, member: str) -> DataFrame:
    """Rows, least and largest value of every (feature, bucket, member): one
    map-side count, of features x buckets x members rows at most. Any sample
    made of whole members (blocks, windows, sides) is a sum of cells."""
    return long.groupBy("feature_id", "bucket", member).agg(
        F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))


def ks_samples(df: DataFrame, features: Sequence[str], member: str,
               samples: Sequence[str], pairs: Sequence[tuple[int, int, int]],
               n_buckets: int = 256, exact: bool = True, nulls: str = "drop",
               cuts: dict[str, list[float]] | None = None, bounds: bool = False,
               n: int | None = None, cube: DataFrame | None = None) -> DataFrame:
    """KS distance of many pairs of (overlapping) samples at once.

    ``samples`` are SQL conditions on the column ``member``; ``pairs`` are
    ``(pair_id, i, j)`` over them. Returns ``(pair, feature, ks)``.

    Pass 1 is the :func:`count_cube`, or reads one: every sample is a sum of
    its cells, so its size does not matter. It yields the distance
    at every bucket end, and a bound on what can happen inside a bucket. Only
    buckets whose bound exceeds the distance already reached are sorted in
    pass 2; a bucket holding a single value never is.

    ``nulls="drop"`` leaves nulls out; ``"count"`` keeps them in the sample
    size only. ``exact=False`` stops after pass 1; with ``bounds`` it then adds
    ``ks_most``, so that the exact distance lies in [ks, ks_most]. ``n`` saves
    a count when the number of rows is known, ``cube`` the scan of pass 1.
    """
    if not features:
        raise ValueError("feature columns must be non-empty")
    if nulls not in ("drop", "count"):
        raise ValueError(f"unknown null mode {nulls!r}")
    if exact and n is None:
        n = df.count()
    if not cuts:
        # the cut points are where an inexact distance is looked at
        cuts = fit_cuts(df, features, n_buckets, n) if exact or bounds else exact_cuts(df, features, n_buckets)
    long = to_long(df, features, cuts, [member], keep_nulls=nulls == "count")
    m, k = range(len(samples)), range(len(pairs))
    inside = [f"CASE WHEN {s} THEN 1 ELSE 0 END" for s in samples]
    c = [f"c{i}" for i in m]
    cells = count_cube(long, member) if cube is None else cube
    hist = cells.groupBy("feature_id", "bucket").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        *[F.expr(f"sum(n * {x}) AS {c_}") for x, c_ in zip(inside, c)])
    hist = running(hist, ["feature_id"], c)
    end, bound = [], []
    for x, (_, i, j) in enumerate(pairs):
        before, after = [f"c{n}_before" for n in (i, j)], [f"c{n}_before + c{n}" for n in (i, j)]
        size = [f"c{n}_all" for n in (i, j)]
        # naming both lo and hi keeps the histogram the same in every branch of
        # the plan, so that Spark runs it once and reuses its shuffle
        end.append(f"CASE WHEN lo IS NULL OR hi IS NULL THEN 0D ELSE {_gap(*after, *size)} END AS e{x}")
        bound.append(f"greatest({_gap(after[0], before[1], *size)}, {_gap(before[0], after[1], *size)}) AS u{x}")
    ends = hist.selectExpr("*", *end, *bound)
    most = [F.expr(f"greatest(max(e{x}), max(CASE WHEN lo < hi THEN u{x} END)) AS m{x}") for x in k]
    best = ends.groupBy("feature_id").agg(*[F.expr(f"max(e{x}) AS k{x}") for x in k], *(most if bounds else []))
    if exact:
        rest = [f"{n}_{s}" for n in c for s in ("before", "all")]
        unsettled = (ends.selectExpr("*", *[f"max(e{x}) OVER (PARTITION BY feature_id) AS l{x}" for x in k])
                     .where("lo < hi AND (" + " OR ".join(f"u{x} > l{x}" for x in k) + ")")
                     .select("feature_id", F.col("bucket").alias("_whole"), *rest))
        # at most features x n_buckets rows are broadcast; the running sums
        # include the rows of an equal value. Rows of unsettled buckets only
        # are cut further, where these hold too many to be sorted in one task.
        # What is moved and sorted is narrow: the counts before a bucket, two
        # for every sample, come to the rows after that
        same = (F.col("feature_id") == F.col("_feature")) & (F.col("bucket") == F.col("_whole"))
        places = unsettled.select(F.col("feature_id").alias("_feature"), "_whole")
        rows = long.join(F.broadcast(places), same, "left_semi")
        spans = subdivided(rows, n, n_buckets)
        ran = spans.selectExpr("feature_id", "bucket", *[
            f"sum({x}) OVER (PARTITION BY feature_id, bucket ORDER BY value) AS _s{i}" for i, x in enumerate(inside)])
        before = [f"{c_}_before" for c_ in c]
        if spans is rows:
            ran = ran.withColumn("_whole", F.col("bucket"))
        else:
            whole = F.shiftright("bucket", MOST_SPANS.bit_length() - 1)
            part = spans.groupBy("feature_id", "bucket").agg(
                *[F.expr(f"sum({x}) AS _s{i}") for i, x in enumerate(inside)])
            earlier = Window.partitionBy("feature_id", whole).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
            part = part.select("feature_id", "bucket", *[F.coalesce(F.sum(f"_s{i}").over(earlier), F.lit(0)).alias(f"_p{i}") for i in m])
            # the rows are in this order already
            ran = ran.join(part.hint("merge"), ["feature_id", "bucket"]).withColumn("_whole", whole)
            before = [f"{c_}_before + _p{i}" for i, c_ in enumerate(c)]
        inner = (ran.join(F.broadcast(unsettled), ["feature_id", "_whole"])
                 .selectExpr("feature_id", *[f"{n_}_all" for n_ in c], *[f"_s{i} + {x} AS t{i}" for i, x in enumerate(before)])
                 .groupBy("feature_id").agg(*[
                     F.expr(f"max({_gap(f't{i}', f't{j}', f'c{i}_all', f'c{j}_all')}) AS r{x}")
                     for x, (_, i, j) in enumerate(pairs)]))
        best = best.join(inner, "feature_id", "left").selectExpr(
            "feature_id", *[f"greatest(k{x}, r{x}) AS k{x}" for x in k])
    extra = ["ks_most"] if bounds and not exact else []
    cells = ", ".join(f"named_struct('pair', {p[0]}, 'ks', k{x}" + (f", 'ks_most', m{x})" if extra else ")")
                      for x, p in enumerate(pairs))
    return best.select("feature_id", F.expr(f"inline(array({cells}))")).select(
        "pair", feature_name(features).alias("feature"), "ks", *extra)


def step_bounds(cube: DataFrame, ts: Sequence[int]) -> DataFrame:
    """``(t, ks, ks_most)`` per feature and step: the distance between the first
    t-1 and the first t blocks lies between the two, as ``ks_samples`` with
    ``bounds`` finds it. The cells of a feature are as many as arguments say;
    columns for every step would take longer to plan than the counting does.
    """
    ts, width = list(ts), max(ts)

    def bounds(pdf: pd.DataFrame) -> pd.DataFrame:
        ends = pdf.groupby("bucket").agg(lo=("lo", "min"), hi=("hi", "max")).sort_index()
        at, block = ends.index.get_indexer(pdf["bucket"]), pdf["block_id"].to_numpy()
        counts, near = np.zeros((len(ends), width)), block < width
        np.add.at(counts, (at[near], block[near]), pdf["n"].to_numpy()[near])
        held = counts.cumsum(axis=1)
        after = held.cumsum(axis=0)
        before, size = after - held, after[-1]
        lo, hi = ends["lo"].to_numpy(dtype=float), ends["hi"].to_numpy(dtype=float)
        out = []
        for t in ts:
            i, j = t - 2, t - 1
            if not size[i] or not size[j]:
                out.append((t, 0.0, 0.0))
                continue
            gap = lambda a, b: np.abs(a[:, i] / size[i] - b[:, j] / size[j])
            ks = np.where(np.isnan(lo) | np.isnan(hi), 0.0, gap(after, after)).max()
            inner = np.maximum(gap(after, before), gap(before, after))[lo < hi]
            out.append((t, ks, max(ks, inner.max(initial=0.0))))
        return pd.DataFrame(out, columns=["t", "ks", "ks_most"])

    return cube.groupBy("feature_id").applyInPandas(bounds, "t int, ks double, ks_most double")


def ks_exact(ref: DataFrame, det: DataFrame, features: Sequence[str], **kw) -> DataFrame:
    """Exact two-sample KS distance per feature: ``(feature, ks)``."""
    both = stack_sides(ref, det, features)
    return ks_samples(both, features, "side", ["side = 0", "side = 1"], [(0, 0, 1)], **kw).drop("pair")


def quantiles(df: DataFrame, features: Sequence[str], probs: Sequence[float],
              exact: bool = True, accuracy: int = 100) -> dict[str, list[float]]:
    """Quantiles per feature: exact with linear interpolation, or a sketch."""
    if not exact:
        row = df.agg(*[F.percentile_approx(no_nan(c), list(probs), accuracy).alias(f"q{i}")
                       for i, c in enumerate(features)]).first()
        return {c: list(row[f"q{i}"] or []) for i, c in enumerate(features)}
    cuts = fit_cuts(df, features, 256)

    def ranks(_, n):
        low = [int((n - 1) * p) for p in probs]
        return [r + 1 for r in low] + [min(r + 2, n) for r in low]

    found, totals = order_statistics(to_long(df, features, cuts), ranks)
    out = {}
    for fid, c in enumerate(features):
        n, out[c] = totals.get(fid, 0), []
        for p in probs if n else []:
            h = (n - 1) * p
            a, b = found[fid, int(h) + 1], found[fid, min(int(h) + 2, n)]
            out[c].append(a + (b - a) * (h - int(h)))
    return out


def exact_cuts(df: DataFrame, features: Sequence[str], n_buckets: int) -> dict[str, list[float]]:
    """Exact quantiles of all rows as cut points, the same for any layout."""
    q = quantiles(df, features, [i / n_buckets for i in range(1, n_buckets)])
    return {c: sorted({v for v in q[c] if math.isfinite(v)}) or [0.0] for c in features}


def quantile_table(df: DataFrame, features: Sequence[str], probs: Sequence[float],
                   exact: bool = True) -> DataFrame:
    """:func:`quantiles` as rows ``(feature, p, value)``."""
    q = quantiles(df, features, probs, exact)
    rows = [(c, float(p), float(v)) for c in features for p, v in zip(probs, q[c])]
    return df.sparkSession.createDataFrame(rows, "feature string, p double, value double")


def ks_points(ref: DataFrame, det: DataFrame, features: Sequence[str], num_points: int = 50,
              exact: bool = False, nulls: str = "drop") -> DataFrame:
    """KS distance looked at only in ``num_points`` quantiles of ``ref``.

    Two jobs whatever the number of features: the quantiles (a sketch unless
    ``exact``), then one count of each side between neighbouring points.
    """
    probs = [i / (num_points - 1) for i in range(num_points)]
    points = quantiles(ref, features, probs, exact)
    both = stack_sides(ref, det, features)
    names = list(features)
    # value <= point falls into a tile at or before the point's own
    tiles = both.select("side", *[no_nan(c).alias(c) for c in names])
    for i, c in enumerate(names):
        tiles = tile_by_cuts(tiles, F.col(c), points[c], f"_t{i}", NULL_BUCKET)
    cells = F.array(*[F.struct(F.lit(i).alias("feature_id"), F.col(c).alias("value"),
                               F.col(f"_t{i}").alias("bucket")) for i, c in enumerate(names)])
    long = tiles.select("side", F.explode(cells).alias("_x")).select("side", "_x.*")
    if nulls == "drop":
        long = long.where(F.col("value").isNotNull())
    hist = (long.groupBy("feature_id", "bucket")
            .agg(*[F.sum(F.when(F.col("side") == s, 1).otherwise(0)).alias(f"c{s}") for s in (0, 1)]))
    hist = running(hist, ["feature_id"], ["c0", "c1"])
    last = F.element_at(F.array(*[F.lit(len(set(points[c]))) for c in names]),
                        F.col("feature_id") + 1)
    gap = F.expr(_gap("c0_before + c0", "c1_before + c1", "c0_all", "c1_all"))
    return (hist.groupBy("feature_id")
            .agg(F.max(F.when(F.col("bucket") < last, gap).otherwise(0.0)).alias("ks"))
            .select(feature_name(names).alias("feature"), "ks"))


def ks_max(table: DataFrame) -> DataFrame:
    """Largest distance over the features."""
    return table.agg(F.coalesce(F.max("ks"), F.lit(0.0)).alias("ks_max"))
