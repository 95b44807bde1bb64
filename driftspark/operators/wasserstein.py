"""One-dimensional and sliced Wasserstein distances."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftspark.functions.hashing import perm_parts
from driftspark.operators.ks import stack_sides
from driftspark.operators.sampling import equal_sizes
from driftspark.plans.buckets import (
    CUT_SAMPLE_ROWS,
    MOST_SPANS,
    SALTS,
    by_value,
    feature_name,
    fit_cuts,
    hot_values,
    running,
    spread,
    subdivided,
    to_long,
)
from driftspark.plans.workdir import new_path

# Above this many multiplications per row the projection leaves generated
# code (whose methods grow too big to be compiled) for one matrix product per
# Arrow batch.
MAX_INLINE_TERMS = 256
# Quantile levels listed by one row at a time.
LEVELS = 10_000
# Levels looked at in one step over arrays.
LEVELS_AT_ONCE = 65_536
# Values (rows x directions) packed at a time: bounds a task's memory.
PACK_CELLS = 4_000_000
# Values of a bucket that are sorted at a time: wished for, and about, at most.
ROWS_PER_SORT, MOST_ROWS = 65_536, 1_000_000
# Fewer in a bucket are not worth a call.
FEW_ROWS = 4096
# Cells of all groups and directions that a task counts in: bounds its memory.
MOST_CELLS = 4_000_000
# Cells that are added up in one place.
CELLS_AT_ONCE = 4096
# Values that are sorted in one place, about, where a cell needs it.
OPEN_VALUES = 262_144
# Rows that are read by one task, about, where a table is large, and rows below which they are spread.
ROWS_PER_READ, FEW_TO_SPREAD = 4_000_000, 16_000_000
# Cut points handed to the executors: directions x buckets.
MAX_CUTS = 32_768


def directions(n: int, dim: int, seed: int) -> np.ndarray:
    """``n`` random unit vectors, uniform on the sphere. Small by its arguments."""
    d = np.random.default_rng(seed).standard_normal((n, dim))
    return d / np.linalg.norm(d, axis=1, keepdims=True)


def feature_moments(df: DataFrame, features: Sequence[str], by: Sequence[str] = (), *more: Column) -> DataFrame:
    """Mean and population deviation per feature: ``<c>_mean``, ``<c>_std``."""
    aggs = [f(c).alias(f"{c}_{n}") for c in features
            for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return df.groupBy(*by).agg(*aggs, *more)


def side_moments(both: DataFrame, features: Sequence[str]) -> dict:
    """Rows, mean and deviation of each side (0, 1) and of both (None)."""
    aggs = [F.count("*").alias("n")] + [
        f(c).alias(f"{c}_{n}") for c in features for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return {r["side"]: r.asDict() for r in both.rollup("side").agg(*aggs).collect()}


def standardized(both: DataFrame, features: Sequence[str], mode: str, keep: Sequence[str],
                 moments: dict | None = None) -> DataFrame:
    """z-scores; a constant feature is only centred.

    ``reference``: by the mean and deviation of side 0. ``pooled``: of both
    sides together. ``self``: each side by its own, which hides shifts of
    location and scale. ``none``: values as they are.
    """
    if mode not in ("none", "reference", "pooled", "self"):
        raise ValueError(f"unknown standardize mode {mode!r}")
    if mode == "none":
        return both.select(*keep, *[F.col(c).cast("double").alias(c) for c in features])
    rows = moments or side_moments(both, features)

    def z(c, side):
        r = rows.get(side)
        if r is None or r[f"{c}_mean"] is None:
            return F.col(c).cast("double")
        return (F.col(c) - F.lit(r[f"{c}_mean"])) / F.lit(r[f"{c}_std"] or 1.0)

    def cell(c):
        if mode == "pooled":
            return z(c, None)
        if mode == "reference":
            return z(c, 0)
        return F.when(F.col("side") == 0, z(c, 0)).otherwise(z(c, 1))

    return both.select(*keep, *[cell(c).alias(c) for c in features])


def project(df: DataFrame, features: Sequence[str], dirs: np.ndarray,
            keep: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """One column per direction: the dot product of the features with it."""
    names = [f"_p{i}" for i in range(len(dirs))]
    if dirs.size <= MAX_INLINE_TERMS:
        cols = [reduce(lambda a, b: a + b, [F.col(c) * F.lit(float(w)) for c, w in zip(features, d)])
                for d in dirs]
        return df.select(*keep, *[c.alias(n) for c, n in zip(cols, names)]), names
    weights = dirs.T.copy()

    @F.pandas_udf("array<double>")
    def dot(*xs: pd.Series) -> pd.Series:
        return pd.Series(list(np.column_stack(xs) @ weights))

    out = df.select(*keep, dot(*[F.col(c) for c in features]).alias("_p"))
    return out.select(*keep, *[F.col("_p")[i].alias(n) for i, n in enumerate(names)]), names


def w1_exact(long: DataFrame, group: Sequence[str]) -> DataFrame:
    """Exact W1 between the sides of each group, for any two sizes.

    ``long`` has (group, bucket, value, side). W1 is the area between the two
    CDFs: in value order, the gap of the running shares times the distance to
    the next value. Each bucket is sorted on its own; what came before it and
    where the next one starts is read from the histogram. Null for a group
    that has one side only.
    """
    g = list(group)
    hist = (long.groupBy(*g, "bucket")
            .agg(F.sum(F.when(F.col("side") == 0, 1).otherwise(0)).alias("c0"),
                 F.sum(F.when(F.col("side") == 1, 1).otherwise(0)).alias("c1"),
                 F.min("value").alias("lo")))
    hist = (running(hist, g, ["c0", "c1"])
            .withColumn("next_lo", F.lead("lo").over(Window.partitionBy(*g).orderBy("bucket")))
            .drop("c0", "c1", "lo"))
    w = Window.partitionBy(*g, "bucket").orderBy("value")
    rows = w.rowsBetween(Window.unboundedPreceding, 0)
    s0 = F.sum(F.when(F.col("side") == 0, 1).otherwise(0)).over(rows) + F.col("c0_before")
    s1 = F.sum(F.when(F.col("side") == 1, 1).otherwise(0)).over(rows) + F.col("c1_before")
    nxt = F.coalesce(F.lead("value").over(w), F.col("next_lo"), F.col("value"))
    n0, n1 = (F.nullif(F.col(c), F.lit(0)) for c in ("c0_all", "c1_all"))
    part = F.abs(s0 / n0 - s1 / n1) * (nxt - F.col("value"))
    return (long.join(hist, [*g, "bucket"]).select(*g, part.alias("part"))
            .groupBy(*g).agg(F.sum("part").alias("w1")))


def order_stats(long: DataFrame, group: Sequence[str]) -> DataFrame:
    """Every order statistic with its 0-based rank ``k`` and its successor."""
    g = [*group, "side"]
    hist = long.groupBy(*g, "bucket").agg(F.count("*").alias("n"), F.min("value").alias("lo"))
    hist = (running(hist, g, ["n"])
            .withColumn("next_lo", F.lead("lo").over(Window.partitionBy(*g).orderBy("bucket")))
            .drop("n", "lo"))
    both = Window.partitionBy(*group)
    for s in (0, 1):
        hist = hist.withColumn(f"n{s}", F.max(F.when(F.col("side") == s, F.col("n_all"))).over(both))
    w = Window.partitionBy(*g, "bucket").orderBy("value")
    # the rows must not be sent to every task: Spark takes them for few, as a
    # table that is small on disk is multiplied by directions and permutations
    return (long.join(hist.hint("merge"), [*g, "bucket"])
            .select(*g, (F.row_number().over(w) - 1 + F.col("n_before")).alias("k"),
                    F.col("value").alias("x"),
                    F.coalesce(F.lead("value").over(w), F.col("next_lo"), F.col("value")).alias("x1"),
                    F.col("n_all").alias("n"), "n0", "n1"))


def _at_levels(stats: DataFrame, group: Sequence[str], d: Column, first: int) -> DataFrame:
    """Interpolated quantile of each side at the levels i/d, i = first..d.

    Whole numbers only: level i of a sample of size n lies at position
    (n-1)*i/d, so the levels between two order statistics are a range of i.
    Products of two row counts are decimals: they may pass 64 bits. A range of
    more than LEVELS is cut into parts that are spread before they are listed,
    so that one value of a small sample makes neither a long array nor a
    long task.
    """
    k, m = F.col("k"), F.col("n") - 1
    stats = stats.withColumn("d", d)

    def up(rank):  # ceil(rank * d / (n - 1))
        return F.expr(f"CASE WHEN n = 1 THEN 0L ELSE (cast({rank} AS decimal(19, 0)) * cast(d AS decimal(18, 0)) + n - 2) "
                      "DIV greatest(n - 1, 1L) END")

    low = F.greatest(up("k"), F.lit(first))
    high = F.when(k == m, F.col("d")).otherwise(up("(k + 1)") - 1)
    ranges = stats.withColumn("low", low).withColumn("high", high).where("low <= high")
    wide = ranges.where(F.col("high") - F.col("low") >= LEVELS)
    wide = (wide.withColumn("low", F.explode(F.sequence("low", "high", F.lit(LEVELS).cast("long"))))
            .withColumn("high", F.least("high", F.col("low") + LEVELS - 1)).repartition(*group, "side", "low"))
    ranges = ranges.where(F.col("high") - F.col("low") < LEVELS).unionByName(wide)
    past = F.expr("cast(cast(n - 1 AS decimal(19, 0)) * cast(i AS decimal(18, 0)) "
                  "- cast(k AS decimal(19, 0)) * cast(d AS decimal(18, 0)) AS double)")
    return (ranges.select(*group, "side", "n0", "n1", "x", "x1", "k", "n", "d",
                          F.explode(F.sequence("low", "high")).alias("i"))
            .select(*group, "side", "n0", "n1", "i",
                    (F.col("x") + (F.col("x1") - F.col("x")) * (past / F.col("d"))).alias("q")))


def _mean_gap(levels: DataFrame, group: Sequence[str], key: Sequence[str]) -> DataFrame:
    on = [*group, *key]
    a = levels.where("side = 0").select(*on, F.col("q").alias("q0"))
    b = levels.where("side = 1").select(*on, F.col("q").alias("q1"))
    return a.join(b.hint("merge"), on).groupBy(*group).agg(F.avg(F.abs(F.col("q0") - F.col("q1"))).alias("w1"))


def w1_interp(long: DataFrame, group: Sequence[str]) -> DataFrame:
    """Mean gap of the two quantile functions on a grid of max(n, m) points."""
    stats = order_stats(long, group)
    grid = F.greatest("n0", "n1") - 1
    # two one-row samples have no grid step: level 0 of 1 serves
    return _mean_gap(_at_levels(stats, group, F.greatest(grid, F.lit(1)), 0)
                     .where((F.greatest("n0", "n1") > 1) | (F.col("i") == 0)), group, ["i"])


def w1_union(long: DataFrame, group: Sequence[str]) -> DataFrame:
    """Plain mean gap over the distinct levels i/n and j/m."""
    stats = order_stats(long, group)
    own = _at_levels(stats, group, F.col("n0"), 1).withColumn("kind", F.lit(0))
    other = (_at_levels(stats, group, F.col("n1"), 1).withColumn("kind", F.lit(1))
             # j/m equals some i/n: that level is already there
             .where("(cast(i AS decimal(19, 0)) * cast(n0 AS decimal(18, 0))) % n1 <> 0"))
    return _mean_gap(own.unionByName(other), group, ["kind", "i"])


W1_METHODS = {"exact": w1_exact, "sorted": w1_exact, "interp": w1_interp, "quantile_union": w1_union}


def w1_of(method: str):
    if method not in W1_METHODS:
        raise ValueError(f"unknown method {method!r}")
    return W1_METHODS[method]


def _gap_levels(method: str, n0: int, n1: int) -> Iterator[tuple[np.ndarray, int]]:
    """Levels (i, d) for i/d of the quantile methods, up to LEVELS_AT_ONCE at a time."""
    grid = max(n0, n1) - 1
    for first, d, other in ((1, n0, None), (1, n1, n0)) if method == "quantile_union" else ((0, grid, None),):
        for start in range(first, d + 1, LEVELS_AT_ONCE):
            i = np.arange(start, min(d + 1, start + LEVELS_AT_ONCE), dtype=np.int64)
            # i/n1 equals some level of the other size: that one is already there
            yield (i if other is None else i[i * other % d != 0]), max(d, 1)


def sorted_gap(method: str, n0: int, n1: int) -> Callable[[np.ndarray, np.ndarray], float | None] | None:
    """:func:`w1_of` for two sorted arrays of ``n0`` and ``n1`` values; None
    where it has no row, as one side is empty. Where the levels lie is found
    once for all arrays of these sizes."""
    if w1_of(method) is w1_exact:
        def area(v0: np.ndarray, v1: np.ndarray) -> float | None:
            if not n0 or not n1:
                return None
            v = np.sort(np.concatenate([v0, v1]))
            share = [np.searchsorted(x, v[:-1], side="right") / len(x) for x in (v0, v1)]
            with np.errstate(all="ignore"):
                return float(np.sum(np.abs(share[0] - share[1]) * np.diff(v)))

        return area
    if not n0 or not n1:
        return None
    places = []
    for i, d in _gap_levels(method, n0, n1):
        at = []
        for n in (n0, n1):
            k, past = np.divmod((n - 1) * i, d)
            whole = len(k) and k[-1] - k[0] == len(k) - 1 and (np.diff(k) == 1).all()
            # the levels of a size take its values one after the other
            at += [slice(int(k[0]), int(k[-1]) + 1), slice(int(k[0]) + 1, int(k[-1]) + 2)] if whole else [k, k + 1]
            at.append(past / d)
        places.append(at)
    levels = sum(len(at[2]) for at in places)

    def gap(v0: np.ndarray, v1: np.ndarray) -> float:
        v0, v1 = (np.append(v, v[-1]) for v in (v0, v1))
        total = 0.0
        with np.errstate(all="ignore"):
            for k0, l0, f0, k1, l1, f1 in places:
                x, y, p, q = v0[k0], v1[k1], v0[l0] - v0[k0], v1[l1] - v1[k1]
                p *= f0
                p += x
                q *= f1
                q += y
                p -= q
                total += float(np.abs(p, out=p).sum())
        return total / levels

    return gap


def keyed_sides(ref: DataFrame, det: DataFrame, features: Sequence[str], key: Sequence[str],
                seed: int) -> DataFrame:
    """Both sides, complete rows only, with two hash numbers ``_a``, ``_b``."""
    both = stack_sides(ref, det, [*key, *features]).dropna(subset=list(features))
    a, b = perm_parts(["side", *key], seed)
    return both.withColumns({"_a": a, "_b": b})


def w1_features(ref: DataFrame, det: DataFrame, features: Sequence[str], key: Sequence[str],
                method: str = "exact", seed: int = 42, n_buckets: int = 64) -> DataFrame:
    """W1 per feature: ``(feature, w1)``."""
    both = keyed_sides(ref, det, features, key, seed)
    if method == "sorted":
        both = equal_sizes(both, ["side", *key], seed)
    both = both.select("side", "_a", *dict.fromkeys(features))
    n = both.count()
    cuts = fit_cuts(both, features, n_buckets, n)
    long = subdivided(to_long(spread(both, "_a"), features, cuts, ["side"], salt="_a"), n, n_buckets)
    return w1_of(method)(long, ["feature_id"]).select(feature_name(features).alias("feature"), "w1")


def _gathered(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    """Batches put together up to PACK_CELLS values."""
    held, n = [], 0
    for pdf in batches:
        held.append(pdf)
        n += len(pdf)
        if n * width >= PACK_CELLS:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if n:
        yield pd.concat(held, ignore_index=True)


def packed(z: DataFrame, features: Sequence[str], dirs: np.ndarray, cuts: Sequence[Sequence[float]], by: Sequence[str] = (),
           opened: dict[tuple[int, int], tuple[float, float, int]] | None = None, values: bool = True,
           tags: Callable[[pd.DataFrame], np.ndarray] | None = None) -> DataFrame:
    """Values along all directions, many to a row: ``(by, feature_id, bucket,
    side, n, lo, hi, values)``, one row per batch of rows, direction, bucket
    and side. ``values`` holds the n doubles, or one where all are equal.

    A long table has a row for every value, and most of the time goes into
    making, moving and sorting such rows. ``by`` is at most one whole number.
    ``opened`` gives (lo, hi, spans) of the buckets that are cut further. With
    ``tags``, bytes of a fixed length per row, both sides share a row (``side``
    0), equal values are kept, ``tags`` has theirs, and those of a hot value
    are spread over SALTS buckets by ``_a``.
    """
    by, features = list(by), list(features)
    edges = [np.asarray(c, dtype=float) for c in cuts]
    hot = [np.isin(np.append(-math.inf, c), hot_values(c)) for c in cuts]
    ends: list = [None] * len(dirs)
    for g in range(len(dirs) if opened else 0):
        found = [opened.get((g, b), (0.0, 0.0, 1)) for b in range(len(edges[g]) + 1)]
        ends[g] = [np.array(x, dtype=float) for x in zip(*found)]

    def pack(batches):
        for pdf in _gathered(batches, len(dirs)):
            xs = [pdf[c].to_numpy(dtype=float) for c in features]
            group = pdf[by[0]].to_numpy(dtype=np.int64) if by else np.zeros(len(pdf), dtype=np.int64)
            groups, code = np.unique(group, return_inverse=True)
            marks = tags(pdf) if tags else None
            side = np.zeros(len(pdf), dtype=np.int64) if tags else pdf["side"].to_numpy(dtype=np.int64)
            salt = pdf["_a"].to_numpy(dtype=np.int64) % SALTS if tags else None
            for g, d in enumerate(dirs):
                v = reduce(lambda a, b: a + b, [x * w for x, w in zip(xs, d)])
                at = np.searchsorted(edges[g], v, side="right")
                if ends[g] is not None:
                    lo, hi, spans = (e[at] for e in ends[g])
                    with np.errstate(all="ignore"):
                        part = np.where(spans > 1, np.minimum(np.floor((v - lo) / (hi - lo) * spans), spans - 1), 0)
                    bucket = at * MOST_SPANS + np.nan_to_num(part).astype(np.int64)
                else:
                    bucket = at
                width = int(bucket.max()) + 1
                cell = code * width + bucket
                if tags:
                    cell = cell * SALTS + np.where(hot[g][at], salt, 0)
                cell = cell * 2 + side
                # short whole numbers are sorted by their digits
                order = np.argsort(cell.astype(np.uint16) if cell.max() < 2**16 else cell, kind="stable")
                order = order[~np.isnan(v[order])]
                if not len(order):
                    continue
                v, cell = v[order], cell[order]
                first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
                last = np.append(first[1:], len(v))
                lo, hi = np.minimum.reduceat(v, first), np.maximum.reduceat(v, first)
                held = cell[first]
                rest = held // 2
                place = rest % (width * SALTS if tags else width)
                out = pd.DataFrame({
                    **({by[0]: groups[rest // width]} if by else {}),
                    "feature_id": np.int32(g), "bucket": place, "side": (held % 2).astype(np.int32),
                    "n": last - first, "lo": lo, "hi": hi})
                if values:
                    out["values"] = [v[a:(b if tags or x != y else a + 1)].tobytes() for a, b, x, y in zip(first, last, lo, hi)]
                if tags:
                    m = marks[order]
                    out["tags"] = [m[a:b].tobytes() for a, b in zip(first, last)]
                yield out

    needed = dict.fromkeys([*by, "side", *features, *(("_a", "_b") if tags else ())])
    schema = "".join(f"{c} long, " for c in by) + "feature_id int, bucket long, side int, n long, lo double, hi double"
    return z.select(*needed).mapInPandas(pack, schema + ", values binary" * values + ", tags binary" * bool(tags))


def open_buckets(z: DataFrame, features: Sequence[str], dirs: np.ndarray, cuts: Sequence[Sequence[float]], n: int,
                 most: int) -> dict[tuple[int, int], tuple[float, float, int]] | None:
    """Spans for the buckets of a table of ``n`` rows that hold more than
    ``most`` values; what is collected is one row per bucket, as many as
    arguments say. Nothing is read where the buckets hold few rows each."""
    if n <= (min(map(len, cuts)) + 1) * most:
        return None
    hist = (packed(z, features, dirs, cuts, values=False).groupBy("feature_id", "bucket")
            .agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect())
    return {(r["feature_id"], r["bucket"]): (r["lo"], r["hi"], min(-(-r["n"] // most), MOST_SPANS - 1)) for r in hist
            if r["n"] > most and r["lo"] < r["hi"] and math.isfinite(r["lo"]) and math.isfinite(r["hi"] - r["lo"])}


def w1_packed(z: DataFrame, features: Sequence[str], dirs: np.ndarray, cuts: Sequence[Sequence[float]], n: int,
              by: Sequence[str] = ()) -> DataFrame:
    """:func:`w1_exact` of every direction (and group) from packed values:
    ``(by, feature_id, w1)``."""
    g, key = [*by, "feature_id"], [*by, "feature_id", "bucket"]
    opened = open_buckets(z, features, dirs, cuts, n, MOST_ROWS)
    hist = (packed(z, features, dirs, cuts, by, opened, values=False).groupBy(*key)
            .agg(F.sum(F.when(F.col("side") == 0, F.col("n")).otherwise(0)).alias("c0"),
                 F.sum(F.when(F.col("side") == 1, F.col("n")).otherwise(0)).alias("c1"), F.min("lo").alias("first")))
    hist = (running(hist, g, ["c0", "c1"])
            .withColumn("next_lo", F.lead("first").over(Window.partitionBy(*g).orderBy("bucket")))
            .drop("c0", "c1", "first"))

    def area(pdf: pd.DataFrame) -> pd.DataFrame:
        o = pdf.iloc[0]
        out = {c: [o[c]] for c in g}
        if not o["c0_all"] or not o["c1_all"]:
            return pd.DataFrame({**out, "part": pd.Series([None], dtype=object), "nan": [False]})
        parts = [np.frombuffer(x) for x in pdf["values"]]
        v = np.concatenate(parts)
        times = np.concatenate([np.full(len(x), n / len(x)) for x, n in zip(parts, pdf["n"])])
        zero = np.repeat(pdf["side"].to_numpy() == 0, [len(x) for x in parts])
        order = np.argsort(v)
        v, times, zero = v[order], times[order], zero[order]
        s0 = o["c0_before"] + np.cumsum(np.where(zero, times, 0.0))
        s1 = o["c1_before"] + np.cumsum(np.where(zero, 0.0, times))
        with np.errstate(all="ignore"):
            step = np.diff(v, append=v[-1] if pd.isna(o["next_lo"]) else o["next_lo"])
            part = float(np.sum(np.abs(s0 / o["c0_all"] - s1 / o["c1_all"]) * step))
        return pd.DataFrame({**out, "part": [part], "nan": [math.isnan(part)]})

    rows = packed(z, features, dirs, cuts, by, opened).drop("lo", "hi").join(hist.hint("merge"), key)
    parts = rows.groupBy(*key).applyInPandas(
        area, "".join(f"{c} long, " for c in by) + "feature_id int, part double, nan boolean")
    part = F.when(F.col("nan"), F.lit(math.nan)).otherwise(F.col("part"))
    return parts.groupBy(*g).agg(F.sum(part).alias("w1"))


def _edges(cuts: Sequence[float], spans: int) -> np.ndarray:
    """Cut points with ``spans`` equal parts between each and the next."""
    q = np.asarray(cuts, dtype=float)
    inner = q[:-1, None] + (q[1:] - q[:-1])[:, None] * (np.arange(spans) / spans)
    return np.unique(np.append(inner.ravel(), q))


def w1_neighbours(rows: DataFrame, features: Sequence[str], dirs: np.ndarray, cuts: Sequence[Sequence[float]],
                  moments: Sequence[tuple[np.ndarray, np.ndarray]], spans: int) -> DataFrame:
    """Exact W1 of each window ``_w`` = 0, 1, .. (side 1) against the one before
    it (side 0) along every direction, in z-scores of the latter, whose (mean,
    deviation) are in ``moments``: ``(_w, feature_id, w1)``.

    The cells between the cut points, each in ``spans`` parts, are counted, and
    their values added up. Where the CDF of one side is not below that of the other from
    end to end of a cell, its area follows from counts and sums; only the rows
    of the other cells are moved and sorted. That one side is above the other
    shows where a cell holds fewer rows than the CDFs are apart.
    """
    features, last = list(features), len(moments) - 1
    edges = [_edges(c, spans) for c in cuts]

    def sides(pdf: pd.DataFrame) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(_w, feature_id, side, sorted values)"""
        window = pdf["_w"].to_numpy(dtype=np.int64)
        order = np.argsort(window, kind="stable")
        window, xs = window[order], [pdf[c].to_numpy(dtype=float)[order] for c in features]
        first = np.flatnonzero(np.append(True, window[1:] != window[:-1]))
        for a, b in zip(first, np.append(first[1:], len(window))):
            for w, side in ((window[a], 1), (window[a] + 1, 0)):
                if 1 <= w <= last:
                    mean, std = moments[w - 1]
                    with np.errstate(all="ignore"):
                        z = [(x[a:b] - m) / s for x, m, s in zip(xs, mean, std)]
                        for g, d in enumerate(dirs):
                            v = np.sort(reduce(lambda s, t: s + t, [x * t for x, t in zip(z, d)]))
                            yield int(w), g, side, v[:len(v) - int(np.isnan(v).sum())]

    def count(batches):
        n: dict = {}
        total: dict = {}
        for pdf in _gathered(batches, len(features)):
            for w, g, side, v in sides(pdf):
                at = np.concatenate([[0], np.searchsorted(v, edges[g]), [len(v)]])
                held = np.diff(at)
                if (w, g) not in n:
                    n[w, g], total[w, g] = (np.zeros((2, len(held)), dtype=t) for t in (np.int64, float))
                full = np.flatnonzero(held)
                n[w, g][side] += held
                if len(full):
                    with np.errstate(all="ignore"):
                        total[w, g][side][full] += np.add.reduceat(v, at[:-1][full])
        for w, g in n:
            parts = [i for i in range(0, n[w, g].shape[1], CELLS_AT_ONCE) if n[w, g][:, i:i + CELLS_AT_ONCE].any()]
            if parts:
                yield pd.DataFrame({"_w": w, "feature_id": np.int32(g), "part": np.array(parts, dtype=np.int64),
                                    **{name: [x[w, g][:, i:i + CELLS_AT_ONCE].tobytes() for i in parts] for name, x in (("n", n), ("total", total))}})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf.iloc[:1][["_w", "feature_id", "part"]]
        n, total = (np.sum([np.frombuffer(x, dtype=t) for x in pdf[c]], axis=0, dtype=t) for c, t in (("n", np.int64), ("total", float)))
        return out.assign(n=[n.tobytes()], total=[total.tobytes()])

    def settled(pdf: pd.DataFrame) -> pd.DataFrame:
        """The area of the cells that need no rows (``chunk`` -1), and the other
        cells in chunks of about OPEN_VALUES values."""
        w, g = pdf["_w"].iloc[0], pdf["feature_id"].iloc[0]
        e, size = edges[g], len(edges[g]) + 1
        n, total = np.zeros((2, size), dtype=np.int64), np.zeros((2, size))
        for part, x, y in zip(pdf["part"], pdf["n"], pdf["total"]):
            for whole, held in ((n, np.frombuffer(x, dtype=np.int64)), (total, np.frombuffer(y, dtype=float))):
                whole[:, part:part + CELLS_AT_ONCE] = held.reshape(2, -1)
        every = n.sum(axis=1)
        out = {"_w": w, "feature_id": g}
        if not every.all():
            return pd.DataFrame({**out, "chunk": [-1], "area": pd.Series([None], dtype=object), "cells": [b""], "before": [b""], "every": [b""]})
        after = n.cumsum(axis=1)
        before = after - n
        lo, hi = before / every[:, None], after / every[:, None]
        apart = (lo[0] >= hi[1]) | (lo[1] >= hi[0])
        low, high = np.append(e[0], e), np.append(e, e[-1])
        width = high - low
        # as wide as two numbers are apart: all its values are equal
        apart[1:-1] |= (width <= 2 * np.spacing(np.maximum(np.abs(low), np.abs(high))))[1:-1]
        apart[[0, -1]] = False
        with np.errstate(all="ignore"):
            filled = lo * width + (n * high - total) / every[:, None]
        area = float(np.abs(filled[0] - filled[1])[apart].sum())
        open_ = np.flatnonzero(~apart & n.any(axis=0))
        held = n[:, open_].sum(axis=0)
        chunk = (held.cumsum() - held) // OPEN_VALUES
        split = np.flatnonzero(np.diff(chunk)) + 1
        cells = np.split(open_, split) if len(open_) else []
        return pd.DataFrame({**out, "chunk": np.arange(-1, len(cells)), "area": [area, *[None] * len(cells)],
                             "cells": [b"", *(c.tobytes() for c in cells)], "before": [b"", *(before[:, c].tobytes() for c in cells)],
                             "every": every.tobytes()})

    key, spark = ["_w", "feature_id"], rows.sparkSession
    counted = rows.mapInPandas(count, "_w long, feature_id int, part long, n binary, total binary")
    counted = counted.groupBy(*key, "part").applyInPandas(added, counted.schema)
    path = new_path(spark, "cells")
    counted.groupBy(*key).applyInPandas(
        settled, "_w long, feature_id int, chunk long, area double, cells binary, before binary, every binary").write.parquet(path)
    found = spark.read.parquet(path)
    # as many as arguments say: MOST_CELLS at most
    wanted: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
    for r in found.where("chunk >= 0").select(*key, "chunk", "cells").collect():
        wanted.setdefault((r["_w"], r["feature_id"]), []).append((r["chunk"], np.frombuffer(bytes(r["cells"]), dtype=np.int64)))
    done = found.where("chunk < 0").select(*key, "area", F.lit(False).alias("nan"))
    if not wanted:
        return done.select(*key, F.col("area").alias("w1"))

    def values(batches):
        for pdf in _gathered(batches, len(features)):
            out = []
            for w, g, side, v in sides(pdf):
                ends = np.concatenate([[-math.inf], edges[g], [math.inf]])
                for chunk, cells in wanted.get((w, g), ()):
                    a, b = np.searchsorted(v, ends[cells]), np.searchsorted(v, ends[cells + 1])
                    if cells[-1] == len(edges[g]):  # nothing is above the last one
                        b[-1] = len(v)
                    held = np.concatenate([v[i:j] for i, j in zip(a, b) if i < j]) if (a < b).any() else v[:0]
                    if len(held):
                        first = np.flatnonzero(np.append(True, held[1:] != held[:-1]))
                        times = np.diff(np.append(first, len(held)))
                        out.append((w, g, chunk, side, held[first].tobytes(), times.astype(np.int64).tobytes()))
            if out:
                yield pd.DataFrame(out, columns=["_w", "feature_id", "chunk", "side", "values", "times"])

    def area(held: pd.DataFrame, places: pd.DataFrame) -> pd.DataFrame:
        if held.empty or places.empty:
            return pd.DataFrame({"_w": pd.Series([], dtype="int64"), "feature_id": pd.Series([], dtype="int32"),
                                 "area": pd.Series([], dtype=float), "nan": pd.Series([], dtype=bool)})
        w, g = held["_w"].iloc[0], held["feature_id"].iloc[0]
        e, o = edges[g], places.iloc[0]
        cells, every = (np.frombuffer(o[c], dtype=np.int64) for c in ("cells", "every"))
        before = np.frombuffer(o["before"], dtype=np.int64).reshape(2, -1)
        v = np.concatenate([np.frombuffer(x) for x in held["values"]])
        times = [np.frombuffer(x, dtype=np.int64) for x in held["times"]]
        zero = np.repeat(held["side"].to_numpy() == 0, [len(x) for x in times])
        order = np.argsort(v, kind="stable")
        v, times, zero = v[order], np.concatenate(times)[order], zero[order]
        cell = np.searchsorted(e, v, side="right")
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        at = np.searchsorted(cells, cell[first])
        length = np.diff(np.append(first, len(v)))
        low, high = np.append(v[0], e)[cell[first]], np.append(e, v[-1])[cell[first]]
        share = []
        for side, own in enumerate((zero, ~zero)):
            run = np.cumsum(np.where(own, times, 0))
            base = before[side][at] - (run - np.where(own, times, 0))[first]
            share.append((run + np.repeat(base, length)) / every[side])
        start = np.abs(before[0][at] / every[0] - before[1][at] / every[1])
        with np.errstate(all="ignore"):
            to = np.append(v[1:], v[-1])
            to[np.append(first[1:], len(v)) - 1] = high
            part = float(np.sum(np.abs(share[0] - share[1]) * (to - v)) + np.sum(start * (v[first] - low)))
        return pd.DataFrame({"_w": [w], "feature_id": [g], "area": [part], "nan": [math.isnan(part)]})

    moved = rows.mapInPandas(values, "_w long, feature_id int, chunk long, side int, values binary, times binary")
    places = found.where("chunk >= 0").drop("area")
    parts = (moved.groupBy(*key, "chunk").cogroup(places.groupBy(*key, "chunk"))
             .applyInPandas(area, "_w long, feature_id int, area double, nan boolean"))
    part = F.when(F.col("nan"), F.lit(math.nan)).otherwise(F.col("area"))
    return done.unionByName(parts).groupBy(*key).agg(F.sum(part).alias("w1"))


def sort_buckets(n: int, n_dirs: int, least: int) -> int:
    """Buckets of a direction for ``n`` rows, ``least`` unless these would be
    nearly empty: the sorts stay small, the cut points within MAX_CUTS."""
    return max(min(least, n // FEW_ROWS + 1), min(MAX_CUTS // n_dirs, n // ROWS_PER_SORT))


class Projected:
    """Both sides in z-scores (``z``) and along every direction (``wide``,
    columns ``names``), with the row counts ``n`` of the sides."""

    def __init__(self, ref: DataFrame, det: DataFrame, features: Sequence[str], key: Sequence[str],
                 dirs: np.ndarray, seed: int, standardize: str, method: str):
        self.keep, self.features, self.dirs = ["side", "_a", "_b"], list(features), dirs
        both = keyed_sides(ref, det, features, key, seed)
        moments = side_moments(both, features)
        self.n = [moments.get(s, {"n": 0})["n"] for s in (0, 1)]
        if method == "sorted":  # after the moments, which are those of all rows
            both, self.n = equal_sizes(both, ["side", *key], seed), [min(self.n)] * 2
        self.z = standardized(both, features, standardize, self.keep, moments)
        # every row is about to become one row, or value, per direction
        self.even = spread(self.z, "_a", n=sum(self.n))
        self.wide, self.names = project(self.even, features, dirs, self.keep)

    def cuts(self, n_buckets: int) -> dict[str, list[float]]:
        """Cut points per direction, from a sample taken before any shuffle."""
        n = sum(self.n)
        rows = min(n, max(CUT_SAMPLE_ROWS, 20 * n_buckets))
        few = by_value(self.z, ["_a", "_b"], n, rows)
        return fit_cuts(project(few, self.features, self.dirs, [])[0], self.names, n_buckets, rows)

    def long(self, cuts: dict[str, list[float]], most: int | None = None) -> DataFrame:
        long = to_long(self.wide, self.names, cuts, self.keep, salt="_a").withColumn("bucket", F.col("bucket").cast("long"))
        return subdivided(long, sum(self.n), min(map(len, cuts.values())) + 1, most=most)


def swd_directions(ref: DataFrame, det: DataFrame, features: Sequence[str], key: Sequence[str],
                   n_projections: int = 50, seed: int = 42, standardize: str = "reference",
                   method: str = "exact", n_buckets: int = 64) -> DataFrame:
    """W1 of every direction: ``(proj, w1)``."""
    dirs = directions(n_projections, len(features), seed)
    p = Projected(ref, det, features, key, dirs, seed, standardize, method)
    if w1_of(method) is w1_exact:
        cuts = p.cuts(sort_buckets(sum(p.n), n_projections, n_buckets))
        w1 = w1_packed(p.even.select("side", *p.features), p.features, dirs, [cuts[c] for c in p.names], sum(p.n))
        return w1.withColumnRenamed("feature_id", "proj")
    long = p.long(p.cuts(n_buckets)).drop("_a", "_b")
    return w1_of(method)(long, ["feature_id"]).withColumnRenamed("feature_id", "proj")


def swd(ref: DataFrame, det: DataFrame, features: Sequence[str], key: Sequence[str], **kw) -> DataFrame:
    """Sliced Wasserstein distance: one row ``swd``."""
    return swd_directions(ref, det, features, key, **kw).agg(F.avg("w1").alias("swd"))


def swd_diagnostics(ref: DataFrame, det: DataFrame, features: Sequence[str], key: Sequence[str],
                    n_projections: int = 20, **kw) -> DataFrame:
    """Sizes, rows that differ by key, largest gap of a cell, W1 of the first
    direction, mean and deviation over all directions."""
    both = stack_sides(ref, det, [*key, *features]).dropna(subset=list(features))
    pairs = both.groupBy(*key).agg(
        F.sum(F.when(F.col("side") == 0, 1).otherwise(0)).alias("in_ref"),
        F.sum(F.when(F.col("side") == 1, 1).otherwise(0)).alias("in_det"),
        F.greatest(*[F.max(F.when(F.col("side") == 0, F.col(c))) - F.min(F.when(F.col("side") == 1, F.col(c)))
                     for c in features],
                   *[F.max(F.when(F.col("side") == 1, F.col(c))) - F.min(F.when(F.col("side") == 0, F.col(c)))
                     for c in features]).alias("gap"))
    sizes = pairs.agg(F.sum("in_ref").alias("n_ref"), F.sum("in_det").alias("n_det"),
                      F.coalesce(F.bool_and((F.col("in_ref") == F.col("in_det")) & (F.col("gap") == 0)),
                                 F.lit(True)).alias("identical"),
                      F.max(F.col("gap").cast("double")).alias("max_abs_diff"))
    dist = swd_directions(ref, det, features, key, n_projections, **kw).agg(
        F.max(F.when(F.col("proj") == 0, F.col("w1"))).alias("w1_first"),
        F.avg("w1").alias("w1_mean"), F.stddev_pop("w1").alias("w1_std")).first()
    return sizes.select("*", *[F.lit(dist[c]).cast("double").alias(c) for c in dist.asDict()])
