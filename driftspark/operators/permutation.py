"""Permutation test of the sliced Wasserstein distance.

The rows are projected once. A permutation is a relabelling of the pooled
rows, and its labels follow from two hash numbers kept with every row, so the
whole null distribution is computed from one shuffle of rows x directions: no
copy of the rows per permutation, no loop of jobs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftspark.functions.hashing import PERM_BITS, PERM_PRIME, perm_hash
from driftspark.operators.wasserstein import MAX_CUTS, Projected, directions, open_buckets, packed, sorted_gap, w1_of
from driftspark.plans.buckets import NULL_BUCKET, order_statistics, tile_by_cuts
from driftspark.plans.workdir import new_path, remove

# Label cells (rows x permutations) worked on at a time: bounds a task's memory.
LABEL_CELLS = 4_000_000
# Bytes of two hash numbers and a side.
HASHES = 17
# Deviations around its expected place within which a label border is ranked.
BAND = 8
# Permutations counted in one expression.
PERMS_AT_ONCE = 50
# Rows of one direction that a task sorts at a time: wished for, and at most.
ROWS_PER_BUCKET, MOST_ROWS = 4096, 262_144
# Directions drawn anew: rows that a task may hold, tasks for every core, and
# values (rows x permutations x directions) of a wave where there are more rows.
TASK_ROWS, TASKS_PER_CORE, WAVE_VALUES = 8_000_000, 4, 100_000_000


def permutation_cuts(keyed: DataFrame, perms: Sequence[int], n_first: int) -> dict[int, int]:
    """Per permutation, the hash key of its ``n_first``-th row."""
    if n_first <= 0:
        return {p: -1 for p in perms}
    n = keyed.count()
    n_first = min(n, n_first)
    # The hash is uniform, so the border lies close to its expected place: rows
    # below the band are counted where they are, and only the band is ranked.
    share = n_first / max(1, n)
    wide = int(PERM_PRIME * (BAND * math.sqrt(share * (1 - share) / max(1, n)) + 2 / max(1, n)))
    lo, hi = max(0, int(PERM_PRIME * share) - wide), min(PERM_PRIME, int(PERM_PRIME * share) + wide)
    below, perms = {}, list(perms)
    for i in range(0, len(perms), PERMS_AT_ONCE):
        part = perms[i:i + PERMS_AT_ONCE]
        row = keyed.agg(*[F.count_if(perm_hash(F.col("_a"), F.col("_b"), F.lit(p)) < lo).alias(f"p{p}") for p in part]).first()
        below |= {p: row[f"p{p}"] for p in part}
    hashes = F.transform(F.array(*[F.lit(p) for p in perms]),
                         lambda p: F.struct(p.alias("p"), perm_hash(F.col("_a"), F.col("_b"), p).alias("v")))
    band = (keyed.select(F.explode(F.filter(hashes, lambda x: (x["v"] >= lo) & (x["v"] < hi))).alias("_x"))
            .select(F.col("_x.p").alias("feature_id"), F.col("_x.v").alias("value"))
            .withColumn("bucket", F.expr(f"cast((value - {lo}) div {max(1, (hi - lo) // 128)} AS int)")))
    found, totals = order_statistics(band, lambda p, m: [r for r in [n_first - below[p]] if 0 < r <= m])
    out = {p: v for (p, _), v in found.items()}
    for p in (p for p in perms if p not in out):  # beyond the band: rank all rows of this permutation
        every = (keyed.select(F.lit(p).alias("feature_id"), perm_hash(F.col("_a"), F.col("_b"), F.lit(p)).alias("value"))
                 .withColumn("bucket", F.shiftright("value", PERM_BITS - 12).cast("int")))
        out[p] = order_statistics(every, lambda _, m: [min(m, n_first)])[0][p, n_first]
    return out


def _cuts(keyed: DataFrame, n_permutations: int, n0: int, n1: int, split: str) -> list[int]:
    perms = list(range(1, n_permutations + 1))
    if split == "hash":
        return [int(PERM_PRIME * n0 / (n0 + n1)) - 1] * n_permutations
    if split != "exact":
        raise ValueError(f"unknown split {split!r}")
    cuts = permutation_cuts(keyed, perms, n0)
    return [cuts[p] for p in perms]


def _labels(pdf: pd.DataFrame, cuts: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Is the row on side 0, for permutations lo..hi-1 (0 is the real side)."""
    perms = np.arange(lo, hi, dtype=np.int64)
    h = (pdf["_a"].to_numpy()[:, None] * (perms + 1) + pdf["_b"].to_numpy()[:, None]) % PERM_PRIME
    out = h <= cuts[lo:hi]
    if lo == 0:
        out[:, 0] = pdf["side"].to_numpy() == 0
    return out


def _tags(border: np.ndarray):
    """(bytes of a row, their labels): the labels as bits, found once a row for
    all directions, or where these are more bytes the hash numbers and the side."""
    n_perm = len(border)
    if n_perm <= 8 * HASHES:
        def write(pdf: pd.DataFrame) -> np.ndarray:
            return np.concatenate([np.packbits(_labels(pdf, border, i, min(i + 8, n_perm)), axis=1) for i in range(0, n_perm, 8)], axis=1)

        def read(tags: np.ndarray, lo: int, hi: int) -> np.ndarray:
            first = lo // 8
            return np.unpackbits(tags[:, first:-(-hi // 8)], axis=1)[:, lo - 8 * first:hi - 8 * first]

        return write, read, -(-n_perm // 8)

    def write(pdf: pd.DataFrame) -> np.ndarray:
        numbers = np.ascontiguousarray(pdf[["_a", "_b"]].to_numpy(dtype=np.int64))
        return np.concatenate([numbers.view(np.uint8), pdf[["side"]].to_numpy(dtype=np.uint8)], axis=1)

    def read(tags: np.ndarray, lo: int, hi: int) -> np.ndarray:
        numbers = np.ascontiguousarray(tags[:, :16]).view(np.int64)
        return _labels(pd.DataFrame({"_a": numbers[:, 0], "_b": numbers[:, 1], "side": tags[:, 16]}), border, lo, hi)

    return write, read, HASHES


def _null_by_labels(p: Projected, buckets: dict[str, list[float]], cuts: list[int]) -> DataFrame:
    """(perm, swd) of all relabellings from packed values and labels."""
    n_perm, n_dirs = len(cuts) + 1, len(p.dirs)
    border = np.array([0, *cuts], dtype=np.int64)
    write, read, width = _tags(border)
    edges = [buckets[c] for c in p.names]
    opened = open_buckets(p.even, p.features, p.dirs, edges, sum(p.n), MOST_ROWS)
    rows = packed(p.even, p.features, p.dirs, edges, opened=opened, tags=write)

    def tags_of(pdf: pd.DataFrame) -> np.ndarray:
        return np.frombuffer(b"".join(pdf["tags"]), dtype=np.uint8).reshape(-1, width)

    def spans(rows: int) -> list[tuple[int, int]]:
        step = max(1, LABEL_CELLS // max(1, rows))
        return [(i, min(i + step, n_perm)) for i in range(0, n_perm, step)]

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        tags = tags_of(pdf)
        ones = np.concatenate([read(tags, i, j).sum(axis=0, dtype=np.int64) for i, j in spans(len(tags))])
        return pd.DataFrame({
            "feature_id": [pdf["feature_id"].iloc[0]], "bucket": [pdf["bucket"].iloc[0]],
            "n": [len(tags)], "lo": [pdf["lo"].min()], "hi": [pdf["hi"].max()], "ones": [ones]})

    def offsets(pdf: pd.DataFrame) -> pd.DataFrame:
        # one row per bucket of one direction
        pdf = pdf.sort_values("bucket")
        ones = np.stack(pdf["ones"].to_list())
        n = pdf["n"].to_numpy()
        done, rows = ones.cumsum(axis=0), n.cumsum()
        total, size = done[-1], rows[-1]
        share = np.abs(done / np.maximum(total, 1)
                       - (rows[:, None] - done) / np.maximum(size - total, 1))
        step = np.append(pdf["lo"].to_numpy()[1:] - pdf["hi"].to_numpy()[:-1], 0.0)
        return pd.DataFrame({
            "feature_id": pdf["feature_id"], "bucket": pdf["bucket"],
            "rows_before": rows - n, "size": size,
            "before": list(done - ones), "total": [total] * len(pdf),
            "edge": list(share * step[:, None]),
            "inner": (pdf["lo"] < pdf["hi"]).to_numpy()})

    def inside(held: pd.DataFrame, offs: pd.DataFrame) -> pd.DataFrame:
        if held.empty or offs.empty or not offs["inner"].iloc[0]:
            return pd.DataFrame({"part": pd.Series([], dtype=object)})
        o, v = offs.iloc[0], np.frombuffer(b"".join(held["values"]))
        order = np.argsort(v)
        step, tags = np.diff(v[order]), tags_of(held)[order]
        rank = o["rows_before"] + np.arange(1, len(v))[:, None]
        parts = []
        for i, j in spans(len(v)):
            done = read(tags, i, j).cumsum(axis=0, dtype=np.int64)[:-1] + o["before"][i:j]
            total = o["total"][i:j]
            share = np.abs(done / np.maximum(total, 1)
                           - (rank - done) / np.maximum(o["size"] - total, 1))
            parts.append(step @ share)
        return pd.DataFrame({"part": [np.concatenate(parts)]})

    key = ["feature_id", "bucket"]
    counts = rows.groupBy(*key).applyInPandas(
        count, "feature_id int, bucket long, n long, lo double, hi double, ones array<long>")
    offs = counts.groupBy("feature_id").applyInPandas(
        offsets, "feature_id int, bucket long, rows_before long, size long, before array<long>, "
                 "total array<long>, edge array<double>, inner boolean")
    inner = (rows.groupBy(*key).cogroup(offs.drop("edge").groupBy(*key))
             .applyInPandas(inside, "part array<double>"))
    parts = offs.select(F.col("edge").alias("part")).unionByName(inner)
    return (parts.select(F.posexplode("part").alias("perm", "w"))
            .groupBy("perm").agg((F.sum("w") / n_dirs).alias("swd")))


def _null_by_rows(long: DataFrame, cuts: list[int], method: str) -> DataFrame:
    """Same from one copy of the rows per permutation, for any W1 variant."""
    border = F.element_at(F.array(*[F.lit(c) for c in cuts]), F.greatest(F.col("perm"), F.lit(1)))
    moved = F.when(F.col("perm") == 0, F.col("side")).otherwise(
        F.when(perm_hash(F.col("_a"), F.col("_b"), F.col("perm")) <= border, 0).otherwise(1))
    long = (long.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(len(cuts)))))
            .withColumn("side", moved).drop("_a", "_b"))
    return w1_of(method)(long, ["perm", "feature_id"]).groupBy("perm").agg(F.avg("w1").alias("swd"))


def _fresh_by_pairs(p: Projected, cuts: list[int], seed: int, method: str) -> DataFrame:
    """(perm, feature_id, w1) where every task holds all rows, once, and works
    through its share of the pairs (permutation, direction) one at a time.

    The values of a pair are found where they are sorted, so no value is moved:
    only the rows, packed, as often as there are tasks.
    """
    features, n_dirs, total, read = p.features, len(p.dirs), sum(p.n), len(p.features)
    border = np.array([0, *cuts], dtype=np.int64)
    pairs = len(border) * n_dirs
    tasks = min(pairs, TASKS_PER_CORE * p.z.sparkSession.sparkContext.defaultParallelism)

    def pack(batches):
        for pdf in batches:
            data = b"".join([*(pdf[c].to_numpy(dtype=float).tobytes() for c in features), *(pdf[c].to_numpy(dtype=np.int64).tobytes() for c in ("_a", "_b")),
                             (pdf["side"].to_numpy() == 0).tobytes()])
            yield pd.DataFrame({"n": [len(pdf)], "data": [data]})

    def work(batches):
        xs, (a, b), first, at, mine = np.empty((read, total)), np.empty((2, total), dtype=np.int64), np.empty(total, dtype=bool), 0, []
        for pdf in batches:
            for task, n, data in zip(pdf["task"], pdf["n"], pdf["data"]):
                if task not in mine:
                    mine.append(task)
                if task != mine[0]:  # the same rows once more
                    continue
                whole = np.frombuffer(data, dtype=np.uint8)
                xs[:, at:at + n] = whole[:8 * read * n].view(float).reshape(read, n)
                a[at:at + n], b[at:at + n] = whole[8 * read * n:8 * (read + 2) * n].view(np.int64).reshape(2, n)
                first[at:at + n] = whole[8 * (read + 2) * n:].view(bool)
                at += n
        gaps: dict = {}
        for task in mine:
            todo = range(pairs * task // tasks, pairs * (task + 1) // tasks)
            for perm in range(todo.start // n_dirs, -(-todo.stop // n_dirs)):
                zero = first if perm == 0 else (a * (perm + 1) + b) % PERM_PRIME <= border[perm]
                x0, x1 = xs[:, zero], xs[:, ~zero]
                sizes = x0.shape[1], x1.shape[1]
                if sizes not in gaps:  # those of the last sizes: they serve all directions
                    gaps = {sizes: sorted_gap(method, *sizes)}
                dirs = directions(n_dirs, read, seed + perm)
                lo, hi = max(todo.start - perm * n_dirs, 0), min(todo.stop - perm * n_dirs, n_dirs)
                w1 = [gaps[sizes](*(np.sort(reduce(lambda s, t: s + t, [x * w for x, w in zip(side, dirs[g])])) for side in (x0, x1)))
                      for g in range(lo, hi)] if gaps[sizes] else []
                yield pd.DataFrame({"perm": np.int32(perm), "feature_id": np.arange(lo, lo + len(w1), dtype=np.int32), "w1": pd.Series(w1, dtype=object),
                                    "nan": [v is not None and math.isnan(v) for v in w1]})

    # a batch of rows becomes one row; the tasks are as many as there are cores for
    rows = p.even.select(*features, "_a", "_b", "side").mapInPandas(pack, "n int, data binary")
    copies = rows.select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"), "n", "data")
    out = copies.repartitionById(tasks, F.col("task")).mapInPandas(work, "perm int, feature_id int, w1 double, nan boolean")
    return out.select("perm", "feature_id", F.when(F.col("nan"), F.lit(math.nan)).otherwise(F.col("w1")).alias("w1"))


def _fresh_by_waves(p: Projected, pooled: list[float], cuts: list[int], seed: int, method: str) -> DataFrame:
    """The same from a long table, WAVE_VALUES of it (one pair at least) at a
    time: for more rows than a task may hold."""
    border, features, n_dirs = np.array([0, *cuts], dtype=np.int64), p.features, len(p.dirs)
    spark, path = p.z.sparkSession, new_path(p.z.sparkSession, "fresh")
    kept = new_path(spark, "rows")
    p.even.write.parquet(kept)
    z = spark.read.schema(p.even.schema).parquet(kept)
    step, pairs = max(1, WAVE_VALUES // sum(p.n)), len(border) * n_dirs

    def wave(start: int, stop: int):
        def rows(batches):
            for pdf in batches:
                x = pdf[features].to_numpy()
                for perm in range(start // n_dirs, -(-stop // n_dirs)):
                    lo, hi = max(start - perm * n_dirs, 0), min(stop - perm * n_dirs, n_dirs)
                    v = x @ directions(n_dirs, len(features), seed + perm)[lo:hi].T
                    side = np.where(_labels(pdf, border, perm, perm + 1)[:, 0], 0, 1)
                    yield pd.DataFrame({
                        "perm": np.int32(perm), "feature_id": np.tile(np.arange(lo, hi, dtype=np.int32), len(x)),
                        "side": np.repeat(side.astype(np.int32), hi - lo), "value": v.ravel()})
        return rows

    for start in range(0, pairs, step):
        long = z.mapInPandas(wave(start, min(pairs, start + step)), "perm int, feature_id int, side int, value double")
        long = tile_by_cuts(long, F.col("value"), pooled, "bucket", NULL_BUCKET)
        w1_of(method)(long, ["perm", "feature_id"]).write.mode("append").parquet(path)
    remove(spark, kept)
    return spark.read.schema("perm int, feature_id int, w1 double").parquet(path)


def _null_fresh(p: Projected, n_buckets: int, cuts: list[int], seed: int, method: str) -> DataFrame:
    """New directions for every permutation: rows are projected per permutation."""
    w1_of(method)  # a known one
    if sum(p.n) <= TASK_ROWS:
        w1 = _fresh_by_pairs(p, cuts, seed, method)
    else:
        buckets = p.cuts(n_buckets)
        pooled = sorted({v for c in p.names for v in buckets[c]})[:: max(1, len(p.names))]
        w1 = _fresh_by_waves(p, pooled, cuts, seed, method)
    return w1.groupBy("perm").agg(F.avg("w1").alias("swd"))


def swd_null(ref: DataFrame, det: DataFrame, features: Sequence[str], key: Sequence[str],
             n_projections: int = 50, n_permutations: int = 500, seed: int = 42,
             standardize: str = "reference", method: str = "exact", split: str = "exact",
             fresh: bool = False, n_buckets: int | None = None) -> DataFrame:
    """``(perm, swd)``: perm 0 is the observed distance, 1.. the null values.

    Unless given, ``n_buckets`` follows from the row count: enough rows per
    (direction, bucket) to be worth a task's while, few enough for its memory.
    """
    dirs = directions(n_projections, len(features), seed)
    p = Projected(ref, det, features, key, dirs, seed, standardize, method)
    n0, n1 = p.n
    if not n0 or not n1:
        raise ValueError("both samples need rows without nulls")
    border = _cuts(p.z, n_permutations, n0, n1, split)
    if n_buckets is None:
        n_buckets = max(1, min(4096, MAX_CUTS // n_projections, (n0 + n1) // ROWS_PER_BUCKET))
    if fresh:
        return _null_fresh(p, n_buckets, border, seed, method)
    buckets = p.cuts(n_buckets)
    if method in ("exact", "sorted"):
        return _null_by_labels(p, buckets, border)
    return _null_by_rows(p.long(buckets), border, method)


def swd_report(null: DataFrame, alpha: float = 0.05, pvalue: str = "plus_one") -> DataFrame:
    """One row: observed distance, null mean/std/min/max, z-score, p, drift.

    ``plus_one``: (number of null values above the observed + 1) / (n + 1).
    ``ge_mean``: share of null values not below the observed; may be 0.
    """
    if pvalue not in ("plus_one", "ge_mean"):
        raise ValueError(f"unknown p-value rule {pvalue!r}")
    # one row per permutation
    seen = F.max(F.when(F.col("perm") == 0, F.col("swd"))).over(Window.partitionBy())
    drawn = F.when(F.col("perm") > 0, F.col("swd"))
    n = F.count(drawn)
    above = F.sum(F.when(drawn > F.col("seen"), 1).otherwise(0))
    not_below = F.sum(F.when(drawn >= F.col("seen"), 1).otherwise(0))
    p = (above + 1) / (n + 1) if pvalue == "plus_one" else not_below / n
    return (null.withColumn("seen", seen)
            .agg(F.max("seen").alias("swd"), F.avg(drawn).alias("null_mean"),
                 F.stddev_pop(drawn).alias("null_std"), F.min(drawn).alias("null_min"),
                 F.max(drawn).alias("null_max"), p.alias("p_value"))
            .withColumn("z_score", (F.col("swd") - F.col("null_mean")) / (F.col("null_std") + F.lit(1e-12)))
            .withColumn("drift", F.col("p_value") < alpha))


# Parameter sets of the test, on all rows; ``max_rows`` may be given to sample
# each side first.
TEST_PRESETS = {
    "default": dict(n_projections=50, n_permutations=500),
    "collected": dict(n_projections=100, n_permutations=99, fresh=True,
                      method="quantile_union", standardize="none", pvalue="ge_mean"),
    "frames": dict(n_projections=200, n_permutations=500, fresh=True, split="hash",
                   method="quantile_union", standardize="none", pvalue="ge_mean"),
    "fresh": dict(n_projections=50, n_permutations=500, fresh=True,
                  method="quantile_union", standardize="none", pvalue="ge_mean"),
    "projected": dict(n_projections=50, n_permutations=500, method="sorted", standardize="self"),
}


def swd_test(ref: DataFrame, det: DataFrame, features: Sequence[str], key: Sequence[str],
             preset: str = "default", alpha: float = 0.05, seed: int = 42, **override) -> DataFrame:
    """Report row of the test under a preset."""
    from driftspark.operators.sampling import sample_rows

    p = {**TEST_PRESETS[preset], **override}
    rule, cap = p.pop("pvalue", "plus_one"), p.pop("max_rows", None)
    if cap:
        ref, det = (sample_rows(d, key, cap, seed) for d in (ref, det))
    return swd_report(swd_null(ref, det, features, key, seed=seed, **p), alpha, rule)
