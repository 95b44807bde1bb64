"""Random samples, splits and blocks; the adaptive representative sample."""

from __future__ import annotations

import math
import random
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftspark.functions.hashing import HASH_BITS, PERM_PRIME, hash_key, perm_hash, perm_parts
from driftspark.operators.ks import count_cube, exact_cuts, ks_samples, step_bounds
from driftspark.plans.buckets import (
    bucket_bits,
    fit_cuts,
    hash_rank,
    hash_tiles,
    ntile_ends,
    order_statistics,
    smallest,
    tile_by_cuts,
    to_long,
)
from driftspark.plans.workdir import new_path

# Deviations of a border beyond its expected place that a store covers.
BAND = 8


def sample_size(epsilon: float = 0.05, alpha: float = 0.10) -> int:
    """Rows that estimate a CDF to ``epsilon`` with confidence 1 - ``alpha``."""
    return int(math.log(2 / alpha) / (2 * epsilon**2))


def coarse_parts(m: int, epsilon: float, alpha: float) -> int:
    """Number of coarse random subsets when ``m`` blocks are more than needed."""
    return max(1, m // max(1, sample_size(epsilon, alpha)))


def coarse_subset(df: DataFrame, key: Sequence[str], s: int, seed: int) -> DataFrame:
    """One of ``s`` random subsets; which one follows from the seed."""
    if s <= 1:
        return df
    chosen = random.Random(seed).randrange(s)
    return df.where(F.pmod(hash_key(key, seed + 1), F.lit(s)) == chosen)


def into_blocks(df: DataFrame, m: int, key: Sequence[str]) -> DataFrame:
    """Physical layout: ``m`` partitions, rows placed by their key."""
    return df.repartition(m, *key)


def assign_blocks(df: DataFrame, key: Sequence[str], k: int, seed: int = 42,
                  mode: str = "tiles", out: str = "block_id") -> DataFrame:
    """Random blocks 0..k-1.

    ``tiles``: equal sizes (+-1) without moving rows. ``round_robin``: rank in
    shuffled order modulo k, equal sizes, one shuffle. ``hash``: sizes equal
    only on average, one scan, no extra job.
    """
    if mode == "tiles":
        return hash_tiles(df, key, k, seed, out)
    if mode == "round_robin":
        return (hash_rank(df, key, seed, out="_rank")
                .withColumn(out, F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int"))
                .drop("_rank", "_rank_total"))
    if mode == "hash":
        return df.withColumn(out, F.pmod(hash_key(key, seed), F.lit(k)).cast("int"))
    raise ValueError(f"unknown block mode {mode!r}")


def prefix(blocks: DataFrame, t: int, col: str = "block_id") -> DataFrame:
    """The first ``t`` blocks."""
    return blocks.where(F.col(col) < t)


def sample_rows(df: DataFrame, key: Sequence[str], n: int, seed: int = 42,
                fast: bool = False, oversample: float = 1.2) -> DataFrame:
    """``n`` random rows, or all if there are fewer. ``fast`` first thins the
    table by hash key to about ``oversample * n`` rows and looks for the border
    in these only, or in the whole table where they are fewer than ``n``; the
    rows are the same."""
    if not fast:
        return smallest(df, key, n, seed)
    total = df.count()
    share = min(1.0, n * oversample / max(1, total))
    thin = df.where(hash_key(key, seed) < F.lit(int(share * 2**HASH_BITS)))
    if share == 1.0 or thin.count() < min(n, total):
        return smallest(df, key, n, seed)
    return smallest(thin, key, n, seed)


def split(df: DataFrame, key: Sequence[str], share: float = 0.8, seed: int = 42,
          exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """Random split by row key; ``exact`` fixes the size of the first part."""
    h = hash_key(key, seed)
    cut = F.lit(int(share * 2**HASH_BITS))
    if exact:
        n = df.count()
        first = smallest(df, key, round(n * share), seed)
        return first, df.join(first.select(*key), list(key), "left_anti")
    return df.where(h < cut), df.where(h >= cut)


def equal_sizes(both: DataFrame, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Cut the larger side to the size of the smaller one (random rows)."""
    n = {r["side"]: r["count"] for r in both.groupBy("side").count().collect()}
    few = min(n.get(0, 0), n.get(1, 0))
    parts = [smallest(both.where(F.col("side") == s), key, few, seed) for s in (0, 1)]
    return parts[0].unionByName(parts[1])


def resplit(df: DataFrame, key: Sequence[str], perm: int, n_first: int, seed: int = 42,
            exact: bool = True, out: str = "side") -> DataFrame:
    """Random re-split of pooled rows for permutation ``perm``: ``side`` 0 or 1.

    ``exact`` gives exactly ``n_first`` rows to side 0 (a border found by two
    aggregates); otherwise the sizes hold on average and nothing but the row
    count is needed.
    """
    from driftspark.operators.permutation import permutation_cuts

    a, b = perm_parts(key, seed)
    h = perm_hash(a, b, F.lit(perm))
    if exact:
        keyed = df.select(a.alias("_a"), b.alias("_b"))
        cut = permutation_cuts(keyed, [perm], n_first)[perm]
    else:
        cut = int(PERM_PRIME * n_first / max(1, df.count())) - 1
    return df.withColumn(out, F.when(h <= F.lit(cut), 0).otherwise(1))


# Parameter sets of the sampler. ``features=None`` means all given columns.
PRESETS = {
    "generic": dict(m=50, k=50, t_max=20),
    "fixed_columns": dict(m=50, k=50, t_max=20, features=[f"x{i}" for i in range(1, 29)]),
    "notebook": dict(m=512, k=50, t_max=20, features=[f"x{i}" for i in range(1, 6)]),
    # ``rows``: drawn before blocks are formed; by default it follows from epsilon and alpha
    "bounded": dict(m=50, k=20, t_max=20, rows="auto"),
}


def bounded_target(k: int) -> int:
    """Rows drawn before blocks are formed in the bounded sampler."""
    return max(4 * k, 2000)


def convergence(blocks: DataFrame, features: Sequence[str], t_from: int = 2, t_to: int = 20,
                exact: bool = True, nulls: str = "drop", cuts: dict | None = None,
                bounds: bool = False, cube: DataFrame | None = None, n: int | None = None) -> DataFrame:
    """KS distance between the first t-1 and the first t blocks, for all t in
    one plan: ``(t, feature, ks)``."""
    ts = list(range(t_from, t_to + 1))
    samples = [f"block_id < {t}" for t in range(t_from - 1, t_to + 1)]
    pairs = [(t, i, i + 1) for i, t in enumerate(ts)]
    return (ks_samples(prefix(blocks, t_to), features, "block_id", samples, pairs,
                       n_buckets=256 if exact or bounds else 50, exact=exact, nulls=nulls, cuts=cuts,
                       bounds=bounds, n=n, cube=cube)
            .withColumnRenamed("pair", "t"))


def first_converged(blocks: DataFrame, features: Sequence[str], t_to: int, epsilon: float,
                    exact: bool, nulls: str, cuts: dict, cube: DataFrame, sizes: Sequence[int] = ()) -> int | None:
    """Smallest t-1 whose step moved no feature by more than ``epsilon``.

    The cells of the cube bound every distance from both sides, which settles
    nearly all steps without reading a row; only a step whose bounds enclose
    ``epsilon`` is computed exactly, from its first blocks. ``sizes``, the rows
    of the first 1, 2, .. blocks, saves a count then.
    """
    table = step_bounds(cube, range(2, t_to + 1))
    worst = table.groupBy("t").agg(F.max("ks").alias("ks"),
                                   F.max("ks_most" if exact else "ks").alias("most"))
    for r in sorted(worst.collect()):
        if r["ks"] > epsilon:
            continue
        if r["most"] <= epsilon:
            return r["t"] - 1
        one = convergence(blocks, features, r["t"], r["t"], True, nulls, cuts, cube=cube,
                          n=sizes[r["t"] - 1] if sizes else None)
        if one.agg(F.max("ks")).first()[0] <= epsilon:
            return r["t"] - 1
    return None


class PrefixStore:
    """The rows that the first blocks of a table can hold, hash key and
    features only, in one scan, after a count of its ``n`` rows, for which a
    plain Parquet table is not read.

    Hash keys are uniform, so the first ``t`` of ``k`` blocks end close to
    t / k of their range; a band of BAND deviations is kept beyond that, and a
    table whose border lies outside it is stored whole. Files are in the order
    of the key, so that a prefix of blocks skips the others' row groups.
    """

    def __init__(self, df: DataFrame, features: Sequence[str], key: Sequence[str], k: int, t: int, seed: int):
        rows = df.select(hash_key(key, seed).alias("_h"), *[F.col(c).cast("double").alias(c) for c in features])
        share = min(1.0, t / k)
        self.n = df.count()
        self.rows = self._write(rows, share)
        self.ranks = [r for r in ntile_ends(self.n, k) if r < self.n][:t]
        self.cuts = self._borders()
        if len(self.cuts) < len(set(self.ranks)):
            self.rows = self._write(rows, 1.0)
            self.cuts = self._borders()

    def _write(self, rows: DataFrame, share: float) -> DataFrame:
        path = new_path(rows.sparkSession, "blocks")
        edge = min(1.0, share + BAND * math.sqrt(share * (1 - share) / max(1, self.n)))
        rows.where(F.col("_h") < F.lit(int(edge * 2**HASH_BITS))).sortWithinPartitions("_h").write.parquet(path)
        return rows.sparkSession.read.schema(rows.schema).parquet(path)

    def _borders(self) -> list[int]:
        """Last hash key of each of the first blocks, as far as they are stored."""
        shift = HASH_BITS - bucket_bits(self.rows.sparkSession)
        long = self.rows.select(F.lit(0).alias("feature_id"), F.col("_h").alias("value"), F.shiftright("_h", shift).cast("int").alias("bucket"))
        found, _ = order_statistics(long, lambda _, m: [r for r in self.ranks if r <= m])
        return [found[0, r] for r in sorted(set(self.ranks)) if (0, r) in found]

    def blocks(self) -> DataFrame:
        """Stored rows with their ``block_id``; the last is cut short."""
        return tile_by_cuts(self.rows, F.col("_h"), self.cuts, "block_id")


def adaptive_sample(df: DataFrame, features: Sequence[str] | None, key: Sequence[str], *,
                    preset: str = "generic", epsilon: float = 0.05, alpha: float = 0.10,
                    epsilon_a2: float = 0.02, seed: int = 42, exact: bool = True,
                    nulls: str = "drop", keep_block: bool = False, **override) -> DataFrame:
    """Representative sample whose size follows from KS convergence.

    Blocks are equal random tiles; block prefixes are compared until one more
    block no longer changes any feature's distribution by ``epsilon_a2``. The
    table is counted, then read twice: for the :class:`PrefixStore`, and for
    the sample that is returned. Borders, cut points and the count cube come from the store,
    all steps from the cube.
    """
    p = {**PRESETS[preset], **override}
    features = list(dict.fromkeys(features or p.get("features") or []))
    if not features:
        raise ValueError("feature columns must be non-empty")
    df = coarse_subset(df, key, coarse_parts(p["m"], epsilon, alpha), seed)
    if p.get("rows"):
        target = bounded_target(sample_size(epsilon, alpha)) if p["rows"] == "auto" else p["rows"]
        df = smallest(df, key, target, seed + 2)
    store = PrefixStore(df, features, key, p["k"], p["t_max"], seed)
    if store.n == 0:
        raise ValueError("input window is empty")
    t_eff = min(p["t_max"], len(store.cuts) + (len(store.ranks) < p["t_max"]))
    chosen = None
    if t_eff >= 2:
        blocks = store.blocks()
        # one set of cut points, from the first blocks, serves all steps
        few = min(3, t_eff)
        first = prefix(blocks, few)
        bins = fit_cuts(first, features, 256, store.n * few // p["k"]) if exact else exact_cuts(first, features, 50)
        path = new_path(df.sparkSession, "cube")
        long = to_long(prefix(blocks, t_eff), features, bins, ["block_id"], keep_nulls=nulls == "count")
        count_cube(long, "block_id").write.parquet(path)
        cube = df.sparkSession.read.parquet(path)
        chosen = first_converged(blocks, features, t_eff, epsilon_a2, exact, nulls, bins, cube,
                                 [*store.ranks, *[store.n] * (t_eff - len(store.ranks))])
    if chosen is None:
        chosen = max(1, t_eff - 1)
    out = tile_by_cuts(df, hash_key(key, seed), store.cuts, "block_id")
    out = prefix(out, chosen)
    return out if keep_block else out.drop("block_id")


def sampling_times(df: DataFrame, features: Sequence[str], key: Sequence[str], n: int,
                   seed: int = 42) -> DataFrame:
    """Rows and wall time of the samplers on one table: ``(method, n_rows, seconds)``."""
    ways = {"adaptive": lambda: adaptive_sample(df, features, key, seed=seed),
            "by_key": lambda: sample_rows(df, key, n, seed),
            "bernoulli": lambda: sample_rows(df, key, n, seed, fast=True)}
    rows = []
    for name, draw in ways.items():
        start = time.perf_counter()
        count = draw().count()
        rows.append((name, count, time.perf_counter() - start))
    return df.sparkSession.createDataFrame(rows, "method string, n_rows long, seconds double")
