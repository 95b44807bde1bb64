"""Blocks, splits, samples and window cutting."""

import pytest
from pyspark.sql import functions as F

from driftspark.operators import extra, ks, sampling, windows
from driftspark.plans import buckets


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(2003).select(F.col("id"), (F.col("id") % 10).alias("g"),
                                    (F.sin("id") * 100).alias("x"), F.cos("id").alias("y")).cache()


def counts(df, col):
    return [r[1] for r in sorted(df.groupBy(col).count().collect())]


@pytest.mark.parametrize("mode", ["tiles", "round_robin"])
def test_blocks_differ_by_one_row_at_most(rows, mode):
    n = counts(sampling.assign_blocks(rows, ["id"], 50, mode=mode), "block_id")
    assert len(n) == 50 and sum(n) == 2003 and max(n) - min(n) == 1
    # the longer blocks come first
    assert n == sorted(n, reverse=True)


def test_blocks_do_not_depend_on_partitioning(rows):
    one = {(r.id, r.block_id) for r in sampling.assign_blocks(rows, ["id"], 7).collect()}
    two = {(r.id, r.block_id) for r in sampling.assign_blocks(rows.repartition(13), ["id"], 7).collect()}
    other = {(r.id, r.block_id) for r in sampling.assign_blocks(rows, ["id"], 7, seed=1).collect()}
    assert one == two and one != other


def test_fewer_rows_than_blocks(rows):
    assert counts(sampling.assign_blocks(rows.limit(3), ["id"], 5), "block_id") == [1, 1, 1]
    assert sampling.assign_blocks(rows.limit(0), ["id"], 5).count() == 0


def test_equal_keys_share_a_block(rows):
    b = sampling.assign_blocks(rows, ["g"], 4)
    assert b.select("g", "block_id").distinct().count() == 10


def test_samples(rows):
    assert sampling.sample_rows(rows, ["id"], 100).count() == 100
    assert sampling.sample_rows(rows, ["id"], 5000).count() == 2003
    assert sampling.sample_rows(rows, ["id"], 0).count() == 0
    assert sampling.sample_rows(rows, ["id"], 100, fast=True).count() <= 100


def test_fast_sample_is_the_exact_one(spark):
    """Also with a few rows of many, and where a third of the rows share a key above the border."""
    few = spark.range(20_000)
    hot = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN -1 ELSE id END AS id", "id AS v")
    short = 0
    for df, n, seeds in ((few, 3, range(6)), (hot, 600, range(4))):
        for seed in seeds:
            got = sorted(map(tuple, sampling.sample_rows(df, ["id"], n, seed, fast=True).collect()))
            assert len(got) == n and got == sorted(map(tuple, sampling.sample_rows(df, ["id"], n, seed).collect()))
            cut = int(n * 1.2 / df.count() * 2**sampling.HASH_BITS)
            short += df.where(sampling.hash_key(["id"], seed) < F.lit(cut)).count() < n
    assert short  # the thinned table alone was too small at times


@pytest.mark.parametrize("exact", [True, False])
def test_split_is_a_partition(rows, exact):
    a, b = sampling.split(rows, ["id"], 0.8, exact=exact)
    assert a.count() + b.count() == 2003
    assert a.join(b, "id").count() == 0
    assert abs(a.count() - 1602) <= (0 if exact else 80)


def test_resplit_sizes(rows):
    for p in (1, 2):
        assert counts(sampling.resplit(rows, ["id"], p, 700), "side") == [700, 1303]
    loose = counts(sampling.resplit(rows, ["id"], 1, 700, exact=False), "side")
    assert sum(loose) == 2003 and abs(loose[0] - 700) < 100


def test_sample_size_formula():
    assert sampling.sample_size() == 599
    assert sampling.coarse_parts(50, 0.05, 0.10) == 1
    assert sampling.bounded_target(599) == 2396


def test_coarse_subset(rows):
    parts = [sampling.coarse_subset(rows, ["id"], 3, s).count() for s in range(4)]
    assert all(500 < p < 850 for p in parts)
    assert sampling.coarse_subset(rows, ["id"], 1, 0).count() == 2003


def test_adaptive_sample(rows):
    table = sampling.convergence(sampling.assign_blocks(rows, ["id"], 50), ["x", "y"])
    worst = {r.t: r.ks for r in table.groupBy("t").agg(F.max("ks").alias("ks")).collect()}
    assert set(worst) == set(range(2, 21)) and all(0 <= v <= 1 for v in worst.values())
    t = min((t for t, v in worst.items() if v <= 0.02), default=20) - 1
    s = sampling.adaptive_sample(rows, ["x", "y"], ["id"], keep_block=True)
    assert s.select("block_id").distinct().count() == t
    assert s.count() == len([i for i in range(2003) if i % 50 < t])


def test_bounds_enclose_the_distance(rows):
    b = sampling.assign_blocks(rows, ["id"], 50)
    exact = {(r.t, r.feature): r.ks for r in sampling.convergence(b, ["x", "y"]).collect()}
    from driftspark.operators import ks
    from driftspark.plans.buckets import fit_cuts, to_long
    cuts = fit_cuts(rows, ["x", "y"], 8)
    for r in sampling.convergence(b, ["x", "y"], exact=False, bounds=True, cuts=cuts).collect():
        assert r.ks <= exact[r.t, r.feature] <= r.ks_most
    # wide bounds: every step has to be settled exactly
    want = min((t for t in range(2, 21) if max(v for (u, _), v in exact.items() if u == t) <= 0.02), default=None)
    cube = ks.count_cube(to_long(b.where("block_id < 20"), ["x", "y"], cuts, ["block_id"]), "block_id")
    assert sampling.first_converged(b, ["x", "y"], 20, 0.02, True, "drop", cuts, cube) == (want and want - 1)


def test_adaptive_sample_edges(rows):
    with pytest.raises(ValueError):
        sampling.adaptive_sample(rows.limit(0), ["x"], ["id"])
    with pytest.raises(ValueError):
        sampling.adaptive_sample(rows, [], ["id"])
    # one block only: it is returned
    assert sampling.adaptive_sample(rows.limit(1), ["x"], ["id"]).count() == 1
    # never converging: all but the last step
    s = sampling.adaptive_sample(rows, ["x"], ["id"], epsilon_a2=-1.0, keep_block=True)
    assert s.select("block_id").distinct().count() == 19
    # at once
    s = sampling.adaptive_sample(rows, ["x"], ["id"], epsilon_a2=1.0, keep_block=True)
    assert s.select("block_id").distinct().count() == 1


def test_contiguous_windows(rows):
    w = windows.contiguous_windows(rows, "id", 10)
    spans = w.groupBy("window_id").agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b"))
    at = 0
    for r in sorted(spans.collect()):
        assert (r.a, r.b - r.a + 1) == (at, r.n)
        at = r.b + 1
    assert counts(w, "window_id") == [201] * 3 + [200] * 7


def test_subwindows_cover_all_and_follow_the_plan(spark):
    # one source holds most rows, one source is null
    df = spark.range(1000).selectExpr(
        "id", "CASE WHEN id < 700 THEN 'big' WHEN id < 950 THEN 'mid' WHEN id < 990 THEN 'low' END AS s")
    plan = {r.s: (r.cnt, r.n_windows, r.first_window) for r in windows.subwindow_plan(df, "s", 300, 100).collect()}
    assert plan == {None: (10, 1, 0), "low": (40, 1, 1), "mid": (250, 1, 2), "big": (700, 3, 3)}
    w = windows.subwindows(df, "s", ["id"], 300, 100)
    assert counts(w, "window_id") == [10, 40, 250, 234, 233, 233]


def test_subwindow_floor(spark):
    df = spark.range(1000).selectExpr("id", "'a' AS s")
    # ceil(1000/300) = 4 windows of 250 are too small for 400: 1000 div 400 = 2
    assert windows.subwindow_plan(df, "s", 300, 400).first().n_windows == 2


def test_hash_rank_is_a_permutation(rows):
    r = buckets.hash_rank(rows, ["id"], 1, by=["g"])
    got = r.groupBy("g").agg(F.countDistinct("rank").alias("d"), F.max("rank").alias("m"), F.max("rank_total").alias("n"))
    assert all(x.d == x.m == x.n for x in got.collect())


def test_running_total(rows):
    got = extra.running_total(rows, "id", F.col("g")).orderBy("id").select("g", "total_before").collect()
    total = 0
    for r in got:
        assert r.total_before == total
        total += r.g


def test_equal_height_and_overshoot(spark):
    df = spark.range(1, 101).selectExpr("cast(id AS double) AS v")
    b = [r.bound for r in extra.equal_height_bounds(df, "v", 4).orderBy("i").collect()]
    assert b == [1, 25, 50, 75, 100]
    # ten bins of ten rows; three groups of 33: each takes four bins, 7 too many
    assert extra.split_overshoot(df, "v", 10, 3).first().overshoot == 7
    # the bins run out in the third group: 20 of 33 rows
    assert extra.split_overshoot(df.where("v <= 100"), "v", 10, 2).first().overshoot == 0


def test_block_pick(rows):
    b = sampling.assign_blocks(rows, ["id"], 20, mode="hash")
    ids = [r.block_id for r in extra.pick_blocks(b, "block_id", 6).collect()]
    assert len(set(ids)) == 6


def test_repeated_key_at_the_border(spark):
    """Exactly n rows, the same ones for any layout, though keys repeat."""
    df = spark.range(1000).selectExpr("id % 40 AS k", "id AS v")
    few = sorted(r.v for r in sampling.sample_rows(df, ["k"], 60).collect())
    assert len(few) == 60
    assert few == sorted(r.v for r in sampling.sample_rows(df.repartition(7), ["k"], 60).collect())


def test_inexact_distance_does_not_depend_on_the_layout(rows):
    got = [sorted(map(tuple, sampling.convergence(sampling.assign_blocks(rows.repartition(n), ["id"], 20), ["x", "y"], exact=False).collect()))
           for n in (3, 7)]
    assert got[0] == got[1]


def test_adaptive_sample_reads_the_table_twice(spark, monkeypatch):
    """Once for the store of the first blocks, once for the result, and once to
    be counted, which needs no column; the same
    rows where the border lies outside the band and the table is stored whole."""
    from driftspark.operators import sampling

    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    n = 6_000
    df = spark.range(n).selectExpr("id", "cast(pmod(id * 7919, 1009) AS double) AS x", "exp(pmod(id * 31, 997) / 99D) AS y")
    df = df.mapInArrow(counted, df.schema)
    got = sorted(map(tuple, sampling.adaptive_sample(df, ["x", "y"], ["id"], epsilon_a2=0.05, keep_block=True).collect()))
    assert read.value == 3 * n and 0 < len(got) < n
    monkeypatch.setattr(sampling, "BAND", -1000)
    assert sorted(map(tuple, sampling.adaptive_sample(df, ["x", "y"], ["id"], epsilon_a2=0.05, keep_block=True).collect())) == got


def test_cube_gives_the_convergence_of_the_rows(spark):
    """Bounds from the cube enclose the exact distances of every step, and a
    sample of any blocks is a sum of cells."""
    from driftspark.operators import ks, sampling
    from driftspark.plans import buckets

    df = spark.range(3_000).selectExpr("id", "CASE WHEN id % 11 > 0 THEN cast(pmod(id * 7919, 1009) AS double) END AS x")
    blocks = sampling.assign_blocks(df, ["id"], 10)
    cuts = buckets.fit_cuts(df, ["x"], 16)
    for nulls in ("drop", "count"):
        cube = ks.count_cube(buckets.to_long(blocks, ["x"], cuts, ["block_id"], keep_nulls=nulls == "count"), "block_id").cache()
        exact = {r.t: r.ks for r in sampling.convergence(blocks, ["x"], 2, 10, nulls=nulls).collect()}
        again = {r.t: r.ks for r in sampling.convergence(blocks, ["x"], 2, 10, nulls=nulls, cuts=cuts, cube=cube).collect()}
        bound = {r.t: (r.ks, r.ks_most) for r in sampling.convergence(
            blocks, ["x"], 2, 10, False, nulls, cuts, bounds=True, cube=cube).collect()}
        assert exact == again and all(lo <= exact[t] + 1e-12 and exact[t] <= hi + 1e-12 for t, (lo, hi) in bound.items())
        assert cube.count() <= 10 * (len(cuts["x"]) + 2)


@pytest.mark.parametrize("shape", ["flat", "steep", "repeated"])
def test_opened_buckets_give_the_same_ranks_for_any_number_of_rows(spark, monkeypatch, shape):
    """Exact order statistics, and as many rows at the driver for 100 times the rows."""
    from driftspark.plans import buckets

    monkeypatch.setattr(buckets, "ROWS_PER_BUCKET", 50)
    monkeypatch.setattr(buckets, "PARTS", 4)
    monkeypatch.setattr(buckets, "CUT_SAMPLE_ROWS", 500)
    value = {"flat": "cast(pmod(id * 7919, 100003) AS double)", "steep": "exp(pmod(id * 7919, 100003) / 2000D)",
             "repeated": "cast(CASE WHEN id % 3 = 0 THEN 5 ELSE pmod(id * 7919, 100003) END AS double)"}[shape]
    most = {}
    collect, seen = type(spark.range(1)).collect, []
    monkeypatch.setattr(type(spark.range(1)), "collect", lambda self: seen.append(collect(self)) or seen[-1])
    for n in (400, 40_000):
        df = spark.range(n).selectExpr(f"{value} AS v")
        values = sorted(r[0] for r in collect(df))
        long = buckets.to_long(df, ["v"], buckets.fit_cuts(df, ["v"], 4))
        seen.clear()
        found, totals = buckets.order_statistics(long, lambda _, m: [1, m // 3, m // 2, m])
        assert totals == {0: n} and [found[0, r] for r in (1, n // 3, n // 2, n)] == [values[r - 1] for r in (1, n // 3, n // 2, n)]
        most[n] = max(map(len, seen))
    assert most[40_000] <= 4 * 2 * 4 + 4  # ranks x parts, with a cut on either side of each


@pytest.mark.parametrize("shape", ["flat", "steep", "repeated"])
def test_subdivided_buckets_keep_the_order(spark, monkeypatch, shape):
    from pyspark.sql import functions as F

    from driftspark.plans import buckets

    value = {"flat": "cast(id AS double)", "steep": "CASE WHEN id = 7 THEN double('Infinity') ELSE exp(id / 300D) END",
             "repeated": "cast(id % 7 AS double)"}[shape]
    df = spark.range(20_000).selectExpr(f"{value} AS v")
    long = buckets.to_long(df, ["v"], buckets.fit_cuts(df, ["v"], 4))
    monkeypatch.setattr(buckets, "ROWS_PER_BUCKET", 500)
    fine = buckets.subdivided(long, 20_000, 4)
    rows = sorted((r.bucket, r.lo, r.hi, r.n) for r in fine.groupBy("bucket").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n")).collect())
    assert sum(r[3] for r in rows) == 20_000 and all(a[2] < b[1] for a, b in zip(rows, rows[1:]))
    if shape == "flat":
        assert max(r[3] for r in rows) <= 600
    assert buckets.subdivided(long, 20_000, 40) is long


def test_distances_of_opened_buckets(spark, monkeypatch):
    """KS, W1, AUC, quantiles and the permutation test do not change when buckets are opened."""
    from driftspark.operators import ks, metrics, permutation, wasserstein
    from driftspark.plans import buckets

    df = spark.range(3_000).selectExpr("id", "cast(pmod(id * 7919, 1009) AS double) AS x", "exp(pmod(id * 31, 997) / 99D) AS y",
                                       "cast(id % 5 = 0 AS int) AS label")
    a, b = df.where("id % 3 > 0"), df.where("id % 3 = 0").withColumn("x", df.x + 20)
    cols, key = ["x", "y"], ["id"]

    def run():
        return [sorted(map(tuple, t.collect())) for t in (
            ks.ks_exact(a, b, cols, n_buckets=4), wasserstein.w1_features(a, b, cols, key, n_buckets=4),
            wasserstein.w1_features(a, b, cols, key, "quantile_union", n_buckets=4), metrics.auc(df, "label", "y"),
            ks.quantile_table(df, cols, [0.1, 0.5, 0.77]), permutation.swd_null(a, b, cols, key, 3, 5, n_buckets=2),
            wasserstein.swd(a, b, cols, key, n_projections=3, n_buckets=4))]

    before = run()
    monkeypatch.setattr(buckets, "ROWS_PER_BUCKET", 60)
    monkeypatch.setattr(permutation, "MOST_ROWS", 60)
    for one, other in zip(before, run(), strict=True):
        assert [[v if not isinstance(v, float) else pytest.approx(v, rel=1e-9) for v in r] for r in one] == [list(r) for r in other]


def test_label_borders_outside_the_band(spark, monkeypatch):
    """The border of a permutation is exact, inside the expected band or not."""
    from driftspark.functions.hashing import perm_hash, perm_parts
    from driftspark.operators import permutation
    from pyspark.sql import functions as F

    a, b = perm_parts(["id"], 3)
    keyed = spark.range(900).select(a.alias("_a"), b.alias("_b")).cache()
    want = {p: sorted(r[0] for r in keyed.select(perm_hash(F.col("_a"), F.col("_b"), F.lit(p))).collect())[299] for p in range(1, 6)}
    assert permutation.permutation_cuts(keyed, range(1, 6), 300) == want
    monkeypatch.setattr(permutation, "BAND", 0.01)
    assert permutation.permutation_cuts(keyed, range(1, 6), 300) == want


def test_step_bounds_are_those_of_the_plan(spark):
    b = spark.range(500).selectExpr("cast(id % 5 AS int) AS block_id", "if(id % 9 = 0, null, cast(id * 7919 % 83 AS double)) AS x", "1D AS y")
    for nulls in ("drop", "count"):
        cuts = buckets.fit_cuts(b, ["x", "y"], 16)
        cube = ks.count_cube(buckets.to_long(b, ["x", "y"], cuts, ["block_id"], keep_nulls=nulls == "count"), "block_id")
        want = sampling.convergence(b, ["x", "y"], 2, 5, False, nulls, cuts, bounds=True, cube=cube)
        want = want.groupBy("t").agg(F.max("ks"), F.max("ks_most")).collect()
        got = ks.step_bounds(cube, range(2, 6)).groupBy("t").agg(F.max("ks"), F.max("ks_most")).collect()
        assert sorted(got) == sorted(want)
