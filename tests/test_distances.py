"""Distances against short NumPy versions, and their properties."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftspark.operators import ks, permutation, wasserstein
from driftspark.operators.drift import swd_by_window
from driftspark.plans import buckets


def np_ks(a, b):
    v = np.unique(np.concatenate([a, b]))
    return np.abs(np.searchsorted(np.sort(a), v, "right") / len(a)
                  - np.searchsorted(np.sort(b), v, "right") / len(b)).max()


def np_w1(a, b):
    v = np.sort(np.concatenate([a, b]))
    gap = (np.searchsorted(np.sort(a), v[:-1], "right") / len(a)
           - np.searchsorted(np.sort(b), v[:-1], "right") / len(b))
    return (np.abs(gap) * np.diff(v)).sum()


def np_interp(a, b):
    n = max(len(a), len(b))
    u = np.linspace(0, 1, n)
    f = lambda x: np.interp(u, np.linspace(0, 1, len(x)), np.sort(x))
    return np.abs(f(a) - f(b)).mean()


def np_union(a, b):
    p = np.unique(np.concatenate([np.arange(1, len(x) + 1) / len(x) for x in (a, b)]))
    return np.abs(np.quantile(a, p) - np.quantile(b, p)).mean()


METHODS = {"exact": np_w1, "interp": np_interp, "quantile_union": np_union}
COLS = ["x", "y", "z"]


def make(n, seed, shift=0.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(shift, 1, n)
    y = np.where(rng.random(n) < 0.4, 0.0, rng.lognormal(0, 2, n))  # one value holds 40% of the rows
    return pd.DataFrame({"id": np.arange(n), "x": x, "y": y, "z": 7.0})


@pytest.fixture(scope="module")
def sides(spark):
    a, b = make(900, 1), make(701, 2, 0.3)
    return a, b, spark.createDataFrame(a).repartition(3).cache(), spark.createDataFrame(b).repartition(5).cache()


def test_ks_equals_numpy(sides):
    a, b, da, db = sides
    got = {r.feature: r.ks for r in ks.ks_exact(da, db, COLS).collect()}
    for c in COLS:
        assert got[c] == np_ks(a[c].to_numpy(), b[c].to_numpy())
    few = {r.feature: r.ks for r in ks.ks_exact(da, db, COLS, n_buckets=4).collect()}
    assert few == got  # cut points steer balance, never the result


def test_ks_is_zero_on_itself_and_empty(sides, spark):
    _, _, da, _ = sides
    assert {r.ks for r in ks.ks_exact(da, da, COLS).collect()} == {0.0}
    assert {r.ks for r in ks.ks_exact(da, da.limit(0), COLS).collect()} == {0.0}
    assert ks.ks_max(ks.ks_exact(da.limit(0), da.limit(0), COLS)).first().ks_max == 0.0


def test_ks_null_modes(spark):
    a = spark.createDataFrame([(1.0,), (2.0,), (None,), (None,)], "x double")
    b = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (float("nan"),)], "x double")
    assert ks.ks_exact(a, b, ["x"]).first().ks == pytest.approx(1 / 3)
    # sizes 4 and 4: F_a stops at 1/2, F_b at 3/4
    assert ks.ks_exact(a, b, ["x"], nulls="count").first().ks == pytest.approx(0.25)


def test_ks_points_equals_numpy(sides):
    a, b, da, db = sides
    got = {r.feature: r.ks for r in ks.ks_points(da, db, COLS, exact=True).collect()}
    for c in COLS:
        x, y = np.sort(a[c]), np.sort(b[c])
        q = np.quantile(x, np.arange(50) / 49)
        want = np.abs(np.searchsorted(x, q, "right") / len(x) - np.searchsorted(y, q, "right") / len(y)).max()
        assert got[c] == pytest.approx(want, abs=2 / 900)
    sketch = {r.feature: r.ks for r in ks.ks_points(da, db, COLS).collect()}
    assert all(sketch[c] <= np_ks(a[c].to_numpy(), b[c].to_numpy()) + 1e-12 for c in COLS)


def test_quantiles_equal_numpy(sides):
    a, _, da, _ = sides
    p = [0.0, 0.013, 0.25, 0.5, 0.99, 1.0]
    got = ks.quantiles(da, COLS, p)
    for c in COLS:
        assert got[c] == pytest.approx(np.quantile(a[c], p).tolist(), abs=1e-12)


@pytest.mark.parametrize("method", METHODS)
def test_w1_equals_numpy(sides, method):
    a, b, da, db = sides
    got = {r.feature: r.w1 for r in wasserstein.w1_features(da, db, COLS, ["id"], method, n_buckets=8).collect()}
    for c in COLS:
        assert got[c] == pytest.approx(METHODS[method](a[c].to_numpy(), b[c].to_numpy()), abs=1e-10)


@pytest.mark.parametrize("method", METHODS)
def test_w1_of_tiny_samples(spark, method):
    a, b = np.array([2.0]), np.array([5.0, 9.0])
    da, db = (spark.createDataFrame(pd.DataFrame({"id": range(len(v)), "x": v})) for v in (a, b))
    got = wasserstein.w1_features(da, db, ["x"], ["id"], method).first().w1
    assert got == pytest.approx(METHODS[method](a, b))
    assert wasserstein.w1_features(da, da, ["x"], ["id"], method).first().w1 == 0.0


@pytest.mark.parametrize("method", ["interp", "quantile_union", "exact"])
def test_w1_of_one_row_against_many(spark, monkeypatch, method):
    """The one value answers for all levels, in parts."""
    monkeypatch.setattr(wasserstein, "LEVELS", 100)
    many = spark.range(1000).selectExpr("id", "cast(id AS double) AS v")
    one = spark.range(1).selectExpr("id", "250D AS v")
    got = wasserstein.w1_features(one, many, ["v"], ["id"], method).first()["w1"]
    v = np.arange(1000.0)
    if method == "interp":
        want = np.abs(v - 250).mean()
    elif method == "exact":
        want = np.abs(v - 250).mean()
    else:
        levels = np.union1d(np.arange(1, 1001) / 1000, [1.0])
        want = np.abs(np.quantile(v, levels) - 250).mean()
    assert got == pytest.approx(want)


def test_shift_moves_w1_by_the_shift(sides):
    _, _, da, _ = sides
    moved = da.withColumn("x", F.col("x") + 2.5)
    d = wasserstein.swd_directions(da, moved, COLS, ["id"], 8, standardize="none").collect()
    dirs = wasserstein.directions(8, 3, 42)
    for r in d:
        assert r.w1 == pytest.approx(abs(2.5 * dirs[r.proj][0]), abs=1e-9)


def test_swd_modes(sides):
    a, b, da, db = sides
    dirs = wasserstein.directions(10, 3, 42)
    x, y = a[COLS].to_numpy(), b[COLS].to_numpy()

    def sd(v):
        s = v.std(axis=0)
        return np.where(s == 0, 1, s)

    both = np.vstack([x, y])
    pairs = {
        "none": (x, y),
        "reference": ((x - x.mean(0)) / sd(x), (y - x.mean(0)) / sd(x)),
        "pooled": ((x - both.mean(0)) / sd(both), (y - both.mean(0)) / sd(both)),
        "self": ((x - x.mean(0)) / sd(x), (y - y.mean(0)) / sd(y)),
    }
    for mode, (u, v) in pairs.items():
        want = np.mean([np_w1(u @ q, v @ q) for q in dirs])
        got = wasserstein.swd(da, db, COLS, ["id"], n_projections=10, standardize=mode).first().swd
        assert got == pytest.approx(want, abs=1e-9), mode
    swapped = wasserstein.swd(db, da, COLS, ["id"], n_projections=10, standardize="none").first().swd
    assert swapped == pytest.approx(np.mean([np_w1(x @ q, y @ q) for q in dirs]))
    assert wasserstein.swd(da, da, COLS, ["id"]).first().swd == pytest.approx(0.0, abs=1e-12)


def test_many_terms_use_one_matrix_product(sides):
    a, _, da, _ = sides
    dirs = wasserstein.directions(100, 3, 1)
    wide, names = wasserstein.project(da, COLS, dirs, ["id"])
    pdf = wide.toPandas().sort_values("id")
    assert np.allclose(pdf[names].to_numpy(), a[COLS].to_numpy() @ dirs.T)


def test_result_does_not_depend_on_partitioning(sides):
    _, _, da, db = sides
    one = permutation.swd_null(da, db, COLS, ["id"], 4, 9).toPandas().sort_values("perm").swd.to_numpy()
    two = permutation.swd_null(da.repartition(11), db.coalesce(1), COLS, ["id"], 4, 9)
    assert np.allclose(one, two.toPandas().sort_values("perm").swd.to_numpy(), rtol=0, atol=1e-12)


def test_null_equals_numpy(sides):
    """Labels recomputed here; observed and all null values must agree, for any
    number of buckets and for the row-by-row form."""
    a, b, da, db = sides
    n0 = len(a)
    both = wasserstein.keyed_sides(da, db, COLS, ["id"], 42)
    z = wasserstein.standardized(both, COLS, "reference", ["side", "_a", "_b"]).toPandas()
    dirs = wasserstein.directions(4, 3, 42)
    v = z[COLS].to_numpy() @ dirs.T
    from driftspark.functions import PERM_PRIME
    want = []
    for p in range(8):
        if p == 0:
            ref = (z.side == 0).to_numpy()
        else:
            h = (z["_a"].to_numpy() * (p + 1) + z["_b"].to_numpy()) % PERM_PRIME
            ref = np.zeros(len(z), bool)
            ref[np.argsort(h, kind="stable")[:n0]] = True
        want.append(np.mean([np_w1(v[ref, i], v[~ref, i]) for i in range(4)]))
    for n_buckets in (1, 6):
        got = permutation.swd_null(da, db, COLS, ["id"], 4, 7, n_buckets=n_buckets).toPandas()
        assert np.allclose(got.sort_values("perm").swd, want, atol=1e-10)
    proj = wasserstein.Projected(da, db, COLS, ["id"], dirs, 42, "reference", "exact")
    border = permutation._cuts(proj.z, 7, *proj.n, "exact")
    rows = permutation._null_by_rows(proj.long(proj.cuts(6)), border, "exact").toPandas()
    assert np.allclose(rows.sort_values("perm").swd, want, atol=1e-10)


def test_drift_is_found_and_quiet_is_quiet(spark):
    ref, same, moved = (spark.createDataFrame(make(400, s, m)) for s, m in ((5, 0), (6, 0), (7, 1.0)))
    quiet = permutation.swd_test(ref, same, ["x", "y"], ["id"], n_projections=8, n_permutations=99).first()
    loud = permutation.swd_test(ref, moved, ["x", "y"], ["id"], n_projections=8, n_permutations=99).first()
    assert not quiet.drift and quiet.p_value > 0.05
    assert loud.drift and loud.p_value == pytest.approx(0.01) and loud.z_score > 3


def test_p_value_rules(spark):
    null = spark.createDataFrame([(0, 2.0), (1, 1.0), (2, 2.0), (3, 3.0), (4, 0.5)], "perm int, swd double")
    assert permutation.swd_report(null).first().p_value == pytest.approx(2 / 5)
    assert permutation.swd_report(null, pvalue="ge_mean").first().p_value == pytest.approx(2 / 4)
    with pytest.raises(ValueError):
        permutation.swd_report(null, pvalue="other")


def test_windows_in_a_row(spark):
    pdf = pd.concat([make(300, s, m).assign(w=i, id=lambda d, i=i: d.id + 1000 * i)
                     for i, (s, m) in enumerate([(1, 0), (2, 0), (3, 2.0)])])
    got = {r.w: r.swd for r in swd_by_window(spark.createDataFrame(pdf), "w", COLS, ["id"], 6).collect()}
    assert set(got) == {1, 2} and got[2] > 3 * got[1]
    dirs = wasserstein.directions(6, 3, 42)
    x, y = (pdf[pdf.w == i][COLS].to_numpy() for i in (0, 1))
    s = np.where(x.std(0) == 0, 1, x.std(0))
    want = np.mean([np_w1((x - x.mean(0)) / s @ q, (y - x.mean(0)) / s @ q) for q in dirs])
    assert got[1] == pytest.approx(want, abs=1e-9)


def test_windows_with_a_gap(spark):
    pdf = pd.concat([make(200, i, i).assign(w=w, id=lambda d, i=i: d.id + 1000 * i) for i, w in enumerate([0, 2, 3])])
    dense = pdf.assign(w=pdf.w.map({0: 0, 2: 1, 3: 2}))
    got = {r.w: r.swd for r in swd_by_window(spark.createDataFrame(pdf), "w", COLS, ["id"], 6).collect()}
    want = {r.w: r.swd for r in swd_by_window(spark.createDataFrame(dense), "w", COLS, ["id"], 6).collect()}
    assert set(got) == {2, 3} and got[2] == pytest.approx(want[1]) and got[3] == pytest.approx(want[2])


def test_diagnostics(sides):
    _, _, da, db = sides
    r = wasserstein.swd_diagnostics(da, da, COLS, ["id"]).first()
    assert r.identical and r.max_abs_diff == 0 and r.w1_mean == pytest.approx(0)
    r = wasserstein.swd_diagnostics(da, db, COLS, ["id"]).first()
    assert not r.identical and (r.n_ref, r.n_det) == (900, 701)


def test_bad_arguments(sides):
    _, _, da, db = sides
    for call in (lambda: ks.ks_exact(da, db, []), lambda: ks.ks_exact(da, db, ["x"], nulls="odd"),
                 lambda: wasserstein.swd(da, db, ["x"], ["id"], method="odd"),
                 lambda: wasserstein.swd(da, db, ["x"], ["id"], standardize="odd"),
                 lambda: permutation.swd_null(da, db.limit(0), ["x"], ["id"])):
        with pytest.raises(ValueError):
            call()


def test_a_hot_value_sits_alone_and_is_spread(spark):
    df = spark.range(9000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 5D ELSE id / 100D END AS v")
    cuts = buckets.fit_cuts(df, ["v"], 16)
    assert buckets.hot_values(cuts["v"]) == [5.0]
    long = buckets.to_long(df, ["v"], cuts, salt="id")
    sizes = long.groupBy("bucket").agg(F.count("*").alias("n"), F.countDistinct("value").alias("d")).collect()
    assert max(r.n for r in sizes) < 9000 / 8
    assert sum(r.n for r in sizes if r.d == 1) >= 3000


def _fresh_rows(spark, sizes=((40, 0.0), (9, 0.4))):
    rng = np.random.default_rng(3)
    sides = [pd.DataFrame(rng.standard_normal((n, 2)) + shift, columns=["x", "y"]).assign(k=np.arange(n)) for n, shift in sizes]
    return [spark.createDataFrame(s) for s in sides], sides


@pytest.mark.parametrize("name", ["test_frames", "test_fresh"])
def test_fresh_presets_draw_all_directions_and_permutations(monkeypatch, name):
    from driftspark.catalog import ORACLES, distances

    p, seen = permutation.TEST_PRESETS[name[5:]], {}
    assert f"({p['n_permutations']}, {p['n_projections'] - 1}, " in ORACLES[name] and f"({p['n_permutations'] + 1}, 0, " not in ORACLES[name]
    monkeypatch.setattr(distances, "_balances", lambda *_: ())
    monkeypatch.setattr(distances, "rounded", lambda df, *_, **__: df)
    monkeypatch.setattr(permutation, "swd_test", lambda **kw: seen.update(kw))
    getattr(distances, name)(None, "")
    assert seen == {"preset": name[5:]}


@pytest.mark.parametrize("method, split", [("quantile_union", "hash"), ("quantile_union", "exact"), ("interp", "exact"), ("exact", "exact")])
def test_fresh_by_pairs_and_by_waves(spark, monkeypatch, method, split):
    (ref, det), sides = _fresh_rows(spark)
    kw = dict(n_projections=3, n_permutations=7, standardize="none", method=method, split=split, fresh=True)
    pairs = {r.perm: r.swd for r in permutation.swd_null(ref, det, ["x", "y"], ["k"], **kw).collect()}
    monkeypatch.setattr(permutation, "TASK_ROWS", 10)
    monkeypatch.setattr(permutation, "WAVE_VALUES", 49 * 13)  # ends inside a permutation
    waves = {r.perm: r.swd for r in permutation.swd_null(ref, det, ["x", "y"], ["k"], **kw).collect()}
    assert set(pairs) == set(waves) == set(range(8))
    assert all(abs(pairs[p] - waves[p]) < 1e-9 for p in pairs)
    a, b = (s[["x", "y"]].to_numpy() for s in sides)
    want = np.mean([METHODS[method](a @ d, b @ d) for d in wasserstein.directions(3, 2, 42)])
    assert abs(pairs[0] - want) < 1e-9


def test_fresh_with_a_side_that_a_split_leaves_empty(spark):
    (ref, det), _ = _fresh_rows(spark, ((3, 0.0), (1, 0.0)))
    kw = dict(n_projections=2, n_permutations=40, standardize="none", split="hash", fresh=True)
    union = permutation.swd_null(ref, det, ["x", "y"], ["k"], method="quantile_union", **kw).collect()
    exact = permutation.swd_null(ref, det, ["x", "y"], ["k"], method="exact", **kw).collect()
    gone = {r.perm for r in exact if r.swd is None}
    assert gone and {r.perm for r in union} == set(range(41)) - gone


def np_by_window(pdf, n_projections):
    out, before = {}, None
    for w in sorted(pdf.w.unique()):
        x = pdf.loc[pdf.w == w, COLS].to_numpy(dtype=float)
        if before is not None:
            mean, std = before.mean(axis=0), before.std(axis=0)
            a, b = ((v - mean) / np.where(std == 0, 1.0, std) for v in (before, x))
            out[w] = np.mean([np_w1(a @ d, b @ d) for d in wasserstein.directions(n_projections, 3, 42)])
        before = x
    return out


@pytest.mark.parametrize("most, chunk", [(4_000_000, 262_144), (40, 7), (10_000, 1)])
def test_windows_with_ties_and_odd_sizes(spark, monkeypatch, most, chunk):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"id": np.arange(3000) // 2, "w": rng.choice([-2, 0, 1, 7], 3000), "x": rng.standard_normal(3000).round(1),
                        "y": np.where(rng.random(3000) < 0.6, 4.0, rng.exponential(2, 3000)), "z": 3.0})
    pdf = pd.concat([pdf, pd.DataFrame({"id": [9000], "w": [9], "x": [1.0], "y": [2.0], "z": [4.0]})])
    monkeypatch.setattr(wasserstein, "OPEN_VALUES", chunk)
    monkeypatch.setattr(wasserstein, "CELLS_AT_ONCE", 16)
    monkeypatch.setattr("driftspark.operators.drift.MOST_CELLS", most)
    got = {r.w: r.swd for r in swd_by_window(spark.createDataFrame(pdf), "w", COLS, ["id"], 5).collect()}
    want = np_by_window(pdf, 5)
    assert set(got) == set(want) == {0, 1, 7, 9} and all(abs(got[w] - want[w]) < 1e-9 for w in want)


def test_windows_move_few_rows(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame(rng.standard_normal((30_000, 3)), columns=COLS).assign(id=np.arange(30_000), w=np.arange(30_000) % 3)
    pdf["x"] += 0.2 * pdf.w
    monkeypatch.setattr(wasserstein, "new_path", lambda _, name: f"{tmp_path}/{name}")
    got = {r.w: r.swd for r in swd_by_window(spark.createDataFrame(pdf), "w", COLS, ["id"], 4).collect()}
    want = np_by_window(pdf, 4)
    assert all(abs(got[w] - want[w]) < 1e-9 for w in want)
    cells = spark.read.parquet(f"{tmp_path}/cells").selectExpr("sum(octet_length(cells)) / 8").first()[0]
    assert 0 < cells < 0.25 * 2 * 4 * 4 * np.sqrt(20_000)


def test_one_window_or_none(spark):
    df = spark.createDataFrame([(1, 1, 1.0, 2.0, 3.0), (2, 1, 2.0, 2.0, None)], "id long, w long, x double, y double, z double")
    assert swd_by_window(df, "w", COLS, ["id"], 3).collect() == swd_by_window(df.limit(0), "w", COLS, ["id"], 3).collect() == []
