"""Distances of stored sketches against NumPy on the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftspark.operators import sketches as sk


def np_ks(a, b):
    at = np.unique(np.concatenate([a, b]))
    return np.abs(np.searchsorted(np.sort(a), at, "right") / len(a) - np.searchsorted(np.sort(b), at, "right") / len(b)).max()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Four windows of 20,000 rows that drift, one of them in two parts, a
    feature with nulls and NaN, and a window without values of it."""
    rng = np.random.default_rng(4)
    rows = []
    for w in range(4):
        x = rng.normal(0.2 * w, 1, 20_000)
        y = rng.integers(0, 5, 20_000).astype(float)
        rows += [(w, float(a), None if w == 3 or i % 7 == 0 else float("nan") if i % 7 == 1 else float(b))
                 for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "w int, x double, y double").repartition(7)
    path = f"{tmp_path_factory.mktemp('sketches')}/table"
    for part in ("w < 2", "w = 2 and x < 0", "w = 2 and x >= 0 or w = 3"):
        sk.append_sketches(sk.window_sketches(df.where(part), "w", ["x", "y"]), path)
    pdf = df.toPandas()
    return sk.read_sketches(spark, path), {(w, c): g[c].dropna().to_numpy() for w, g in pdf.groupby("w") for c in ("x", "y")}


@pytest.mark.parametrize("against", ["before", "previous"])
def test_windows_against_earlier_ones(stored, against):
    table, rows = stored
    got = {(r.window, r.feature): r for r in sk.sketch_drift(table, against).collect()}
    assert set(got) == {(w, c) for w in (1, 2, 3) for c in ("x", "y") if len(rows[w, c])}
    for (w, c), r in got.items():
        old = np.concatenate([rows[v, c] for v in (range(w) if against == "before" else [w - 1])])
        assert (r.n, r.n_before) == (len(rows[w, c]), len(old))
        assert abs(r.ks - np_ks(rows[w, c], old)) <= 2 * sk.ks_error()


def test_any_union_of_windows(stored):
    table, rows = stored
    w = F.col("window")
    got = {r.feature: r for r in sk.union_ks(table, w.isin(0, 3), w.isin(1, 2)).collect()}
    for c in ("x", "y"):
        a, b = (np.concatenate([rows[v, c] for v in vs]) for vs in ((0, 3), (1, 2)))
        assert (got[c].n, got[c].n_other) == (len(a), len(b)) and abs(got[c].ks - np_ks(a, b)) <= 2 * sk.ks_error()
    empty = {r.feature: (r.n, r.n_other, r.ks) for r in sk.union_ks(table, w == 3, w == 9).collect()}
    assert empty == {"x": (20_000, 0, None)}
    same = sk.union_ks(table, w == 0, w == 0).collect()
    assert all(r.ks == 0 for r in same)


def test_nothing_to_sketch(spark):
    none = spark.createDataFrame([], "w int, x double")
    assert sk.window_sketches(none, "w", ["x"]).collect() == []
    assert sk.sketch_drift(sk.window_sketches(none, "w", ["x"])).collect() == []
    with pytest.raises(ValueError):
        sk.sketch_drift(none, "next")
