"""What must not grow with the rows: plans, task inputs, jobs."""

import numpy as np
import pandas as pd
import pytest

from driftspark.operators import permutation, wasserstein


def sides(spark, n=400, m=60, seed=3):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"value": np.round(rng.normal(size=n + m), 2), "side": [0] * n + [1] * m})
    return spark.createDataFrame(pdf).selectExpr("1 AS g", "cast(floor(value) AS int) AS bucket", "value", "cast(side AS int) AS side")


@pytest.mark.parametrize("method", ["quantile_union", "interp"])
def test_levels_are_not_sent_to_every_task(spark, method):
    """The rows of a table that is small on disk may be many: no join on them is a broadcast."""
    out = wasserstein.w1_of(method)(sides(spark), ["g"])
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 1


def planes(spark, n=600, seed=5):
    """Two sides with a hot value, in two features."""
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"x": np.round(rng.normal(size=n), 3), "y": rng.integers(0, 3, n).astype(float), "side": np.arange(n) % 2, "w": np.arange(n) % 3})
    pdf.loc[: n // 2, ["x", "y"]] = 1.0
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("most", [1_000_000, 20])
def test_packed_values_give_the_exact_distance(spark, monkeypatch, most):
    monkeypatch.setattr(wasserstein, "MOST_ROWS", most)
    pdf, df = planes(spark)
    dirs = wasserstein.directions(3, 2, 1)
    for cuts in ([[0.0]] * 3, [[-0.5, 0.0, 0.25, 1.0]] * 3):
        got = {(r["w"], r["feature_id"]): r["w1"] for r in
               wasserstein.w1_packed(df, ["x", "y"], dirs, cuts, len(pdf), ["w"]).collect()}
        for (w, g), w1 in got.items():
            a, b = (np.sort(pdf[(pdf.w == w) & (pdf.side == s)][["x", "y"]].to_numpy() @ dirs[g]) for s in (0, 1))
            v = np.sort(np.concatenate([a, b]))
            gap = np.abs(np.searchsorted(a, v, "right") / len(a) - np.searchsorted(b, v, "right") / len(b))
            assert w1 == pytest.approx(float(np.sum(gap[:-1] * np.diff(v))), abs=1e-12)
        assert len(got) == 9


def test_a_sliced_distance_makes_no_row_per_value(spark):
    _, df = planes(spark, 60)
    df = df.withColumn("id", df["w"])
    out = wasserstein.swd(df.where("side = 0"), df.where("side = 1"), ["x", "y"], ["id"], n_projections=3)
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [9, 140])
def test_labels_are_read_as_they_were_written(n):
    """As bits of a row, or from its hash numbers where there are many."""
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"_a": rng.integers(0, 2**40, 50), "_b": rng.integers(0, 2**40, 50), "side": rng.integers(0, 2, 50)})
    border = np.array([0, *rng.integers(0, 2**40, n)])
    write, read, width = permutation._tags(border)
    tags = write(pdf)
    assert tags.shape == (50, width) and width <= permutation.HASHES
    for lo, hi in ((0, n + 1), (3, 9), (8, 10)):
        assert (read(tags, lo, hi) == permutation._labels(pdf, border, lo, hi)).all()


def test_a_null_distribution_makes_no_row_per_value(spark):
    _, df = planes(spark, 60)
    df = df.withColumn("id", df["w"])
    out = permutation.swd_null(df.where("side = 0"), df.where("side = 1"), ["x", "y"], ["id"], 3, 5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "named_struct" not in plan and "MapInPandas" in plan
