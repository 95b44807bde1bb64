"""Base models, ensembles and the window loop."""

import threading
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from driftspark.operators import drift, learn, metrics, sampling
from driftspark.sources import files

FEATURES, KEY = ["a", "b"], ["id"]


@pytest.fixture(scope="module")
def rows(spark):
    h = lambda s: F.pmod(F.xxhash64("id", F.lit(s)), F.lit(1000)) / 1000.0
    df = spark.range(1200).select("id", h(1).alias("a"), h(2).alias("b"), h(3).alias("n"),
                                  F.floor(F.col("id") / 400).cast("int").alias("window_id"))
    return df.withColumn("label", (F.col("a") + F.col("b") / 2 + F.col("n") / 4 > 0.9).cast("int")).cache()


@pytest.fixture(scope="module")
def fitted(rows):
    train, valid = sampling.split(rows, KEY)
    return learn.fit_all(train, valid, FEATURES, "label", types=["dt", "lr"])


def test_hyperparameters(spark):
    p = learn.build_model(FEATURES, "label", "gbt", model_set="notebook", scale="std").getStages()
    assert p[-1].getMaxIter() == 50 and p[-1].getMinInstancesPerNode() == 500 and not p[1].getWithMean()
    rf = learn.build_model(FEATURES, "label", "rf").getStages()[-1]
    assert (rf.getNumTrees(), rf.getMaxDepth(), rf.getSeed()) == (50, 10, 42)
    assert len(learn.build_model(FEATURES, "label", "lr", scale="none").getStages()) == 2
    for bad in (dict(model_type="svm"), dict(scale="odd"), dict(features=[])):
        with pytest.raises(ValueError):
            learn.build_model(**{"features": FEATURES, "label": "label", **bad})


def test_best_model(spark, fitted):
    best = learn.best_of(fitted)
    assert best.auc == max(f.auc for f in fitted) > 0.8
    assert learn.pick_best(learn.metrics_table(spark, fitted)).first().model_type == best.model_type


def test_chained_scores_equal_joined_scores(rows, fitted):
    members = [(f.model, w) for f, w in zip(fitted, (1 / 3, 2 / 3))]
    chained = learn.ensemble_predict(rows, members)
    assert chained.columns == [*rows.columns, "ensemble_score", "ensemble_prediction"]
    # row-local: no shuffle and no join in the plan
    plan = chained._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    parts = [learn.model_scores(rows, KEY, f.model, f"p{i}") for i, f in enumerate(fitted)]
    joined = learn.ensemble_by_join(rows.select("id"), KEY, parts, ["p0", "p1"], [1 / 3, 2 / 3], merge=True)
    off = chained.join(joined.select("id", F.col("ensemble_score").alias("other")), "id").where(
        F.abs(F.col("ensemble_score") - F.col("other")) > 1e-12)
    assert joined.count() == 1200 and off.count() == 0
    with pytest.raises(RuntimeError):
        learn.ensemble_predict(rows, [])


def test_evaluation_equals_frame_metrics(rows, fitted):
    members = [(fitted[1].model, 1.0)]
    got = learn.evaluate_ensemble(rows, members, "label")
    scored = learn.ensemble_predict(rows, members)
    assert got["accuracy"] == pytest.approx(metrics.accuracy(scored, "label", "ensemble_prediction").first()[0])
    assert got["f1"] == pytest.approx(metrics.weighted_f1(scored, "label", "ensemble_prediction").first()[0])
    assert got["auc"] == pytest.approx(metrics.auc(scored, "label", "ensemble_score").first()[0], abs=2e-3)


def test_save_and_rescore(rows, fitted, tmp_path):
    learn.save_model(fitted[0].model, f"{tmp_path}/dt")
    r = learn.rescore_saved({"dt": f"{tmp_path}/dt"}, {"all": rows}, "label").first()
    assert r.auc > 0.8


def test_training_comparison(rows):
    t = learn.compare_training(rows, sampling.sample_rows(rows, KEY, 300), FEATURES, "label", KEY, types=["lr"])
    assert {r.training_data for r in t.collect()} == {"full", "sample"} and t.agg(F.min("auc")).first()[0] > 0.8


def test_block_trees_query_trains_on_all_rows(spark, sf, monkeypatch):
    from driftspark.catalog import models

    monkeypatch.setattr(models.learn, "block_trees", lambda blocks, check, f, label, key, ids: (blocks, check, list(ids)))
    blocks, check, ids = models.block_trees(spark, sf)
    assert blocks.where(F.col("block_id").isin(ids)).count() == blocks.count() > 0
    assert blocks.count() + check.count() == models.orders(spark, sf).count()


def test_block_trees_and_clusters(rows):
    votes = learn.block_trees(sampling.assign_blocks(rows, KEY, 3), rows, FEATURES, "label", KEY, [0, 1, 2])
    assert votes.count() == 1200 and metrics.accuracy(votes, "label", "vote").first()[0] > 0.8
    assert learn.cluster(rows, FEATURES, 3)[1].agg(F.sum("size")).first()[0] == 1200


@pytest.mark.parametrize("when", ["before", "after"])
def test_window_loop(spark, rows, tmp_path, when):
    moved = rows.withColumn("a", F.when(F.col("window_id") == 2, F.col("a") + 2).otherwise(F.col("a")))
    folder = f"{tmp_path}/loop"
    setup = (spark, drift.Roles(FEATURES, KEY), drift.DriftTest(0.01, 4, 199), drift.Learning(["dt"], keep=1, static=when == "after"))
    # a run that was cut off after the first window goes on in a new session
    drift.WindowLoop(*setup, folder=folder).run(moved.where("window_id = 0"), when)
    loop = drift.WindowLoop(*setup, folder=folder)
    log = loop.run(moved, when).collect()
    assert [(r.window, r.retrained, r.drift) for r in log] == [(0, True, False), (1, False, False), (2, True, True)]
    assert (log[0].auc is None) == (when == "before") and log[1].auc > 0.7
    assert all(r.w_dt == pytest.approx(1.0) for r in log)
    assert (log[1].static_accuracy is None) == (when == "before")
    assert [m["window"] for m in loop._entry(2)["members"]] == [2]  # the older one was evicted
    assert loop.scores().count() == (800 if when == "before" else 1200)
    assert loop.predict(rows).where("ensemble_score between 0 and 1").count() == 1200
    assert {w.name for w in (tmp_path / "loop" / "samples").glob("window=*")} == {"window=0", "window=2"}


class CountingLoop(drift.WindowLoop):
    """Only counts the rows of a window: how windows are read, without tests and fits."""

    def _step(self, df, n, window, last, when):
        row = dict.fromkeys([c.split()[0] for c in drift.LOG.split(", members")[0].split(", ")])
        return row | {"window": window, "n": n, "members": []}


def test_loop_reads_its_table_a_fixed_number_of_times(spark, rows, tmp_path):
    """The rows are read as often for many windows as for few, and each step
    filters on the folder of its window."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    seen = []
    for n in (2, 6):
        table = rows.withColumn("window_id", F.pmod("id", F.lit(n)).cast("int")).mapInPandas(counted, rows.schema)
        loop = CountingLoop(spark, drift.Roles(FEATURES, KEY), folder=f"{tmp_path}/{n}")
        before = read.value
        log = loop.run(table).collect()
        seen.append(read.value - before)
        assert [(r.window, r.n) for r in log] == [(i, 1200 // n) for i in range(n)]
        assert not (tmp_path / str(n) / "windows").exists()
    assert seen[0] == seen[1] <= 2 * 1200

    files.write_windows(rows, f"{tmp_path}/w", KEY)
    loop = CountingLoop(spark, drift.Roles(FEATURES, KEY), folder=f"{tmp_path}/l")
    plan = loop.stored(f"{tmp_path}/w", rows, 1)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(window_id" in plan and plan.rstrip().count("(window_id") >= 2
    assert [r.n for r in loop.run_stored(f"{tmp_path}/w", rows).collect()] == [400, 400, 400]
    assert files.window_folders(spark, f"{tmp_path}/w") == [0, 1, 2]
    assert loop.run(rows).count() == 3 and loop.run(rows.limit(0)).count() == 3  # all in the log
    with pytest.raises(ValueError):
        loop.run(rows, "never")


class MeetingLoop(CountingLoop):
    """Window 4 drifts; a window waits for the others that are looked at with it."""

    def __init__(self, *args, **kw):
        super().__init__(*args, **kw)
        self.at_once, self.most, self.looked, self.lock = 0, 0, [], threading.Lock()

    def _step(self, df, n, window, last, when):
        with self.lock:
            self.at_once += 1
            self.most = max(self.most, self.at_once)
            self.looked.append((window, last["window"] if last else None))
        time.sleep(1)
        with self.lock:
            self.at_once -= 1
        return super()._step(df, n, window, last, when) | {"retrained": window in (0, 4), "drift": window == 4, "reference": window}

    def _train(self, df, window):
        return Row(window=window, model_type="dt", auc=1.0, f1=1.0)

    def voters(self, members):
        return []


def test_windows_are_looked_at_ahead_of_the_log(spark, rows, tmp_path):
    loop = MeetingLoop(spark, drift.Roles(FEATURES, KEY), folder=f"{tmp_path}/l")
    log = loop.run(rows.withColumn("window_id", F.pmod("id", F.lit(7)).cast("int"))).collect()
    assert [(r.window, r.drift) for r in log] == [(i, i == 4) for i in range(7)]
    assert loop.most > 1
    # the last look at a window is by the state after the drift before it
    assert all(last >= 4 for w, last in dict(loop.looked).items() if w > 4)
    assert loop._entry(4)["members"][-1]["window"] == 4


def test_a_large_window_is_several_files(spark, tmp_path):
    files.write_windows(spark.range(400_000).withColumn("window_id", F.lit(0)), f"{tmp_path}/w", ["id"])
    assert len(list((tmp_path / "w" / "window_id=0").glob("*.parquet"))) >= 2


def test_fits_run_at_the_same_time(spark, rows, monkeypatch):
    """Each of two fits waits until the other has begun; same figures as one after the other."""
    train, valid = sampling.split(rows, KEY)
    alone = learn.fit_all(train, valid, FEATURES, "label", types=["dt", "lr"], parallel=1)
    meet, build = threading.Barrier(2, timeout=60), learn.build_model

    def built(*args, **kw):
        meet.wait()
        return build(*args, **kw)

    monkeypatch.setattr(learn, "build_model", built)
    both = learn.fit_all(train, valid, FEATURES, "label", types=["dt", "lr"], parallel=2)
    assert [f.model_type for f in both] == ["dt", "lr"] and learn.best_of(both).model_type == learn.best_of(alone).model_type
    for x, y in zip(alone, both):
        assert (y.auc, y.f1, y.accuracy) == pytest.approx((x.auc, x.f1, x.accuracy))


def test_side_by_side_errors(spark):
    begun = []

    def work(i):
        begun.append(i)
        if i == 1:
            raise ValueError("one")
        return spark.range(i).count()

    assert learn.side_by_side(spark, lambda i: spark.range(i).count(), [5, 3, 4], 2) == [5, 3, 4]
    assert learn.side_by_side(spark, work, [], 2) == []
    with pytest.raises(ValueError, match="one"):
        learn.side_by_side(spark, work, [1, *range(2, 40)], 1)
    assert len(begun) < 39


def test_window_tables(spark, rows, tmp_path):
    rows.write.parquet(f"{tmp_path}/t")
    rows.write.option("header", True).csv(f"{tmp_path}/c")
    split = drift.table_windows(spark, f"{tmp_path}/t", KEY, 3)
    assert [df.count() for _, df in drift.windows(split)] == [400, 400, 400]
    schema = "id long, a double, b double, n double, window_id int, label int"
    listed = drift.path_windows(spark, [f"{tmp_path}/c"], {"label": "y"}, file_format="csv", schema=schema)
    assert "y" in listed.columns
    assert drift.directory_windows(spark, f"{tmp_path}/t").count() == 1200
    assert drift.directory_windows(spark, f"{tmp_path}/c", file_format="csv", schema=schema).count() == 1200
    for bad in (lambda: drift.path_windows(spark, []), lambda: drift.table_windows(spark, f"{tmp_path}/t", KEY, 0),
                lambda: drift.Roles([], KEY), lambda: drift.Roles(FEATURES, [])):
        with pytest.raises(ValueError):
            bad()


def test_small_windows_are_tested_in_the_same_jobs(spark, rows, tmp_path, monkeypatch):
    """Four windows after the first, one of them shifted: no job of its own for
    a window, and the distances and samples of the functions for any size."""
    from driftspark.operators.permutation import swd_null

    odd = F.when(F.pmod("id", F.lit(11)) == 3, None).otherwise(F.round("b", 1))
    table = rows.withColumns({"window_id": F.pmod("id", F.lit(5)), "b": odd})
    table = table.withColumn("a", F.when(F.col("window_id") == 2, F.col("a") + 2).otherwise(F.col("a")))
    monkeypatch.setattr(drift.DriftTest, "null", lambda *_: pytest.fail("a window was tested alone"))
    test = drift.DriftTest(0.05, 3, 39)
    loop = drift.WindowLoop(spark, drift.Roles(["a", "b"], KEY, label=None), test, folder=f"{tmp_path}/l")
    log = loop.run(table).collect()
    assert [r.n for r in log] == [240] * 5 and [r.drift for r in log][:3] == [False, False, True]
    one, two = (adaptive(test, table.where(f"window_id = {w}")) for w in (0, 2))
    null = {r.perm: r.swd for r in swd_null(one, two, ["a", "b"], KEY, 3, 39).collect()}
    got = {r.perm: r.swd for r in spark.read.parquet(f"{tmp_path}/l/nulls").where("window = 2").collect()}
    assert set(got) == set(null) and all(abs(got[p] - null[p]) < 1e-9 for p in null)
    assert log[2].swd == pytest.approx(null[0])


def adaptive(test, df):
    return test.sample(df, drift.Roles(["a", "b"], KEY, label=None))


def test_a_sample_in_one_task_is_the_adaptive_sample(spark):
    from driftspark.functions.hashing import hash_key
    from driftspark.operators import small_windows

    for n, spread in ((1, 1.0), (30, 1.0), (700, 1.0), (5000, 0.1)):
        df = spark.range(n).select("id", (F.randn(3) * spread).alias("x"), F.when(F.rand(4) < 0.2, None).otherwise(F.floor(F.rand(5) * 4)).cast("double").alias("y"))
        df = df.withColumn("_h", hash_key(["id"], 42)).localCheckpoint()
        pdf = df.toPandas()
        held = small_windows.sampled(pdf["_h"].to_numpy(), pdf[["x", "y"]].to_numpy(dtype=float).T, 50, 20)
        assert set(pdf["id"][held]) == {r.id for r in sampling.adaptive_sample(df.drop("_h"), ["x", "y"], ["id"]).collect()}, n
