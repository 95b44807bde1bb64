"""Tidying, metrics, ensemble tables, files, generators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftspark.functions.schemas import FLOW_FEATURES, PHYSICS_SCHEMA
from driftspark.operators import ensemble, extra, metrics, tidy, windows
from driftspark.sources import files, generators
from driftspark.streaming import ingest


def test_prepare_flows(spark):
    cols = ["Label", "Attack", "Dataset", "IPV4_SRC_ADDR", "IPV4_DST_ADDR", "IN_BYTES", "PROTOCOL"]
    raw = spark.createDataFrame(
        [("1", "dos", "a", "192.168.1.42", "10.0.0.1", "17", "6"), ("0", "none", "b", "1.2", "x.y.z.w", "?", None)], cols)
    got = [r.asDict() for r in tidy.prepare_flows(raw).orderBy("Dataset").collect()]
    assert got == [
        {"label": 1, "src_subnet": 192 * 65536 + 168 * 256 + 1, "dst_subnet": 655360, "IN_BYTES": 17.0, "PROTOCOL": 6.0, "Dataset": "a"},
        {"label": 0, "src_subnet": None, "dst_subnet": None, "IN_BYTES": None, "PROTOCOL": None, "Dataset": "b"}]
    text = tidy.prepare_flows(raw.withColumn("Label", F.lit("BENIGN")), text_label=True, keep=())
    assert {r.label for r in text.collect()} == {0} and "Dataset" not in text.columns
    assert len(FLOW_FEATURES) == 41 and len(PHYSICS_SCHEMA) == 29


def test_complete_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 1.0), (float("nan"), 1.0)], "a double, b double")
    assert tidy.complete_rows(df, ["a", "b"]).count() == 1
    with pytest.raises(ValueError):
        tidy.complete_rows(df, [])


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 500)
    s = np.round(np.clip(0.3 * y + rng.random(500) * 0.7, 0, 1), 2)
    return y, s, spark.createDataFrame([(int(a), float(b), float(b >= 0.5)) for a, b in zip(y, s)],
                                       "label int, score double, prediction double").cache()


def test_auc_and_roc(scored):
    y, s, df = scored
    pos, neg = s[y == 1], s[y == 0]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert metrics.auc(df).first().auc == pytest.approx(want)
    pts = sorted((r.fpr, r.tpr) for r in metrics.roc_points(df).collect())
    x, t = np.array([(0, 0), *pts]).T
    assert np.trapezoid(t, x) == pytest.approx(want)
    assert metrics.auc(df.where("label = 1")).first().auc is None


def spark_rows(df):
    """Scored rows with further classes and a missing label."""
    cols = {f.name: f.dataType for f in df.schema}
    more = df.sparkSession.createDataFrame([(2.0, 0.0), (None, 3.0)], "label double, prediction double")
    return df.select("label", "prediction").unionByName(more.select(*[more[c].cast(cols[c]).alias(c) for c in ("label", "prediction")]))


def test_f1_accuracy_confusion(scored):
    y, s, df = scored
    p = (s >= 0.5).astype(int)
    f1 = 0.0
    for c in (0, 1):
        tp = ((y == c) & (p == c)).sum()
        f1 += (y == c).mean() * 2 * tp / ((y == c).sum() + (p == c).sum())
    assert metrics.weighted_f1(df).first().f1 == pytest.approx(f1)
    assert metrics.accuracy(df).first().accuracy == pytest.approx((p == y).mean())
    grid = {(r.label, r.prediction): r.cnt for r in metrics.confusion(df).collect()}
    assert grid == {(a, b): int(((y == a) & (p == b)).sum()) for a in (0, 1) for b in (0, 1)}
    assert metrics.confusion(df.limit(0)).count() == 4
    odd = spark_rows(df)
    more = {(r.label, r.prediction): r.cnt for r in metrics.confusion(odd).collect()}
    assert sum(more.values()) == odd.count() and more[2, 0] == 1 and more[None, 3] == 1 and (3, 3) in more


def test_histogram(scored, spark):
    y, s, df = scored
    got = {(r.label, r.bin): r.cnt for r in metrics.histogram(df, "score", 30, ["label"]).collect()}
    for c in (0, 1):
        v = s[y == c]
        b = np.minimum((((v - v.min()) / (v.max() - v.min())) * 30).astype(int), 29)
        assert {k: n for (lab, k), n in got.items() if lab == c} == dict(zip(*np.unique(b, return_counts=True)))
    one = metrics.histogram(spark.range(5).selectExpr("1D AS v"), "v", 30).collect()
    assert [(r.bin, r.cnt) for r in one] == [(15, 5)]


def test_ensemble_tables(spark):
    m = spark.createDataFrame([(f"m{i}", t, i) for i, t in enumerate(["dt", "rf", "gbt", "lr", "dt", "dt", "rf"])],
                              "model_id string, model_type string, window_idx int")
    w = [r.weight for r in ensemble.recency_weights(ensemble.evict(m, 5)).orderBy("window_idx").collect()]
    assert sum(w) == pytest.approx(1) and w == sorted(w) and w[-1] == pytest.approx(16 / 31)
    alive = ensemble.ensemble_by_window(m, 8, 3)
    sizes = {r["window"]: r["count"] for r in alive.groupBy("window").count().collect()}
    assert sizes == {0: 1, 1: 2, **{i: 3 for i in range(2, 9)}}
    table = ensemble.composition(alive).collect()
    assert all(sum(r[t] for t in ensemble.MODEL_TYPES) == pytest.approx(1) for r in table)
    votes = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (2, 1), (2, 0)], "k int, prediction int")
    assert {r.k: r.vote for r in ensemble.majority_vote(votes, ["k"]).collect()} == {1: 0, 2: 1}


def test_best_keeps_the_first_of_equals(spark):
    m = spark.createDataFrame([("a", 0.5, 0), ("b", 0.7, 1), ("c", 0.7, 2)], "id string, auc double, pos int")
    assert ensemble.best_by(m, "auc", "pos").first().id == "b"


def test_windows_on_disk(spark, tmp_path):
    df = spark.range(1000).select("id")
    w = windows.split_windows(df, ["id"], 4)
    files.write_windows(w, f"{tmp_path}/w", ["id"])
    files.write_manifest(f"{tmp_path}/w", spark.read.parquet(f"{tmp_path}/w"), f"{tmp_path}/m")
    listed = files.read_manifest(spark, f"{tmp_path}/m").collect()
    assert [r.window_idx for r in listed] == [0, 1, 2, 3]
    assert sum(spark.read.parquet(r.path).count() for r in listed) == 1000
    assert len(list((tmp_path / "w" / "window_id=0").glob("*.parquet"))) <= 8
    sizes = files.file_sizes(spark, f"{tmp_path}/w", "*.parquet").collect()
    assert sum(r.bytes for r in sizes if r.file) == next(r.bytes for r in sizes if r.file is None)


def test_file_windows_follow_path_order(spark, tmp_path):
    for i, name in enumerate(["b", "a", "c"]):
        spark.range(i + 1).coalesce(1).write.parquet(f"{tmp_path}/d/{name}.parquet")
    got = {r.window_id: r["count"] for r in files.file_windows(spark, f"{tmp_path}/d/*").groupBy("window_id").count().collect()}
    assert got == {0: 2, 1: 1, 2: 3}
    with pytest.raises(ValueError):
        files.listed_windows(spark, [])
    with pytest.raises(ValueError):
        files.read_any(spark, str(tmp_path), "odd")


def test_value_helpers(spark):
    df = spark.createDataFrame([(0.5,), (2.5,)], "v double")
    got = extra.range_partition(df.withColumn("k", F.col("v") * 10), "k", 10).orderBy("v").collect()
    assert [r.part for r in got] == [0, 2]


def test_sensor_hour(spark):
    df = generators.sensor_hour(spark, seed=1).cache()
    stats = df.groupBy("machine_id").agg(F.count("*").alias("n"), F.min("timestamp").alias("a"), F.max("timestamp").alias("b"))
    rows = stats.collect()
    assert len(rows) == 5 and all(3600 / 14 - 2 < r.n < 3600 / 5 for r in rows)
    assert all((r.b - r.a).total_seconds() < 3600 for r in rows)
    share = df.agg(F.avg("anomaly")).first()[0]
    assert 0.07 < share < 0.13
    seq = df.where("machine_id = 0").orderBy("timestamp").collect()
    for prev, cur in zip(seq, seq[1:]):
        assert 5 <= (cur.timestamp - prev.timestamp).total_seconds() <= 14
        if cur.anomaly_type == "stuck":
            assert cur.vibration == prev.vibration
    assert df.exceptAll(generators.sensor_hour(spark, seed=1)).count() == 0


def test_sensor_ten_minutes(spark):
    df = generators.sensor_ten_minutes(spark, 20_000)
    r = df.agg(F.count("*").alias("n"), F.avg("anomaly").alias("a"), F.stddev("humidity").alias("s"),
               (F.unix_micros(F.max("timestamp")) - F.unix_micros(F.min("timestamp"))).alias("span")).first()
    assert r.n == 20_000 and 0.09 < r.a < 0.11 and r.span < 600_000_000 and r.s > 0.4


def test_publishing(spark, tmp_path):
    lines = spark.createDataFrame([(0, "1,2.5,3"), (1, "1,2"), (2, "1,x,3"), (3, "4,5e1,6"), (4, "1d,2,3"), (5, "1, 2 ,"),
                                   (6, "7,nan,8")], "pos int, value string")
    rows = ingest.parse_rows(lines, ["label", "x1", "x2"], keep=["pos"])
    assert repr([tuple(r) for r in rows.orderBy("pos").collect()]) == repr(
        [(0, 1.0, 2.5, 3.0), (3, 4.0, 50.0, 6.0), (6, 7.0, float("nan"), 8.0)])
    assert ingest.parse_rows(lines, ["label", "x1", "x2"]).count() == 3
    rows = rows.where("pos < 6")
    m = ingest.to_messages(rows, ["label", "x1", "x2"], ["pos"])
    size = len('{"label":1.0,"x1":2.5,"x2":3.0}')
    assert ingest.within_bytes(m, "pos", size).count() == 1
    assert ingest.within_bytes(m, "pos", size + 1).count() == 2
    assert ingest.within_bytes(m, "pos", 10 * size, repeat=True).count() == 10
    assert ingest.kafka_options("h:1", "t") == {
        "kafka.bootstrap.servers": "h:1", "subscribe": "t", "startingOffsets": "earliest"}
    bad = spark.createDataFrame([(b'{"label": 1.0, "x1": 2}',), (b"no json",)], "value binary")
    got = ingest.decode_json(bad, "label double, x1 double").collect()
    assert [tuple(r) for r in got] == [(1.0, 2.0), (None, None)]
