"""Streams: equal to batch, and nothing twice after a restart."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftspark.operators.drift import DriftTest, Learning, Roles
from driftspark.streaming import ingest
from driftspark.streaming.monitor import DriftMonitor

MESSAGE = "id long, v double"


def batch(spark, path, lo, hi, shift=0.0):
    df = spark.range(lo, hi).select("id", (F.sin("id") + shift).alias("v"),
                                    (F.cos(F.col("id") * 3) + shift).alias("w"),
                                    (F.sin("id") > 0.2).cast("int").alias("label"))
    df.coalesce(1).write.mode("append").parquet(path)
    return df.schema


def test_restart_adds_nothing(spark, tmp_path):
    src, out, state = (f"{tmp_path}/{n}" for n in ("src", "out", "state"))
    schema = batch(spark, src, 0, 100)

    def run():
        stream = ingest.file_source(spark, src, schema, files_per_trigger=1)
        messages = ingest.to_messages(stream, ["id", "v"])
        q = ingest.json_sink(ingest.decode_json(messages, MESSAGE), out, state, once=True)
        q.awaitTermination()
        return spark.read.schema(MESSAGE).json(out)

    assert run().count() == 100
    assert run().count() == 100
    batch(spark, src, 100, 150)
    again = run()
    assert again.count() == 150 and again.select("id").distinct().count() == 150


def test_console_and_progress(spark, tmp_path):
    schema = batch(spark, f"{tmp_path}/src", 0, 30)
    q = ingest.console_sink(ingest.every_nth(ingest.file_source(spark, f"{tmp_path}/src", schema), "id", 10), once=True)
    q.awaitTermination()
    batch(spark, f"{tmp_path}/src", 30, 50)
    source = ingest.file_source(spark, f"{tmp_path}/src", schema, files_per_trigger=1)
    ingest.count_batches(source, f"{tmp_path}/counts", f"{tmp_path}/state", once=True).awaitTermination()
    rows = ingest.progress(spark, f"{tmp_path}/counts").orderBy("batch").collect()
    assert len(rows) > 1 and [r.total for r in rows] == list(np.cumsum([r.rows for r in rows])) and rows[-1].total == 50


def test_published_stream(spark, tmp_path):
    schema = batch(spark, f"{tmp_path}/src", 0, 40)
    m = ingest.to_messages(ingest.file_source(spark, f"{tmp_path}/src", schema), ["id", "v"])
    ingest.publish(m, f"{tmp_path}/out", checkpointLocation=f"{tmp_path}/state").awaitTermination()
    assert ingest.decode_json(spark.read.text(f"{tmp_path}/out"), MESSAGE).where("id is not null").count() == 40


def test_closed_windows_of_a_stream_equal_batch(spark, tmp_path):
    df = spark.range(600).select(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 7).alias("ts"),
                                 (F.col("id") % 13).cast("double").alias("v"))
    df.coalesce(1).write.parquet(f"{tmp_path}/src")
    stream = ingest.window_stats(ingest.file_source(spark, f"{tmp_path}/src", df.schema), "ts", "v")
    q = (stream.writeStream.outputMode("append").format("parquet").trigger(availableNow=True)
         .option("checkpointLocation", f"{tmp_path}/state").start(f"{tmp_path}/out"))
    q.awaitTermination()
    def rows(d):
        return {(r.window_start, r.n, round(r.mean, 9), round(r.std, 9)) for r in d.collect()}

    got, want = rows(spark.read.parquet(f"{tmp_path}/out")), rows(ingest.window_stats(df, "ts", "v"))
    assert got and got <= want and len(got) >= len(want) - 3


def test_monitor(spark, tmp_path):
    src = f"{tmp_path}/src"
    for lo, shift in ((0, 0.0), (400, 0.0), (800, 3.0)):
        schema = batch(spark, src, lo, lo + 400, shift)
        monitor = DriftMonitor(spark, f"{tmp_path}/mon", Roles(["v", "w"], ["id"]), DriftTest(n_projections=4, n_permutations=39),
                               Learning(["dt"]))
        stream = ingest.file_source(spark, src, schema, files_per_trigger=1)
        monitor.start(stream, f"{tmp_path}/state", once=True).awaitTermination()
    rows = monitor.results().collect()
    assert [(r.batch, r.n, r.retrained, r.drift) for r in rows] == [
        (0, 400, True, False), (1, 400, False, False), (2, 400, True, True)]
    # a replayed batch changes nothing
    monitor.handle(spark.read.parquet(src), 2)
    assert monitor.results().collect() == rows
    assert rows[0].auc is None and rows[1].auc is not None and rows[2].auc is not None
    assert monitor.scores().where("window = 2").count() == 400
    weights = [r.weight for r in monitor.members().orderBy("window_idx").collect()]
    assert weights == pytest.approx([1 / 3, 2 / 3])
    scored = monitor.predict(spark.read.parquet(src))
    assert scored.where("ensemble_score between 0 and 1").count() == 1200
