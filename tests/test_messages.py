"""The message log: offsets, rates, restarts and repeated batches."""

import os

import pytest
from compare import compare
from pyspark.sql import functions as F

from driftspark.catalog import ORACLES, QUERIES
from driftspark.streaming.messages import Folder, MessageLog, Segment


@pytest.fixture
def log(spark, tmp_path):
    spark.dataSource.register(MessageLog)
    return str(tmp_path / "log")


def publish(spark, log, values, tasks=1):
    (spark.createDataFrame([(v,) for v in values], "value string").coalesce(tasks)
     .write.format("message_log").mode("append").save(log))


def read(spark, log):
    return [tuple(r) for r in spark.read.format("message_log").load(log).orderBy("offset").collect()]


def test_offsets_go_on(spark, log):
    assert read(spark, log) == []
    publish(spark, log, ["a", None, "", "a"])
    publish(spark, log, [])
    publish(spark, log, [f"m{i}" for i in range(20_000)], 3)
    want = ["a", None, "", "a", *(f"m{i}" for i in range(20_000))]
    assert read(spark, log) == list(enumerate(want))
    cut = Folder({"path": log})
    assert [(s.base + s.lo, s.base + s.hi) for s in cut.segments(2, 5)][0] == (2, 4)
    assert sum(s.hi - s.lo for s in cut.segments(2, 10_000)) == 9_998
    with pytest.raises(Exception, match="only appended"):
        spark.range(1).selectExpr("'x' AS value").write.format("message_log").mode("overwrite").save(log)


def test_rate_and_restart(spark, log, tmp_path):
    seen = []

    def run(upto):
        q = (spark.readStream.format("message_log").option("per_trigger", 4).option("reader", "r").load(log)
             .writeStream.foreachBatch(lambda df, i: seen.append((i, sorted(r.offset for r in df.collect()))))
             .option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="0 seconds").start())
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        assert sorted(o for _, os_ in seen for o in os_) == list(range(upto))
        assert all(len(os_) <= 4 for _, os_ in seen)

    publish(spark, log, [str(i) for i in range(10)])
    run(10)
    publish(spark, log, [str(i) for i in range(9)])
    run(19)


def test_repeated_batch_adds_nothing(spark, log, tmp_path):
    src, target, state = str(tmp_path / "in"), log, str(tmp_path / "state")

    def run():
        q = (spark.readStream.schema("value string").text(src).writeStream.format("message_log").option("path", target)
             .option("checkpointLocation", state).trigger(availableNow=True).start())
        q.awaitTermination()

    spark.createDataFrame([(f"a{i}",) for i in range(50)], "value string").coalesce(2).write.text(src)
    run()
    before = read(spark, log)
    assert sorted(v for _, v in before) == sorted(f"a{i}" for i in range(50))
    # as if the driver had died between the commit of the batch and Spark's own note of it
    for note in ("0", ".0.crc"):
        os.remove(f"{state}/commits/{note}")
    run()
    assert read(spark, log) == before
    spark.createDataFrame([("b",)], "value string").write.mode("append").text(src)
    run()
    assert read(spark, log) == [*before, (50, "b")]
    folder = Folder({"path": log})
    folder.commit([Segment("none", 0, 0, 0)], "stream", 0)
    assert folder.end() == 51


def test_message_log_query(spark, sf):
    df = QUERIES["message_log"](spark, sf)
    assert compare(df, ORACLES["message_log"], sf) is None
    assert df.agg(F.count("*")).first()[0] == spark.read.parquet(f"{sf}/events.parquet").count() // 10
