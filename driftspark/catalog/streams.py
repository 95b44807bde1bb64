"""Streams over the given files, each run once to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftspark.catalog.base import query, rounded, table
from driftspark.operators.drift import DriftTest, Learning, Roles
from driftspark.plans.workdir import new_path
from driftspark.streaming import ingest
from driftspark.streaming.messages import MessageLog
from driftspark.streaming.monitor import DriftMonitor

MESSAGE = "event_id long, user_id long, value double"


@query("json_parse", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_parse(spark, d):
    return ingest.decode_json(table(spark, d, "events"), "k long", "props", ["event_id"])


@query("every_nth", "SELECT event_id, value FROM events WHERE event_id % 10 = 9")
def every_nth(spark, d):
    return ingest.every_nth(table(spark, d, "events"), "event_id", 10).select("event_id", "value")


def _lines(spark, d):
    """CSV lines; some are too short, some hold a word, some a number with a
    type letter, which is none, and some NaN, which is one."""
    e = table(spark, d, "events")
    i = F.col("event_id")
    good = F.concat_ws(",", i.cast("string"), F.col("user_id").cast("string"), F.col("value").cast("string"))
    return e.select(i.alias("pos"), F.when(i % 11 == 3, F.concat_ws(",", i.cast("string"), F.lit("1")))
                    .when(i % 13 == 5, F.concat_ws(",", i.cast("string"), F.lit("none"), F.lit("2.5")))
                    .when(i % 17 == 7, F.concat_ws(",", i.cast("string"), F.lit("1d"), F.lit("2.5")))
                    .when(i % 19 == 4, F.concat_ws(",", i.cast("string"), F.col("user_id").cast("string"), F.lit("NaN")))
                    .otherwise(good).alias("value"))


_GOOD = """SELECT event_id, user_id, CASE WHEN event_id % 19 <> 4 THEN value END AS value, event_id % 19 = 4 AS not_a_number FROM events
  WHERE NOT (event_id % 11 = 3) AND NOT (event_id % 13 = 5) AND NOT (event_id % 17 = 7)"""


@query("publish_rows", f"SELECT event_id::DOUBLE AS event_id, user_id::DOUBLE AS user_id, value, not_a_number FROM ({_GOOD})")
def publish_rows(spark, d):
    """Lines -> valid rows -> messages -> files -> rows again."""
    names = ["event_id", "user_id", "value"]
    path = new_path(spark, "messages")
    ingest.publish(ingest.to_messages(ingest.parse_rows(_lines(spark, d), names), names), path)
    rows = ingest.decode_json(spark.read.text(path), "event_id double, user_id double, value double")
    return rows.select("event_id", "user_id", F.nanvl("value", F.lit(None)).alias("value"), F.isnan("value").alias("not_a_number"))


_SIZED = """WITH m AS (SELECT event_id, '{"event_id":' || event_id || ',"user_id":' || user_id || '}' AS j FROM events),
  s AS (SELECT event_id, coalesce(sum(octet_length(j::BLOB)) OVER (ORDER BY event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS bytes_before FROM m)"""


@query("publish_bytes", _SIZED + " SELECT event_id, bytes_before FROM s WHERE bytes_before < 100000")
def publish_bytes(spark, d):
    m = ingest.to_messages(table(spark, d, "events"), ["event_id", "user_id"], ["event_id"])
    return ingest.within_bytes(m, "event_id", 100_000).select("event_id", "bytes_before")


@query("stream_json_files", "SELECT event_id, user_id, value FROM events")
def stream_json_files(spark, d):
    """File stream -> messages -> JSON files with a checkpoint -> rows."""
    schema = table(spark, d, "events").schema
    src = ingest.file_source(spark, d, schema, glob="events.parquet")
    messages = ingest.to_messages(src, ["event_id", "user_id", "value"])
    path, state = new_path(spark, "stream-json"), new_path(spark, "stream-state")
    q = ingest.json_sink(ingest.decode_json(messages, MESSAGE), path, state, once=True)
    q.awaitTermination()
    return spark.read.schema(MESSAGE).json(path)


@query("message_log", """
  WITH m AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS "offset" FROM events)
  SELECT "offset", event_id, user_id, value FROM m WHERE "offset" % 10 = 9""")
def message_log(spark, d):
    """Events as messages of a log, published in two halves; a stream takes
    every tenth offset of the first, stops, and goes on from its checkpoint
    when the second is there."""
    spark.dataSource.register(MessageLog)
    e = table(spark, d, "events")
    middle = e.agg(F.percentile_approx("event_id", 0.5)).first()[0]
    log, path, state = new_path(spark, "log"), new_path(spark, "log-out"), new_path(spark, "stream-state")
    for half in (F.col("event_id") <= middle, F.col("event_id") > middle):
        (ingest.to_messages(e.where(half).orderBy("event_id"), ["event_id", "user_id", "value"])
         .write.format("message_log").mode("append").save(log))
        taken = ingest.every_nth(spark.readStream.format("message_log").load(log), "offset", 10)
        ingest.json_sink(ingest.decode_json(taken, MESSAGE, keep=["offset"]), path, state, once=True).awaitTermination()
    return spark.read.schema(f"offset long, {MESSAGE}").json(path)


@query("window_stats", """
  SELECT epoch_us(time_bucket(INTERVAL '10 minutes', ts, TIMESTAMP '2024-01-01')) // 1000000 AS start_s, event_type, count(*) AS n,
    round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY 1, 2""")
def window_stats(spark, d):
    s = ingest.window_stats(table(spark, d, "events"), "ts", "value", by=["event_type"])
    return rounded(s, "mean", "std").select(F.unix_timestamp("window_start").alias("start_s"), "event_type", "n", "mean", "std")


@query("sliding_stats", """
  WITH w AS (SELECT epoch_us(ts) // 1000000 AS s, value FROM events),
  x AS (SELECT (s // 1800) * 1800 - 1800 * k AS start_s, value FROM w, (SELECT unnest([0, 1]) AS k))
  SELECT start_s, count(*) AS n, round(avg(value), 6) AS mean FROM x GROUP BY 1""")
def sliding_stats(spark, d):
    s = ingest.window_stats(table(spark, d, "events"), "ts", "value", "1 hour", "30 minutes")
    return rounded(s, "mean").select(F.unix_timestamp("window_start").alias("start_s"), "n", "mean")


@query("session_stats", """
  WITH g AS (SELECT user_id, ts, value, CASE WHEN ts >= lag(ts) OVER w + INTERVAL '6 hours' OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new
             FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g)
  SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n, round(avg(value), 6) AS mean FROM s GROUP BY user_id, sid""")
def session_stats(spark, d):
    s = ingest.session_stats(table(spark, d, "events"), "ts", "value", "6 hours", ["user_id"])
    return rounded(s, "mean").select("user_id", F.unix_micros("session_start").alias("start_us"), "n", "mean")


@query("stream_window_stats", """
  SELECT epoch_us(time_bucket(INTERVAL '1 day', ts, TIMESTAMP '2024-01-01')) // 1000000 AS start_s, count(*) AS n,
    round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY 1""")
def stream_window_stats(spark, d):
    """The streaming form, complete mode, kept as a table by batch."""
    src = ingest.file_source(spark, d, table(spark, d, "events").schema, glob="events.parquet")
    path = new_path(spark, "stream-stats")
    stats = ingest.window_stats(src, "ts", "value", "1 day")
    q = (stats.writeStream.outputMode("complete").trigger(availableNow=True)
         .option("checkpointLocation", new_path(spark, "stream-state"))
         .foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start())
    q.awaitTermination()
    return rounded(spark.read.parquet(path), "mean", "std").select(
        F.unix_timestamp("window_start").alias("start_s"), "n", "mean", "std")


@query("drift_monitor", "SELECT count(*) AS n_rows, true AS first_trains, true AS finds_drift, true AS weights_sum FROM events")
def drift_monitor(spark, d):
    """Micro-batches of events through sampling, test and retraining."""
    path = new_path(spark, "monitor-in")
    e = table(spark, d, "events").select(
        "event_id", F.col("user_id").cast("double").alias("user_id"), "value",
        (F.col("event_type") == "error").cast("int").alias("label"), F.dayofmonth("ts").alias("day"))
    e = e.withColumn("value", F.when(F.col("day") > 20, F.col("value") + 50).otherwise(F.col("value")))
    # three files, one per ten days
    e = e.withColumn("part", F.floor((F.col("day") - 1) / 10))
    e.repartitionByRange(3, "part").sortWithinPartitions("event_id").write.partitionBy("part").parquet(path)
    schema = e.drop("part").schema
    src = ingest.file_source(spark, f"{path}/*", schema, files_per_trigger=1)
    m = DriftMonitor(spark, new_path(spark, "monitor"), Roles(["value", "user_id"], ["event_id"]),
                     DriftTest(n_projections=5, n_permutations=39), Learning(["dt", "lr"]))
    m.start(src, new_path(spark, "stream-state"), once=True).awaitTermination()
    one = m.members().agg(F.abs(F.sum("weight") - 1) < 1e-12).first()[0]
    r = m.results()
    return r.agg(F.sum("n").alias("n_rows"), F.bool_or((F.col("batch") == 0) & F.col("retrained")).alias("first_trains"),
                 F.bool_or("drift").alias("finds_drift"), F.lit(one).alias("weights_sum"))
