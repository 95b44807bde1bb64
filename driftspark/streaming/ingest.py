"""Streaming sources, decoding and sinks. Offsets, commits and file-sink
metadata live in the checkpoint folder, so a restart repeats nothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def kafka_options(servers: str, topic: str, starting: str = "earliest") -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting}


def kafka_source(spark: SparkSession, servers: str, topic: str, starting: str = "earliest",
                 **options: str) -> DataFrame:
    """Unbounded Kafka topic. Needs the Kafka connector on the class path."""
    return spark.readStream.format("kafka").options(**kafka_options(servers, topic, starting), **options).load()


def file_source(spark: SparkSession, path: str, schema: StructType, file_format: str = "parquet",
                glob: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """New files of a folder as a stream; ``files_per_trigger`` sets the pace."""
    reader = spark.readStream.schema(schema).format(file_format)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def decode_json(df: DataFrame, schema: StructType | str, value: str = "value",
                keep: Sequence[str] = ()) -> DataFrame:
    """Message bytes or text to typed columns; bad messages give nulls."""
    data = F.from_json(F.col(value).cast("string"), schema)
    return df.select(*keep, data.alias("data")).select(*keep, "data.*")


def json_sink(df: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append JSON files."""
    writer = (df.writeStream.outputMode("append").format("json")
              .option("path", path).option("checkpointLocation", checkpoint))
    return (writer.trigger(availableNow=True) if once else writer).start()


def console_sink(df: DataFrame, once: bool = False) -> StreamingQuery:
    """Print every batch, untruncated."""
    writer = df.writeStream.outputMode("append").format("console").option("truncate", False)
    return (writer.trigger(availableNow=True) if once else writer).start()


def every_nth(df: DataFrame, offset: str, n: int = 10) -> DataFrame:
    """Each ``n``-th message by its offset: a filter, no counter."""
    return df.where(F.pmod(F.col(offset), F.lit(n)) == n - 1)


def count_batches(df: DataFrame, folder: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Writes one row ``(batch, rows)`` per micro-batch to ``folder``. A batch
    that is repeated overwrites its own row."""
    def count(part: DataFrame, batch: int) -> None:
        (part.agg(F.lit(batch).cast("long").alias("batch"), F.count("*").alias("rows"))
         .write.mode("overwrite").parquet(f"{folder.rstrip('/')}/part={batch}"))

    writer = df.writeStream.foreachBatch(count).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def progress(spark: SparkSession, folder: str) -> DataFrame:
    """``(batch, rows, total)``: the running row count over all batches."""
    # one row per batch
    so_far = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    return (spark.read.schema("batch long, rows long").parquet(folder)
            .select("batch", "rows", F.sum("rows").over(so_far).alias("total")))


# ---- publishing -----------------------------------------------------------

NUMBER = r"(?i)^\s*[+-]?(([0-9]+(\.[0-9]*)?|\.[0-9]+)(e[+-]?[0-9]+)?|nan|inf(inity)?)\s*$"


def parse_rows(lines: DataFrame, names: Sequence[str], text: str = "value",
               keep: Sequence[str] = ()) -> DataFrame:
    """Lines of comma-separated numbers to double columns. Lines of another
    width, or with a cell that is no number, are skipped; NaN and infinity are
    numbers."""
    cells = F.split(F.col(text), ",", -1)
    wide = lines.select(*keep, cells.alias("_c")).where(
        (F.size("_c") == len(names)) & F.forall("_c", lambda c: c.rlike(NUMBER)))
    return wide.select(*keep, *[F.get("_c", F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(names)]).where(
        F.forall(F.array(*[F.col(n) for n in names]), lambda x: x.isNotNull()))


def to_messages(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One JSON object per row in ``value``."""
    return df.select(*keep, F.to_json(F.struct(*cols)).alias("value"))


def within_bytes(messages: DataFrame, order: str, target: int, repeat: bool = False) -> DataFrame:
    """Messages up to and including the one that reaches ``target`` bytes, by a
    unique position. ``repeat`` starts over until the target is reached; a
    message then carries the number of its ``round``."""
    from driftspark.operators.extra import running_total

    sized = running_total(messages, order, F.octet_length("value"), "bytes_before")
    if not repeat:
        return sized.where(F.col("bytes_before") < target)
    total = messages.agg(F.sum(F.octet_length("value"))).first()[0] or 0
    if total == 0:
        return sized.where(F.lit(False))
    rounds = -(-target // total)
    return (sized.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
            .withColumn("bytes_before", F.col("bytes_before") + F.col("round") * total)
            .where(F.col("bytes_before") < target))


def publish(messages: DataFrame, target: str, **options: str):
    """Send ``value``: to Kafka (``target="kafka"``) or as text files at a path.
    Streaming frames need ``checkpointLocation``."""
    out = messages.select("value")
    if out.isStreaming:
        writer = out.writeStream.outputMode("append").options(**options).trigger(availableNow=True)
        if target == "kafka":
            return writer.format("kafka").start()
        return writer.format("text").option("path", target).start()
    if target == "kafka":
        return out.write.format("kafka").options(**options).save()
    return out.write.mode("append").text(target, **options)


# ---- event-time windows ---------------------------------------------------

def window_stats(df: DataFrame, ts: str, value: str, length: str = "10 minutes",
                 slide: str | None = None, by: Sequence[str] = (), late: str = "10 minutes") -> DataFrame:
    """Count, mean and deviation per event-time window, batch or stream. Late
    rows are taken until the watermark passes."""
    df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    if df.isStreaming:
        df = df.withWatermark(ts, late)
    return (df.groupBy(F.window(ts, length, slide), *by)
            .agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
            .select(F.col("window.start").alias("window_start"), *by, "n", "mean", "std"))


def session_stats(df: DataFrame, ts: str, value: str, gap: str, by: Sequence[str],
                  late: str = "10 minutes") -> DataFrame:
    """Same per activity session of each ``by`` key."""
    df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    if df.isStreaming:
        df = df.withWatermark(ts, late)
    return (df.groupBy(F.session_window(ts, gap), *by)
            .agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
            .select(F.col("session_window.start").alias("session_start"), *by, "n", "mean"))


def previous_window(stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Shift of the mean against the window before."""
    w = Window.partitionBy(*by).orderBy("window_start")
    shift: Column = F.col("mean") - F.lag("mean").over(w)
    return stats.withColumn("shift", shift)
