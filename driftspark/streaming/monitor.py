"""Drift monitor on micro-batches: every batch is one window of the loop in
``operators/drift.py``, so a batch that is replayed after a failure finds its
log entry and does nothing, or overwrites its own files only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftspark.operators.drift import DriftTest, Learning, Roles, WindowLoop


class DriftMonitor(WindowLoop):
    """``foreachBatch`` handler: score, sample, test, retrain on drift."""

    def __init__(self, spark: SparkSession, folder: str, roles: Roles, test: DriftTest | None = None,
                 learning: Learning | None = None):
        super().__init__(spark, roles, test, learning, folder)

    def handle(self, df: DataFrame, batch: int) -> None:
        self.step(df, batch)

    def results(self) -> DataFrame:
        """One row per batch that had rows."""
        return self.log().drop("reference", "members").withColumnRenamed("window", "batch")

    def members(self) -> DataFrame:
        """The living ensemble with its weights."""
        done = self.done()
        alive = self._entry(done[-1])["members"] if done else []
        rows = [(f"{m['window']}-{m['model_type']}", m["model_type"], m["window"], m["auc"], m["f1"], w)
                for m, w in zip(alive, self.learning.weights(len(alive)))]
        return self.spark.createDataFrame(
            rows, "model_id string, model_type string, window_idx long, auc double, f1 double, weight double")

    def rows_seen(self) -> int:
        return self.log().agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def start(self, stream: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self.handle).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()
