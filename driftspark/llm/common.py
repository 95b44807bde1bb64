"""What the operators of this package share.

Operators take a DataFrame and the names of its columns. Columns they do not
use pass through; a column of the input that has the name of a result column
(names compare without case) is replaced by the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftspark.plans.workdir import new_path, remove, work_base

DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SLICE = 512  # rows that are Python objects at one time


def col(name: str):
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def without(df: DataFrame, names) -> list[str]:
    """Columns of ``df`` that no result column replaces."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def add_columns(df: DataFrame, inputs: list[str], fn: Callable, fields: list[T.StructField]) -> DataFrame:
    """``df`` with the columns ``fields``, made from the columns ``inputs``.

    ``fn(*lists)`` gets at most SLICE rows as Python lists and returns one list
    per field. Rows stay in their partition; nothing is shuffled.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    kept = without(df, [f.name for f in fields])
    extra = [c for c in inputs if c not in kept]
    # numbered names on the way: mapInArrow bears no dots or quotes in names
    sent = df.select(*(col(c).alias(f"c{i}") for i, c in enumerate([*kept, *extra])))
    where = [kept.index(c) if c in kept else len(kept) + extra.index(c) for c in inputs]
    types = [to_arrow_type(f.dataType) for f in fields]
    n = len(kept)
    made = [T.StructField(f"r{i}", f.dataType) for i, f in enumerate(fields)]
    names = [*(f"c{i}" for i in range(n)), *(f.name for f in made)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                out = fn(*(part.column(i).to_pylist() for i in where))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(n)), *(pa.array(x, t) for x, t in zip(out, types))], names=names)

    back = sent.mapInArrow(run, T.StructType([*sent.schema.fields[:n], *made]))
    return back.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(kept)),
                       *(F.col(f"r{i}").alias(f.name) for i, f in enumerate(fields)))


def write_table(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` written to the shared work folder and read back: later steps
    start from files that outlive any executor, so Spark may drop the shuffle
    files of this one at its end."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.unset(DROP_SHUFFLES) if before is None else spark.conf.set(DROP_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Removes a table of :func:`write_table` that nothing reads any more."""
    remove(df.sparkSession, df.table_path)


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, for rounds that replace each other: Spark removes
    its files when the frame is no longer used and the session says so."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(work_base(df.sparkSession))
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
