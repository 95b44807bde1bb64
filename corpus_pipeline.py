"""From raw documents to training shards, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the
last return the columns of ``documents``; the last returns one row per row of
the mix with its shard. A document that the mix repeats is that many rows.
Every stage is written as Parquet in the shared work folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspark.llm import attention, decontaminate, mixing, sharding, simhash
from driftspark.llm.common import table, write_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SHARDS = 16


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    model = attention.train(docs, table(spark, sf_dir, "labels"))
    return attention.score(docs, model).where(F.col("score") >= attention.ACCEPT).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of every near-duplicate group; rows that share
    that id and text count once."""
    return simhash.keep_one(docs).select(COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not hold benchmark passages."""
    found = decontaminate.find_overlap(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, whole each time."""
    sized = docs.withColumns({"size": mixing.n_words(F.col("text")), "quality": mixing.quality_of(F.col("text"))})
    taken = mixing.mix(sized, whole=True)
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(1).cast("int")
    return taken.where(times > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), times))).select(COLUMNS)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    return sharding.shard_documents(docs, n_shards=SHARDS)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminated", decontaminated), ("mixed", mixed),
          ("sharded", sharded)]

# Training, fingerprints and the tree have no SQL form; tests hold the result against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
