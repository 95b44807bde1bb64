"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with
DataFrame functions only.

A source's target in words follows from its weight; what exceeds EPOCHS times
the source's own words is shared again by weight. A target is met by complete
epochs first (every document once each), then by a fraction: documents in the
order of an exponential key -ln(u) / quality, until the words left are used up.
The document at that border is cut, or (``whole``) taken whole where that
comes nearer. ``u`` is a hash of the document's key and a seed, so reruns and
lost executors give the same mix.

No source is ever sorted as a whole. Keys are counted in bins per source; the
running sum over the bins (a small table) shows the one bin the border falls
in, and only its documents are ordered. Bins get finer with the row count. All
rows meet the border table in a join without a shuffle where the table is
small, else Spark splits the large sources.

Null texts have size 0. The null source is a source of its own, the last one.
Quality weights that are null, NaN or not positive count as MIN_QUALITY.
Documents of equal key, id and size share what is left between them. Sources
without words get the target 0. An empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftspark.llm.common import col, table, without, write_table

WEIGHTS = (3, 1, 2)   # by source in code-point order, repeating
SHARE = 1.5           # of all words that the mix has
EPOCHS = 2            # a source repeats at most so often
SEED = 7
MIN_QUALITY = 0.05
BIN_ROWS = 20_000     # documents that share a bin, about
WORD = r"[^\x20\x09-\x0D]+"
MADE = ["size", "source_size", "target", "taken"]


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_of(text: Column) -> Column:
    """A weight from 1 down to MIN_QUALITY by the share of junk symbols."""
    junk = F.regexp_count(text, F.lit("[#*$%&|<>!]"))
    return F.coalesce(F.greatest(F.lit(MIN_QUALITY), 1 - 4 * junk / F.greatest(F.length(text), F.lit(1))),
                      F.lit(MIN_QUALITY))


def draw(key: list[Column], quality: Column, seed: int = SEED) -> Column:
    """The exponential key of a document; the smallest are drawn first."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in key))), 1, 13), 16, 10)
    u = (bits.cast("long") + 0.5) / float(2**52)
    weight = F.when(quality.isNull() | F.isnan(quality) | (quality <= 0), MIN_QUALITY).otherwise(quality)
    return -F.log(u) / weight


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, n_rows, target) from (source, source_size, n_rows).

    One row per source: filled like vessels of height epochs * size / weight,
    the lowest first.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = sources.withColumn("k", F.row_number().over(by_name) - 1).withColumns({
        "w": F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("k") % len(weights) + 1).cast("int")),
        "full": F.col("source_size") * float(epochs),
        "budget": F.sum("source_size").over(everything) * share})
    order = Window.orderBy(F.col("full") / F.col("w"), "k")
    before = F.coalesce(F.sum("full").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumn("level", (F.col("budget") - before) / rest)
    df = df.withColumn("is_full", F.col("full") / F.col("w") <= F.col("level"))
    level = F.coalesce(F.max(F.when(~F.col("is_full"), F.col("level"))).over(everything), F.lit(0.0))
    df = df.withColumn("target", F.when(F.col("is_full"), F.col("full")).otherwise(level * F.col("w")))
    return df.select("source", "source_size", "n_rows", "target")


def mix(df: DataFrame, source: str = "source", key: tuple = ("doc_id",), size: str = "size", quality: str = "quality",
        weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED, whole: bool = False) -> DataFrame:
    """Every row with ``size``, ``source_size``, ``target`` (of its source) and
    ``taken``, the words the mix takes of it."""
    spark = df.sparkSession
    rows = df.select(*map(col, without(df, [m for m in MADE if m != size.lower()])), col(source).alias("__source"),
                     F.coalesce(col(size).cast("long"), F.lit(0)).alias("__size"),
                     F.struct(draw([col(k) for k in key], col(quality).cast("double"), seed).alias("e"),
                              *(col(k).alias(f"k{i}") for i, k in enumerate(key)),
                              F.coalesce(col(size).cast("long"), F.lit(0)).alias("s")).alias("__order"))
    slim = write_table(rows.select(F.col("__source").alias("source"), F.col("__size").alias("size"),
                                   F.col("__order").alias("order")), "mix-rows")
    sources = write_table(targets(slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows")),
                                  weights, share, epochs), "mix-sources")
    total = sources.agg(F.sum("n_rows")).first()[0] or 0
    per_octave = 64 * max(1, math.ceil(total / (64 * 8 * BIN_ROWS)))
    # whole epochs, and the words left after them
    sources = (sources.withColumn("epochs", F.when(F.col("source_size") > 0, F.least(
                   F.floor(F.col("target") / F.col("source_size")), F.lit(epochs))).otherwise(0).cast("long"))
               .withColumn("left", F.floor(F.col("target")) - F.col("epochs") * F.col("source_size")))
    slim = slim.withColumn("bin", F.floor(F.log2(F.col("order.e")) * per_octave))
    running = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = (slim.groupBy("source", "bin").agg(F.sum("size").alias("words"))
            .withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0)))
            .join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
            .where((F.col("before") < F.col("left")) & (F.col("before") + F.col("words") >= F.col("left")))
            .select(F.col("source").alias("s"), F.col("bin").alias("b"), "before", "left"))
    bins = write_table(bins, "mix-bins")
    inside = Window.partitionBy("source").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    border = (slim.join(bins, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b")))
              .groupBy("source", "order").agg(F.sum("size").alias("words"), F.count("*").alias("n"),
                                              F.first("before").alias("start"), F.first("left").alias("left"))
              .withColumn("before", F.col("start") + F.coalesce(F.sum("words").over(inside), F.lit(0)))
              .where((F.col("before") < F.col("left")) & (F.col("before") + F.col("words") >= F.col("left")))
              .select(F.col("source").alias("s2"), F.col("order").alias("__cut"),
                      F.floor((F.col("left") - F.col("before")) / F.col("n")).alias("__part")))
    plan = write_table(sources.join(border, F.col("source").eqNullSafe(F.col("s2")), "left").select(
        F.col("source").alias("__s"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"),
        F.col("epochs").alias("__epochs"), "__cut", "__part"), "mix-plan")
    part = F.when(F.col("__part") * 2 >= F.col("__size"), F.col("__size")).otherwise(0) if whole else F.col("__part")
    more = (F.when(F.col("__cut").isNull(), 0).when(F.col("__order") < F.col("__cut"), F.col("__size"))
            .when(F.col("__order") == F.col("__cut"), part).otherwise(0))
    out = rows.join(plan, F.col("__source").eqNullSafe(F.col("__s")))
    return out.select(*map(col, without(rows, ["size", "__source", "__size", "__order"])), F.col("__size").alias("size"),
                      F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
                      (F.col("__epochs") * F.col("__size") + more).cast("long").alias("taken"))


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"),
                                                    quality_of(F.col("text")).alias("quality"))
    return mix(write_table(docs, "mix-sizes")).select("doc_id", "size", "source_size", "target", "taken")


_W = "CASE k % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END"
OP2_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
    coalesce(greatest({MIN_QUALITY}::DOUBLE, 1 - (4 * len(regexp_extract_all(text, '[#*$%&|<>!]')))::DOUBLE
      / greatest(length(text), 1)), {MIN_QUALITY}::DOUBLE) AS q FROM documents),
e AS (
  SELECT *, -ln((('0x' || substr(md5('{SEED}:' || doc_id::VARCHAR), 1, 13))::BIGINT + 0.5::DOUBLE) / {float(2**52)!r}::DOUBLE) / q AS e
  FROM d),
s AS (
  SELECT source, sum(size)::DOUBLE AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
v AS (
  SELECT source, source_size, {_W} AS w, k, source_size * {EPOCHS} AS cap, sum(source_size) OVER () * {SHARE}::DOUBLE AS budget FROM s),
l AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM v),
t AS (
  SELECT source, source_size, CASE WHEN cap / w <= level THEN cap
    ELSE coalesce(max(CASE WHEN cap / w > level THEN level END) OVER (), 0) * w END AS target FROM l),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), {EPOCHS}) ELSE 0 END AS ep FROM t),
r AS (
  SELECT doc_id, size, source_size, target, ep, floor(target) - ep * source_size AS rest,
    coalesce(sum(size) OVER (PARTITION BY e.source ORDER BY e, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM e JOIN p ON e.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
  (ep * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM r"""
