"""Importance resampling toward a target distribution.

Features are all runs of 1 to GRAM words (A-Z lower-cased, runs of letters,
digits and non-ASCII characters), hashed to BUCKETS buckets by CRC-32. One pass
counts the buckets of the documents, one those of the target; every task adds
its rows into one array, so a shuffle carries at most BUCKETS numbers a task.
The gain of a bucket is its log ratio of target to documents; a second pass
over the texts scores each against the array of gains: ``weight`` is the mean
gain of its features and ``score`` adds Gumbel noise drawn from a hash of the
id, so the rows of highest score are a draw without replacement.

Selection is a distributed quickselect. Every row has one composite key, score
downwards, then id upwards (null last), then text hash and row number, so that
no two keys are equal. A round takes random keys of the live range as pivots,
counts the rows before, at and between them exactly, and keeps the range that
holds the k-th key; the same aggregate brings the next pivots. The driver sees
a few counts and keys. Winners alone are sorted, by range, and numbered through
the counts of their partitions; no task sees all of them.

Null and empty texts and texts without words have no features, weight 0 and are
never drawn, as all with fewer than MIN_WORDS words. Null ids take the noise of
an empty id. Repeated rows are rows of their own. Without target texts all
target counts are zero; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftspark.llm.common import add_columns, col, table, without, write_table

BUCKETS = 10_000
GRAM = 2
MIN_WORDS = 20
PERCENT = 25
SEED = 7
PIVOTS = 16  # of each range, in one round
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "replace").lower()) if text else []


def hashes(ws: list[bytes], gram: int = GRAM) -> Iterator[list[int]]:
    """CRC-32 of all runs of 1, 2, .. ``gram`` words joined by a space, a list
    for each length. A run goes on from the checksum of the run before it."""
    now = list(map(crc32, ws))
    yield now
    for k in range(1, gram):
        now = list(map(crc32, ws[k:], map(crc32, repeat(b" "), now)))
        yield now


def buckets(text: str | None, n_buckets: int, gram: int):
    """(number of words, bucket of every feature)."""
    import numpy as np

    ws = words(text)
    found = np.fromiter((h for part in hashes(ws, gram) for h in part), np.int64) if ws else np.zeros(0, np.int64)
    return len(ws), found % n_buckets


def bucket_counts(df: DataFrame, text: str = "text", n_buckets: int = BUCKETS, gram: int = GRAM) -> DataFrame:
    """(bucket, n) of all features of a table; buckets without any are left out."""
    import pyarrow as pa

    def run(batches):
        import numpy as np

        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for t in batch.column(0):
                total += np.bincount(buckets(t.as_py(), n_buckets, gram)[1], minlength=n_buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    schema = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("n", T.LongType())])
    return df.select(col(text)).mapInArrow(run, schema).groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", n_buckets: int = BUCKETS,
          gram: int = GRAM) -> list[int]:
    """Gain of every bucket; at most ``n_buckets`` numbers of each side reach
    the driver."""
    both = []
    for df, name in ((docs, text), (target, target_text)):
        n = [0] * n_buckets
        for r in bucket_counts(df, name, n_buckets, gram).collect():
            n[r.bucket] = r.n
        both.append(n)
    s, t = both
    up, down = float(sum(s) + n_buckets), float(sum(t) + n_buckets)
    return [math.floor(1000 * math.log(float(b + 1) * up / (float(a + 1) * down))) for a, b in zip(s, t)]


def weigh(df: DataFrame, gain: list[int], text: str = "text", gram: int = GRAM) -> DataFrame:
    """Every row with n_words, n_features and weight."""
    n_buckets = len(gain)
    state: list = []

    def run(texts):
        import numpy as np

        if not state:
            state.append(np.array(gain, np.int64))
        out: list[list] = [[], [], []]
        for t in texts:
            n, found = buckets(t, n_buckets, gram)
            mean = int(state[0][found].sum()) // len(found) if len(found) else 0
            for made, x in zip(out, (n, len(found), mean)):
                made.append(x)
        return out

    return add_columns(df, [text], run, [T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")])


def noise(ident, seed: int = SEED):
    """Gumbel noise in thousandths, from the hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    return F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0))).cast("long")


def kth_key(keys: DataFrame, k: int, name: str = "key", seed: int = SEED):
    """The k-th (from 1) of distinct struct keys in ascending order, as a Row;
    ``keys`` has k rows at least and is read once a round."""
    kind = keys.schema[name].dataType

    def literal(row):
        return F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(kind.fields, row)))

    low = high = None  # the live range lies strictly between
    pivots: list = []
    before = 0  # keys at or before ``low``
    for turn in range(10_000):
        key = F.col(name)
        live = keys
        if low is not None:
            live = live.where(key > literal(low))
        if high is not None:
            live = live.where(key < literal(high))
        # three ways around each pivot: 2 i before it, 2 i + 1 at it
        place = F.lit(0)
        for p in pivots:
            place += F.when(key > literal(p), 2).when(key == literal(p), 1).otherwise(0)
        draw = F.xxhash64(F.lit(seed + turn), key)
        parts = live.select(place.alias("place"), F.pmod(draw, F.lit(PIVOTS)).alias("part"), draw.alias("draw"), key.alias("key"))
        got = parts.groupBy("place", "part").agg(F.count("*").alias("n"), F.min_by("key", "draw").alias("pivot")).collect()
        count: dict[int, int] = {}
        for r in got:
            count[r.place] = count.get(r.place, 0) + r.n
        at, left = 0, k - before
        for at in sorted(count):  # noqa: B007
            if left <= count[at]:
                break
            left -= count[at]
        before = k - left
        if at % 2:
            return pivots[at // 2]
        low, high = (pivots[at // 2 - 1] if at else low), (pivots[at // 2] if at // 2 < len(pivots) else high)
        pivots = sorted((r.pivot for r in got if r.place == at), key=_order)
    raise RuntimeError("keys are not distinct")


def _order(row):
    """Spark's order of struct fields: null first."""
    return tuple((v is not None, v if v is not None else 0) for v in row)


def ranked(winners: DataFrame, key: str) -> DataFrame:
    """``winners`` in the order of ``key`` with ``rank`` from 1."""
    spot = F.monotonically_increasing_id()
    ordered = write_table(winners.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("__spot", spot), "resample-winners")
    part = F.shiftright("__spot", 33)
    sizes = ordered.groupBy(part.alias("__part")).agg(F.count("*").alias("n")).collect()  # one row a partition
    offsets, total = [], 0
    for r in sorted(sizes, key=lambda r: r["__part"]):
        offsets.append((r["__part"], total))
        total += r.n
    starts = winners.sparkSession.createDataFrame(offsets, "__part long, __start long")
    numbered = ordered.withColumn("__part", part).join(F.broadcast(starts), "__part")
    rank = F.col("__start") + F.col("__spot") - F.shiftleft("__part", 33) + 1
    return numbered.withColumn("rank", rank).drop("__part", "__start", "__spot")


def resample(docs: DataFrame, target: DataFrame, text: str = "text", ident: str = "doc_id", target_text: str = "text",
             percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, n_buckets: int = BUCKETS,
             gram: int = GRAM, keep_text: bool = True) -> DataFrame:
    """Every row with n_words, n_features, weight, score and rank (null where
    it is not drawn): ``percent`` of the rows with ``min_words`` words."""
    gain = gains(docs, target, text, target_text, n_buckets, gram)
    made = ["n_words", "n_features", "weight", "score", "rank"]
    rows = weigh(docs.withColumn("__hash", F.xxhash64(col(text))), gain, text, gram)
    kept = [c for c in without(docs, made) if keep_text or c != text]
    rows = rows.withColumn("score", F.col("weight") + noise(col(ident), seed))
    rows = write_table(rows.select(*map(col, kept), *made[:-1], "__hash", F.monotonically_increasing_id().alias("__row")), "resample-rows")
    enough = F.col("n_words") >= min_words
    n = rows.where(enough).count()
    k = n * percent // 100
    if not k:
        return rows.withColumn("rank", F.lit(None).cast("long")).drop("__hash", "__row")
    key = F.struct((-F.col("score")).alias("score"), col(ident).isNull().alias("none"), col(ident).alias("id"), F.col("__hash").alias("hash"),
                   F.col("__row").alias("row"))
    border = kth_key(rows.where(enough).select(key.alias("key")), k, seed=seed)
    last = F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(rows.select(key.alias("k")).schema["k"].dataType.fields, border)))
    won = enough & (key <= last)
    drawn = ranked(rows.where(won).withColumn("__key", key), "__key").drop("__key")
    rest = rows.where(~won).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select(*map(col, kept), *made)


def op11_resampling(spark, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text")
    return resample(docs, target, keep_text=False).select("doc_id", "n_features", "weight", "score", "rank")
