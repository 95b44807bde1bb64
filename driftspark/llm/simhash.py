"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits, each the majority of that bit over the hashes of
all SHINGLE-word shingles. Fingerprints within RADIUS bits are linked, and
documents of a connected group share the least id of the group.

Covering masks: every bit position has a nonzero vector of RADIUS + 1 bits;
table v (one per nonzero vector) keeps the positions whose vector has an odd
product with v. For any RADIUS positions some v is orthogonal to all their
vectors, so two fingerprints that differ there only are equal in table v: no
pair within the radius is missed, with 2^(RADIUS + 1) - 1 = 31 tables.

Equal fingerprints are one node. A bucket of a table that holds at most
BUCKET nodes is compared inside one task, which emits a spanning forest of its
links, never all pairs. Nodes of larger buckets take another exact way: each
emits all fingerprints within RADIUS / 2 bits of itself, and nodes that emit
the same one (so are within RADIUS) are linked to the least of them; that is
linear in the nodes, and no group of them is gathered.

Null and empty texts and texts without a word have fingerprint 0 and link like
any other. Shorter texts are one shingle. Repeated rows share a fingerprint.
Null ids get the component of their group; a group of null ids only has a null
component. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftspark.llm.common import add_columns, col, table, without, write_table
from driftspark.llm.components import components

SHINGLE = 4
RADIUS = 4
SEED = 42
BUCKET = 2048
HASHES = 1 << 15  # of one text that are in memory as bits at a time


def fingerprint(text: str | None) -> int:
    """As a signed 64-bit number."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "replace").lower().split() if text else []  # bytes: lowers A-Z, splits at the six spaces
    if not words:
        return 0
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    k = min(SHINGLE, len(words))
    n, ones = len(words) - k + 1, np.zeros(64, np.int64)
    for i in range(0, n, HASHES):
        j = min(n, i + HASHES)
        h = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[i:j], ends[i + k - 1:j + k - 1])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    value = sum(1 << int(b) for b in np.flatnonzero(2 * ones > n))
    return value - (1 << 64) if value >> 63 else value


def masks() -> list[int]:
    """The positions each table keeps, as signed 64-bit numbers."""
    size = 2 ** (RADIUS + 1)
    vector = [1 + b % (size - 1) for b in range(64)]
    out = []
    for v in range(1, size):
        m = sum(1 << b for b in range(64) if (vector[b] & v).bit_count() % 2)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def near_bits() -> list[int]:
    """All patterns of at most RADIUS / 2 bits."""
    from itertools import combinations

    out = [sum(1 << b for b in c) for n in range(RADIUS // 2 + 1) for c in combinations(range(64), n)]
    return [x - (1 << 64) if x >> 63 else x for x in out]


def forest(nodes) -> list[tuple[int, int]]:
    """Links of a spanning forest of the nodes (unsigned array) under RADIUS."""
    import numpy as np

    left, out = np.sort(nodes), []
    while len(left):
        # grow one tree: its newest nodes look for those not yet in a tree
        new, left = left[:1], left[1:]
        while len(new) and len(left):
            at = np.zeros(len(left), np.int64) - 1
            for k in range(0, len(new), 256):
                near = np.bitwise_count(left[:, None] ^ new[None, k:k + 256]) <= RADIUS
                found = near.any(axis=1) & (at < 0)
                at[found] = k + near[found].argmax(axis=1)
            hit = at >= 0
            out += zip(new[at[hit]].tolist(), left[hit].tolist())
            new, left = left[hit], left[~hit]
    return out


def bucket_links(groups: DataFrame) -> DataFrame:
    """(u, v) of buckets given as arrays ``nodes``."""
    import pyarrow as pa

    schema = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])

    def run(batches):
        import numpy as np

        for batch in batches:
            got = []
            for nodes in batch.column(0):
                got += forest(np.array(nodes.values.to_numpy(zero_copy_only=False), np.int64).view(np.uint64))
            ends = np.array(got, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["u", "v"])

    return groups.select("nodes").mapInArrow(run, schema)


def links(nodes: DataFrame) -> DataFrame:
    """(u, v) that connect the distinct fingerprints ``fp`` as RADIUS does."""
    all_masks = F.array(*(F.lit(m) for m in masks()))
    placed = nodes.select("fp", F.posexplode(F.transform(all_masks, lambda m: m.bitwiseAND(F.col("fp")))).alias("t", "kept"))
    # written, so that both sides of the join are shuffles whose large keys Spark can split
    counts = write_table(placed.groupBy("t", "kept").agg(F.count("*").alias("n")).where("n > 1"), "simhash-counts")
    shared = write_table(placed.join(counts, ["t", "kept"]).select("t", "kept", "fp", (F.col("n") > BUCKET).alias("large")),
                         "simhash-buckets")
    small = shared.where("not large").groupBy("t", "kept").agg(F.collect_list("fp").alias("nodes"))
    out = bucket_links(small)
    large = shared.where("large").select("fp").distinct()
    if not large.isEmpty():
        around = F.array(*(F.lit(x) for x in near_bits()))
        balls = large.select("fp", F.explode(F.transform(around, lambda x: x.bitwiseXOR(F.col("fp")))).alias("seen"))
        least = balls.groupBy("seen").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1").drop("n")
        out = out.union(balls.join(least, "seen").where("fp != v").select(F.col("fp").alias("u"), "v").distinct())
    return out.distinct()


def near_duplicates(df: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """Every row with ``fingerprint`` (16 hex digits) and ``component_id``."""
    rows = add_columns(df, [text], lambda texts: [[fingerprint(t) for t in texts]], [T.StructField("__fp", T.LongType())])
    return _with_components(rows, ident, ["fingerprint", "component_id"])


def keep_one(df: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """One row of each near-duplicate group: the one of least id (nulls last),
    of several with that id the one of least text hash.

    The choice is made on (fingerprint, id, text hash, row number) alone; row
    numbers are those of a table written first, so a lost executor reads the
    same ones. Texts are shuffled once, to meet the chosen numbers.
    """
    rows = add_columns(df, [text], lambda texts: [[fingerprint(t) for t in texts]], [T.StructField("__fp", T.LongType())])
    rows = write_table(rows.withColumn("__row", F.monotonically_increasing_id()), "simhash-texts")
    pick = F.struct(col(ident).isNull().alias("none"), col(ident).alias("id"), F.xxhash64(col(text)).alias("hash"), "__row")
    slim = write_table(rows.select("__fp", pick.alias("pick")), "simhash-picks")
    best = write_table(slim.groupBy("__fp").agg(F.min("pick").alias("pick")), "simhash-nodes")
    roots = components(links(best.select(F.col("__fp").alias("fp"))))
    chosen = best.join(roots, F.col("__fp") == F.col("node"), "left").groupBy(
        F.coalesce("root", "__fp").alias("root")).agg(F.min("pick").alias("pick")).select("pick.__row")
    return rows.join(chosen, "__row", "left_semi").select(*map(col, without(rows, ["__fp", "__row"])))


def _with_components(rows: DataFrame, ident: str, made: list[str]) -> DataFrame:
    """``rows`` (with __fp): groups of equal fingerprints, their links, ids."""
    slim = write_table(rows.select(col(ident).alias("id"), F.col("__fp").alias("fp")), "simhash-rows")
    nodes = write_table(slim.groupBy("fp").agg(F.min("id").alias("id")), "simhash-nodes")
    roots = components(links(nodes.select("fp"))).select(F.col("node").alias("fp"), "root")
    least = roots.join(nodes, "fp").groupBy("root").agg(F.min("id").alias("least"))
    linked = roots.join(least, "root").select(F.col("fp").alias("__n"), "least")
    # one row per fingerprint
    found = nodes.join(linked, F.col("fp") == F.col("__n"), "left").select(
        F.col("fp").alias("__node"), F.coalesce("least", "id").alias("__component"))
    found = write_table(found, "simhash-components")
    return rows.join(found, F.col("__fp") == F.col("__node")).select(
        *map(col, without(rows, [*made, "__fp"])), F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"),
        F.col("__component").alias("component_id"))


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    prints = add_columns(docs, ["text"], lambda texts: [[fingerprint(t) for t in texts]], [T.StructField("__fp", T.LongType())])
    return _with_components(write_table(prints.drop("text"), "simhash-prints"), "doc_id", ["fingerprint", "component_id"])
