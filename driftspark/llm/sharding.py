"""Sharding by a K-d tree over metadata.

Every node splits its rows at a weighted median along its widest dimension
until the leaves reach the target bytes (or the wanted number); a node of k
leaves gives floor(k / 2) of them to its lower side, and its bytes in
proportion. Law: ``bytes`` (sizes near equal).

A dimension is a number per row; its 31 bits are followed by 31 bits that
break ties: first a hash of the text, so equal texts stay together where a
border does not have to go through their group, then of the id. Medians are
found in rounds: a histogram between the bounds of every open node at once,
then the one bin that holds the border becomes the bounds. The driver sees
histograms only: CELLS rows a round, or 16 per shard where shards are many.
Splitting goes on until a bin holds one key, so a hot dimension value costs no
balance. The tree is applied as expressions on the row; no data moves for it.

Null texts have size 1, null metadata the value 0 of its dimension. Rows of
equal key share a shard. Repeated rows keep their own slots. With fewer rows
than shards some shards are empty; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftspark.llm.common import col, table, without, write_table

BITS = 31
ID_BITS = 13        # of the tie bits, those that tell rows of one group apart
GROUP_SHARE = 0.005  # of a node's bytes: lighter groups of equal texts are not cut
CELLS = 1 << 15
SLOT_ROWS = 50_000  # rows that are numbered together, about


@dataclass
class Tree:
    """Per level and node: dimension and key from which rows go to the upper
    side; leaves of level after level in ``shard`` (node number -> shard)."""
    levels: list[tuple[list[int], list[int]]] = field(default_factory=list)
    shard: list[int] = field(default_factory=list)


def literals(values: list, kind: str) -> Column:
    """A constant array; the optimizer folds it to one literal."""
    return F.array(*(F.lit(v) for v in values)).cast(f"array<{kind}>")


def keys(dims: list[Column], group: Column, ident: list[Column]) -> Column:
    """Array of one long key per dimension."""
    tie = F.shiftleft(F.pmod(F.xxhash64(group), F.lit(1 << (BITS - ID_BITS))), ID_BITS).bitwiseOR(
        F.pmod(F.xxhash64(*ident), F.lit(1 << ID_BITS)))
    value = lambda d: F.least(F.greatest(F.coalesce(F.nanvl(d.cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0)),
                              F.lit(float(2**BITS - 1))).cast("long")
    return F.array(*(F.shiftleft(value(d), BITS).bitwiseOR(tie) for d in dims))


def place(df: DataFrame, tree: Tree) -> DataFrame:
    """``df`` with __node, its node at the level below the last."""
    df = df.withColumn("__node", F.lit(0))
    for dim, cut in tree.levels:
        at = F.col("__node") + 1
        key = F.element_at("__keys", F.element_at(literals(dim, "int"), at) + 1)
        df = df.withColumn("__node", (F.col("__node") * 2 + (key >= F.element_at(literals(cut, "bigint"), at)).cast("int")))
    return df


def grow(rows: DataFrame, n_dims: int, n_shards: int) -> Tree:
    """The tree of ``rows`` (__keys, __weight)."""
    tree, leaves = Tree(), [n_shards]
    wide = None
    while max(leaves) > 1:
        now = place(rows, tree)
        spans = (now.groupBy("__node").agg(F.sum("__weight").alias("w"), *(
            f(F.col("__keys")[i]).alias(f"{n}{i}") for i in range(n_dims) for n, f in (("lo", F.min), ("hi", F.max)))).collect())
        of = {r["__node"]: r for r in spans}
        wide = wide or [max(1, (r[f"hi{i}"] >> BITS) - (r[f"lo{i}"] >> BITS)) for r in spans[:1] for i in range(n_dims)]
        dims, cuts, state = [], [], {}
        for node, k in enumerate(leaves):
            r = of.get(node)
            if k < 2 or r is None:  # a leaf, or no rows: everything goes to the lower side
                dims.append(0), cuts.append(2**63 - 1)
                continue
            d = max(range(n_dims), key=lambda i: (((r[f"hi{i}"] >> BITS) - (r[f"lo{i}"] >> BITS)) / wide[i], -i))
            dims.append(d), cuts.append(None)
            state[node] = {"lo": r[f"lo{d}"] >> ID_BITS, "hi": (r[f"hi{d}"] >> ID_BITS) + 1, "before": 0,
                           "want": r["w"] * (k // 2) / k, "drop": ID_BITS}
        bins = max(16, CELLS // len(leaves))
        while state:
            lo, step, drop = [0] * len(leaves), [0] * len(leaves), [0] * len(leaves)
            for node, s in state.items():
                lo[node], step[node], drop[node] = s["lo"], -(-(s["hi"] - s["lo"]) // bins), s["drop"]
            at = F.col("__node") + 1
            key = F.call_function("shiftright", F.element_at("__keys", F.element_at(literals(dims, "int"), at) + 1),
                                  F.element_at(literals(drop, "int"), at))
            cells = (now.select("__node", "__weight", key.alias("k"), F.element_at(literals(lo, "bigint"), at).alias("b"),
                                F.element_at(literals(step, "bigint"), at).alias("s")).where((F.col("s") > 0) & (F.col("k") >= F.col("b")))
                     .withColumn("cell", F.expr("(k - b) div s")).where(F.col("cell") < bins)
                     .groupBy("__node", "cell").agg(F.sum("__weight").alias("w")).collect())
            per: dict[int, list] = {}
            for r in cells:
                per.setdefault(r["__node"], []).append((r["cell"], r["w"]))
            for node, s in list(state.items()):
                total, width = s["before"], step[node]
                for c, w in sorted(per.get(node, [])):
                    if total + w >= s["want"]:
                        break
                    total += w
                start = s["lo"] + c * width
                if width > 1:
                    state[node] = {**s, "lo": start, "hi": min(start + width, s["hi"]), "before": total}
                elif s["drop"] and w > GROUP_SHARE * of[node]["w"]:  # too heavy to stay whole: look inside
                    state[node] = {**s, "lo": start << ID_BITS, "hi": (start + 1) << ID_BITS, "before": total, "drop": 0}
                else:  # the border goes before or after this group, whichever is nearer
                    cuts[node] = (start + (total + w - s["want"] < s["want"] - total)) << s["drop"]
                    del state[node]
        tree.levels.append((dims, cuts))
        leaves = [x for k in leaves for x in ((k // 2, k - k // 2) if k > 1 else (k, 0))]
    shard = 0
    for k in leaves:
        tree.shard.append(shard if k else -1)
        shard += k
    return tree


def shard(df: DataFrame, dims: list[Column], weight: Column, group: Column, ident: tuple = ("doc_id",),
          n_shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """Every row with ``shard``.

    ``dims``: metadata dimensions, numbers from 0 to 2^31 - 1 (cut to that);
    rows of equal ``group`` should have equal ones to stay together.
    """
    rows = df.withColumns({"__weight": F.coalesce(weight.cast("long"), F.lit(0)), "__keys": keys(dims, group, [col(i) for i in ident])})
    slim = write_table(rows.select("__keys", "__weight"), "shard-rows")
    if n_shards is None:
        n_shards = max(1, -(-(slim.agg(F.sum("__weight")).first()[0] or 0) // target_bytes))
    tree = grow(slim, len(dims), n_shards)
    number = F.element_at(literals(tree.shard, "int"), F.col("__node") + 1)
    return place(rows, tree).select(*map(col, without(df, ["shard"])), number.alias("shard"))


def with_slots(df: DataFrame, by: list[str], group: str = "shard") -> DataFrame:
    """``slot``, a gapless number from 0 within ``group``.

    Rows are numbered inside hash buckets; what stands before a bucket is a
    running sum over a small table."""
    counted = df.groupBy(group).count().collect()  # one row per shard
    buckets = max(8, max((r["count"] for r in counted), default=0) // SLOT_ROWS)
    out = df.withColumn("__bucket", F.pmod(F.xxhash64(*map(col, by)), F.lit(buckets)))
    before = Window.partitionBy(group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = write_table(out.groupBy(group, "__bucket").count().select(
        group, "__bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start")), "shard-starts")
    inside = Window.partitionBy(group, "__bucket").orderBy(*map(col, by))
    return (out.withColumn("__n", F.row_number().over(inside)).join(starts, [group, "__bucket"])
            .withColumn("slot", F.col("__start") + F.col("__n") - 1).drop("__bucket", "__n", "__start"))


def shard_documents(docs: DataFrame, n_shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of documents.

    Dimensions: source, language, length (log scale) and text hash. A group of
    equal texts takes the least source and language of its rows, so that it is
    one place in the tree. Texts are read once and never shuffled.
    """
    text = F.coalesce("text", F.lit(""))
    crc = lambda c: F.crc32(F.encode(c, "UTF-8"))
    rows = write_table(docs.select("doc_id", "source", "lang", (F.octet_length(text) + 1).cast("long").alias("size"),
                                   crc(text).alias("text_crc32"), F.xxhash64(text).alias("__text")), "shard-docs")
    # only texts that occur more than once; written, so that Spark sees its size and can split a large group's join
    same = write_table(rows.groupBy("__text").agg(F.min("source").alias("__s"), F.min("lang").alias("__l"), F.count("*").alias("__n"))
                       .where("__n > 1"), "shard-copies")
    alone = F.col("__n").isNull()
    rows = rows.join(same, "__text", "left").withColumns({
        "__source": F.when(alone, F.col("source")).otherwise(F.col("__s")), "__lang": F.when(alone, F.col("lang")).otherwise(F.col("__l"))})
    dims = [F.shiftright(crc(F.col("__source")), 1), F.shiftright(crc(F.col("__lang")), 1), F.shiftright("text_crc32", 1),
            F.log2("size") * 60_000_000]
    out = shard(rows, dims, F.col("size"), F.col("__text"), ("doc_id",), n_shards, target_bytes)
    out = write_table(out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard"), "shards")
    return with_slots(out, ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), n_shards=16)
