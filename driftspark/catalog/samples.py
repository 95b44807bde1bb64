"""Samples, splits, blocks and the adaptive sample."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftspark.catalog.base import (
    LINE_FEATURES,
    LINE_KEY,
    lines,
    query,
    sql_hash,
    sql_long,
    sql_perm_hash,
    sql_perm_parts,
    table,
)
from driftspark.functions.hashing import PERM_PRIME
from driftspark.operators import sampling as smp
from driftspark.operators.extra import pick_blocks
from driftspark.operators.ks import stack_sides
from driftspark.plans.workdir import new_path
from driftspark.sources.files import write_blocks

ORDER = ["o_orderkey"]
_ROWS = ", ".join(LINE_KEY)


@query("sample_plan", """
  SELECT event_type, count(*) AS total, 599::BIGINT AS k, least(10000, greatest(4 * 599, 2000))::BIGINT AS target,
    round(least(1.0, least(10000, greatest(4 * 599, 2000)) * 1.5 / count(*)), 6) AS fraction FROM events GROUP BY 1""")
def sample_plan(spark, d):
    k = smp.sample_size()
    target = smp.bounded_target(k)
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("total")).select(
        "event_type", "total", F.lit(k).cast("long").alias("k"), F.lit(target).cast("long").alias("target"),
        F.round(F.least(F.lit(1.0), target * 1.5 / F.col("total")), 6).alias("fraction"))


@query("block_partitions", """
  SELECT 50 AS parts, count(*) AS n_rows, true AS keys_together, true AS even FROM lineitem""")
def block_partitions(spark, d):
    """Facts about the layout: how many partitions hold rows, that no key is
    in two of them, and that none holds twice its share."""
    b = smp.into_blocks(lines(spark, d), 50, LINE_KEY).withColumn("part", F.spark_partition_id())
    keys = b.groupBy(*LINE_KEY).agg(F.countDistinct("part").alias("parts")).agg(F.max("parts").alias("most"))
    sizes = b.groupBy("part").agg(F.count("*").alias("cnt"))
    one = keys.first()["most"] == 1
    return sizes.agg(F.count("*").cast("int").alias("parts"), F.sum("cnt").alias("n_rows"), F.lit(one).alias("keys_together"),
                     (F.max("cnt") < 2 * F.avg("cnt")).alias("even"))


@query("coarse_subset", f"SELECT o_orderkey FROM orders WHERE {sql_hash(43, *ORDER)} % 3 = 2")
def coarse_subset(spark, d):
    # m = 1800 blocks against K = 599 rows: one of three subsets, chosen by the seed
    s = smp.coarse_parts(1800, 0.05, 0.10)
    return smp.coarse_subset(table(spark, d, "orders"), ORDER, s, 42).select("o_orderkey")


_BLOCKS = f"SELECT *, (ntile(50) OVER (ORDER BY {sql_hash(42, *LINE_KEY)}) - 1)::INTEGER AS block_id FROM lineitem"


@query("blocks", f"SELECT {_ROWS}, block_id FROM ({_BLOCKS})")
def blocks(spark, d):
    return smp.assign_blocks(lines(spark, d), LINE_KEY, 50).select(*LINE_KEY, "block_id")


@query("blocks_round_robin", f"""
  SELECT o_orderkey, ((row_number() OVER (ORDER BY {sql_hash(42, *ORDER)}) - 1) % 50)::INTEGER AS block_id FROM orders""")
def blocks_round_robin(spark, d):
    return smp.assign_blocks(table(spark, d, "orders"), ORDER, 50, mode="round_robin").select("o_orderkey", "block_id")


@query("blocks_by_hash", f"SELECT o_orderkey, ({sql_hash(42, *ORDER)} % 50)::INTEGER AS block_id FROM orders")
def blocks_by_hash(spark, d):
    return smp.assign_blocks(table(spark, d, "orders"), ORDER, 50, mode="hash").select("o_orderkey", "block_id")


@query("block_prefix", f"SELECT {_ROWS} FROM ({_BLOCKS}) WHERE block_id < 5")
def block_prefix(spark, d):
    return smp.prefix(smp.assign_blocks(lines(spark, d), LINE_KEY, 50), 5).select(*LINE_KEY)


@query("sample_rows_repeated_key", f"""
  SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem
  ORDER BY {sql_hash(42, 'l_orderkey')}, l_orderkey, l_linenumber, l_quantity, l_extendedprice LIMIT 1001""")
def sample_rows_repeated_key(spark, d):
    rows = lines(spark, d).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return smp.sample_rows(rows, ["l_orderkey"], 1001)


@query("block_files", f"SELECT block_id, count(*) AS cnt FROM ({_BLOCKS}) GROUP BY 1")
def block_files(spark, d):
    stored = write_blocks(smp.assign_blocks(lines(spark, d), LINE_KEY, 50), new_path(spark, "blocks"))
    return stored.groupBy("block_id").agg(F.count("*").alias("cnt"))


@query("block_pick", f"""
  SELECT block_id FROM (SELECT DISTINCT ({sql_hash(42, *ORDER)} % 50)::INTEGER AS block_id FROM orders)
  ORDER BY {sql_hash(9, 'block_id')}, block_id LIMIT 5""")
def block_pick(spark, d):
    b = smp.assign_blocks(table(spark, d, "orders"), ORDER, 50, mode="hash")
    return pick_blocks(b, "block_id", 5, 9)


@query("sample_rows", f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {sql_hash(42, *ORDER)} LIMIT 2396")
def sample_rows(spark, d):
    return smp.sample_rows(table(spark, d, "orders"), ORDER, 2396).select("o_orderkey", "o_totalprice")


@query("sample_rows_fast", f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {sql_hash(42, *ORDER)} LIMIT 2396")
def sample_rows_fast(spark, d):
    return smp.sample_rows(table(spark, d, "orders"), ORDER, 2396, fast=True).select("o_orderkey", "o_totalprice")


@query("train_valid_split", f"""
  SELECT o_orderkey, CASE WHEN {sql_hash(42, *ORDER)} < {int(0.8 * 2**52)} THEN 'train' ELSE 'valid' END AS part FROM orders""")
def train_valid_split(spark, d):
    a, b = smp.split(table(spark, d, "orders"), ORDER)
    return a.select("o_orderkey", F.lit("train").alias("part")).unionByName(
        b.select("o_orderkey", F.lit("valid").alias("part")))


@query("equal_sizes", f"""
  WITH s AS (SELECT 0 AS side, c_custkey AS k, c_acctbal AS bal FROM customer
             UNION ALL SELECT 1, s_suppkey, s_acctbal FROM supplier),
  r AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY {sql_hash(42, 'k')}) AS rn,
          (SELECT min(c) FROM (SELECT count(*) AS c FROM s GROUP BY side)) AS few FROM s)
  SELECT side, k, bal FROM r WHERE rn <= few""")
def equal_sizes(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal"))
    return smp.equal_sizes(stack_sides(c, s, ["k", "bal"]), ["k"])


_A, _B = sql_perm_parts(42, *ORDER)
_HASHED = f"SELECT o_orderkey, {sql_perm_hash(_A, _B, 3)} AS h, count(*) OVER () AS n FROM orders"


@query("resplit_exact", f"""
  SELECT o_orderkey, (CASE WHEN row_number() OVER (ORDER BY h) <= 4000 THEN 0 ELSE 1 END)::INTEGER AS side FROM ({_HASHED})""")
def resplit_exact(spark, d):
    return smp.resplit(table(spark, d, "orders"), ORDER, 3, 4000).select("o_orderkey", "side")


@query("resplit_hash", f"""
  SELECT o_orderkey, (CASE WHEN h <= floor({PERM_PRIME}::HUGEINT * 4000 / n)::BIGINT - 1 THEN 0 ELSE 1 END)::INTEGER AS side
  FROM ({_HASHED})""")
def resplit_hash(spark, d):
    return smp.resplit(table(spark, d, "orders"), ORDER, 3, 4000, exact=False).select("o_orderkey", "side")


# ---- KS convergence and the adaptive sample ---------------------------------

def _steps(source: str, features, t_max: int) -> str:
    """CTEs: ks(t, feature, ks) over the block prefixes of ``source``."""
    return f"""
  long AS ({sql_long(source, features, 'block_id')}),
  cnt AS (SELECT t, feature, v, sum(CASE WHEN block_id < t - 1 THEN 1 ELSE 0 END) AS c0, count(*) AS c1
          FROM long JOIN (SELECT unnest(range(2, {t_max + 1})) AS t) ON block_id < t GROUP BY t, feature, v),
  ecdf AS (SELECT t, feature, (sum(c0) OVER w)::DOUBLE AS a, (sum(c1) OVER w)::DOUBLE AS b,
             (sum(c0) OVER p)::DOUBLE AS n0, (sum(c1) OVER p)::DOUBLE AS n1 FROM cnt
           WINDOW w AS (PARTITION BY t, feature ORDER BY v), p AS (PARTITION BY t, feature)),
  ks AS (SELECT t, feature, max(abs(a / n0 - b / n1)) AS ks FROM ecdf GROUP BY t, feature),
  chosen AS (SELECT coalesce(min(t) - 1, {t_max - 1}) AS m FROM (SELECT t, max(ks) AS ks FROM ks GROUP BY t) WHERE ks <= 0.02)"""


_A50 = f"SELECT *, ntile(50) OVER (ORDER BY {sql_hash(42, *LINE_KEY)}) - 1 AS block_id FROM lineitem"


@query("convergence", f"WITH b AS ({_A50}), {_steps('b', LINE_FEATURES, 20)} SELECT t::INTEGER AS t, feature, round(ks, 9) AS ks FROM ks")
def convergence(spark, d):
    b = smp.assign_blocks(lines(spark, d), LINE_KEY, 50)
    return smp.convergence(b, LINE_FEATURES).withColumn("ks", F.round("ks", 9))


@query("convergence_points", f"""
  WITH b AS (SELECT * FROM ({_A50}) WHERE block_id < 20), long AS ({sql_long('b', LINE_FEATURES, 'block_id')}),
  cuts AS (SELECT DISTINCT feature, unnest(quantile_cont(v, [{', '.join(repr(i / 50) for i in range(1, 50))}])) AS c FROM long GROUP BY feature),
  vals AS (SELECT v.feature, v.v, count(c) AS bucket FROM (SELECT DISTINCT feature, v FROM long) v LEFT JOIN cuts ON cuts.feature = v.feature AND c <= v.v GROUP BY 1, 2),
  cnt AS (SELECT t, long.feature, bucket, count(*) FILTER (block_id < t - 1) AS c0, count(*) FILTER (block_id < t) AS c1
          FROM long JOIN vals USING (feature, v), (SELECT unnest(range(2, 21)) AS t) GROUP BY 1, 2, 3),
  e AS (SELECT t, feature, (sum(c0) OVER w)::DOUBLE / sum(c0) OVER p AS a, (sum(c1) OVER w)::DOUBLE / sum(c1) OVER p AS b FROM cnt
        WINDOW w AS (PARTITION BY t, feature ORDER BY bucket), p AS (PARTITION BY t, feature))
  SELECT t::INTEGER AS t, feature, round(max(abs(a - b)), 9) AS ks FROM e GROUP BY 1, 2""")
def convergence_points(spark, d):
    b = smp.assign_blocks(lines(spark, d), LINE_KEY, 50)
    return smp.convergence(b, LINE_FEATURES, exact=False).withColumn("ks", F.round("ks", 9))


@query("adaptive_sample", f"""
  WITH b AS ({_A50}), {_steps('b', LINE_FEATURES, 20)}
  SELECT {_ROWS}, l_quantity FROM b, chosen WHERE block_id < m""")
def adaptive_sample(spark, d):
    return smp.adaptive_sample(lines(spark, d), LINE_FEATURES, LINE_KEY).select(*LINE_KEY, "l_quantity")


@query("adaptive_sample_bounded", f"""
  WITH s AS (SELECT * FROM orders ORDER BY {sql_hash(44, *ORDER)} LIMIT 2396),
  b AS (SELECT *, ntile(20) OVER (ORDER BY {sql_hash(42, *ORDER)}) - 1 AS block_id FROM s),
  {_steps('b', ['o_totalprice', 'o_custkey'], 20)}
  SELECT o_orderkey, o_totalprice FROM b, chosen WHERE block_id < m""")
def adaptive_sample_bounded(spark, d):
    return smp.adaptive_sample(table(spark, d, "orders"), ["o_totalprice", "o_custkey"], ORDER,
                               preset="bounded").select("o_orderkey", "o_totalprice")


@query("adaptive_sample_first_columns", f"""
  WITH s AS (SELECT event_id, value AS x1, user_id AS x2, (event_id % 7) AS x3, value * user_id AS x4, extract('hour' FROM ts) AS x5 FROM events),
  b AS (SELECT *, ntile(50) OVER (ORDER BY {sql_hash(42, 'event_id')}) - 1 AS block_id FROM s),
  {_steps('b', [f'x{i}' for i in range(1, 6)], 20)}
  SELECT event_id, x1 FROM b, chosen WHERE block_id < m""")
def adaptive_sample_first_columns(spark, d):
    e = table(spark, d, "events").select(
        "event_id", F.col("value").alias("x1"), F.col("user_id").alias("x2"), (F.col("event_id") % 7).alias("x3"),
        (F.col("value") * F.col("user_id")).alias("x4"), F.hour("ts").alias("x5"))
    return smp.adaptive_sample(e, None, ["event_id"], preset="notebook").select("event_id", "x1")


# 28 columns made from the four features of a line
_WIDE = [f"x{i}" for i in range(1, 29)]
_WIDE_SQL = ", ".join(
    f"{LINE_FEATURES[i % 4]} * {1 + i // 4} + {LINE_FEATURES[(i + i // 4) % 4]} AS x{i + 1}" for i in range(28))


@query("adaptive_sample_fixed_columns", f"""
  WITH s AS (SELECT {_ROWS}, {_WIDE_SQL} FROM lineitem),
  b AS (SELECT *, ntile(50) OVER (ORDER BY {sql_hash(42, *LINE_KEY)}) - 1 AS block_id FROM s),
  {_steps('b', _WIDE, 20)}
  SELECT {_ROWS} FROM b, chosen WHERE block_id < m""")
def adaptive_sample_fixed_columns(spark, d):
    wide = lines(spark, d).select(*LINE_KEY, *[
        (F.col(LINE_FEATURES[i % 4]) * (1 + i // 4) + F.col(LINE_FEATURES[(i + i // 4) % 4])).alias(f"x{i + 1}")
        for i in range(28)])
    return smp.adaptive_sample(wide, None, LINE_KEY, preset="fixed_columns").select(*LINE_KEY)


@query("sampling_times", """SELECT method, CASE WHEN method <> 'adaptive' THEN least(2396, n) END AS n_rows, true AS part_of_all, true AS timed
  FROM (VALUES ('adaptive'), ('by_key'), ('bernoulli')) m(method), (SELECT count(*) AS n FROM lineitem)""")
def sampling_times(spark, d):
    """Rows and time of the samplers; how many rows the adaptive one takes is
    checked by its own queries."""
    n, c = lines(spark, d).count(), F.col
    return smp.sampling_times(lines(spark, d), LINE_FEATURES, LINE_KEY, 2396).select(
        "method", F.when(c("method") != "adaptive", c("n_rows")).alias("n_rows"), c("n_rows").between(1, n).alias("part_of_all"),
        (c("seconds") > 0).alias("timed"))
