"""Scans, tidying, joins, aggregates and window cutting."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftspark.catalog.base import (
    LINE_FEATURES,
    LINE_KEY,
    lines,
    query,
    rounded,
    sql_hash,
    sql_unit,
    table,
)
from driftspark.functions.columns import (
    below,
    label_from_text,
    random_int,
    row_id,
    subnet24,
    whole_of_fraction,
)
from driftspark.functions.hashing import hash_unit
from driftspark.operators import extra, tidy
from driftspark.operators import windows as win
from driftspark.operators.ensemble import join_scores, store_bucketed
from driftspark.operators.ks import quantile_table
from driftspark.operators.wasserstein import feature_moments
from driftspark.plans.buckets import hash_rank
from driftspark.plans.workdir import new_path
from driftspark.sources import files

CUSTOMER = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


# ---- sources and sinks ------------------------------------------------------

@query("scan_renamed", "SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, "
       "c_acctbal AS balance, c_mktsegment AS segment FROM customer")
def scan_renamed(spark, d):
    return files.read_parquet(spark, f"{d}/customer.parquet", ["id", "name", "nation", "balance", "segment"])


@query("csv_plain", "SELECT c_custkey AS c0, c_name AS c1, c_nationkey AS c2, c_acctbal AS c3, "
       "c_mktsegment AS c4 FROM customer")
def csv_plain(spark, d):
    path = new_path(spark, "plain-csv")
    table(spark, d, "customer").write.csv(path)
    return files.read_csv(spark, path, CUSTOMER, names=[f"c{i}" for i in range(5)])


@query("csv_header", "SELECT * FROM customer")
def csv_header(spark, d):
    path = new_path(spark, "header-csv")
    table(spark, d, "customer").write.option("header", True).csv(path)
    return files.read_csv(spark, path, CUSTOMER, header=True)


@query("read_any_formats", """
  SELECT 'csv' AS fmt, c_custkey AS id, c_acctbal AS balance FROM customer
  UNION ALL SELECT 'parquet', c_custkey, c_acctbal FROM customer""")
def read_any_formats(spark, d):
    path = new_path(spark, "any-csv")
    table(spark, d, "customer").write.option("header", True).csv(path)
    names = {"c_custkey": "id", "c_acctbal": "balance", "absent": "unused"}
    parts = [files.read_any(spark, path, "csv", names, schema=CUSTOMER),
             files.read_any(spark, f"{d}/customer.parquet", "parquet", names)]
    return extra.stack_rows([p.select(F.lit(f).alias("fmt"), "id", "balance")
                             for p, f in zip(parts, ("csv", "parquet"))])


@query("file_windows", """
  SELECT window_id::INTEGER AS window_id, count(*) AS cnt FROM (
    SELECT dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS window_id FROM orders) GROUP BY 1""")
def file_windows(spark, d):
    base = new_path(spark, "file-windows")
    orders = table(spark, d, "orders")
    # one file per status, in path order
    orders.repartition("o_orderstatus").write.partitionBy("o_orderstatus").parquet(base)
    return files.file_windows(spark, base).groupBy("window_id").agg(F.count("*").alias("cnt"))


@query("listed_windows", """
  SELECT 0 AS window_id, count(*) AS cnt FROM customer UNION ALL SELECT 1, count(*) FROM customer""")
def listed_windows(spark, d):
    p = f"{d}/customer.parquet"
    return files.listed_windows(spark, [p, p]).groupBy("window_id").agg(F.count("*").alias("cnt"))


@query("manifest_windows", f"""
  WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY {sql_hash(42, 'o_orderkey')}) AS rn FROM orders)
  SELECT ((rn - 1) % 6)::INTEGER AS window_idx, count(*) AS cnt FROM r GROUP BY 1""")
def manifest_windows(spark, d):
    """Write all windows in one job, write the manifest, read both back."""
    base, manifest = new_path(spark, "windows"), new_path(spark, "manifest")
    w = win.split_windows(table(spark, d, "orders"), ["o_orderkey"], 6, mode="round_robin")
    files.write_windows(w, base, ["o_orderkey"])
    stored = spark.read.parquet(base)
    files.write_manifest(base, stored, manifest)
    listed = files.read_manifest(spark, manifest)
    return (stored.join(listed, F.col("window_id") == F.col("window_idx"))
            .groupBy("window_idx").agg(F.count("*").alias("cnt")))


@query("saved_sample", f"""
  SELECT o_orderkey, o_totalprice FROM orders ORDER BY {sql_hash(7, 'o_orderkey')} LIMIT 1000""")
def saved_sample(spark, d):
    from driftspark.operators.sampling import sample_rows

    s = sample_rows(table(spark, d, "orders"), ["o_orderkey"], 1000, 7)
    return files.save_sample(s.select("o_orderkey", "o_totalprice"), new_path(spark, "sample"))


_FILES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query("file_sizes", " UNION ALL ".join(f"SELECT '{t}.parquet' AS file, true AS bytes_there, true AS units_follow, true AS adds_up" for t in _FILES)
       + " UNION ALL SELECT NULL, true, true, true")
def file_sizes(spark, d):
    """One row per table file and one for all: sizes are positive, MB and GB
    follow from the bytes, and the total is their sum."""
    c, total = F.col, F.sum(F.when(F.col("file").isNotNull(), F.col("bytes"))).over(Window.partitionBy())
    return files.file_sizes(spark, d, "*.parquet").withColumn("_total", total).select(
        "file", (c("bytes") > 0).alias("bytes_there"),
        ((F.abs(c("mb") * 1024**2 - c("bytes")) <= 0.0051 * 1024**2) & (F.abs(c("gb") * 1024**3 - c("bytes")) <= 0.00051 * 1024**3)).alias("units_follow"),
        (c("file").isNotNull() | (c("bytes") == c("_total"))).alias("adds_up"))


# ---- projections and filters ------------------------------------------------

@query("complete_rows", "SELECT o_totalprice, o_custkey FROM orders WHERE o_totalprice IS NOT NULL AND o_custkey IS NOT NULL")
def complete_rows(spark, d):
    return tidy.complete_rows(table(spark, d, "orders"), ["o_totalprice", "o_custkey"])


@query("renamed_present", "SELECT p_partkey AS id, p_size AS size FROM part")
def renamed_present(spark, d):
    return tidy.rename_present(table(spark, d, "part"), {"p_partkey": "id", "p_size": "size", "gone": "x"}).select("id", "size")


@query("tidy_cast", """
  SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS label,
         value::DOUBLE AS value, user_id::DOUBLE AS user_id FROM events""")
def tidy_cast(spark, d):
    e = table(spark, d, "events").withColumn("Label", F.get_json_object("props", "$.k"))
    e = tidy.cast_double(tidy.relabel(e), ["event_id", "label", "ts", "event_type", "props"])
    return tidy.drop_present(e, ["ts", "event_type", "props", "absent"])


@query("label_text", "SELECT event_id, (CASE WHEN lower(event_type) = 'view' THEN 0 ELSE 1 END)::INTEGER AS label FROM events")
def label_text(spark, d):
    return table(spark, d, "events").select(
        "event_id", label_from_text(F.initcap("event_type"), "view").alias("label"))


@query("subnet24", """
  WITH e AS (SELECT event_id, CASE user_id % 4 WHEN 0 THEN '10.' || (user_id % 256) || '.' || (event_id % 256) || '.7'
      WHEN 1 THEN '192.168.' || (event_id % 256) WHEN 2 THEN 'host-' || user_id || '.a.b' ELSE '172.16' END AS ip FROM events)
  SELECT event_id, TRY_CAST(nullif(split_part(ip, '.', 1), '') AS BIGINT) * 65536
    + TRY_CAST(nullif(split_part(ip, '.', 2), '') AS BIGINT) * 256
    + TRY_CAST(nullif(split_part(ip, '.', 3), '') AS BIGINT) AS subnet FROM e""")
def subnets(spark, d):
    u, i = F.col("user_id"), F.col("event_id")
    text = lambda c: c.cast("string")
    ip = (F.when(u % 4 == 0, F.concat(F.lit("10."), text(u % 256), F.lit("."), text(i % 256), F.lit(".7")))
          .when(u % 4 == 1, F.concat(F.lit("192.168."), text(i % 256)))
          .when(u % 4 == 2, F.concat(F.lit("host-"), text(u), F.lit(".a.b")))
          .otherwise("172.16"))
    return table(spark, d, "events").withColumn("ip", ip).select("event_id", subnet24(F.col("ip")).alias("subnet"))


@query("equality_filter", "SELECT event_id, value FROM events WHERE event_type = 'error'")
def equality_filter(spark, d):
    return table(spark, d, "events").where(F.col("event_type") == "error").select("event_id", "value")


@query("random_ints", f"SELECT o_orderkey, floor({sql_unit(5, 'o_orderkey')} * 10)::INTEGER AS part FROM orders")
def random_ints(spark, d):
    return table(spark, d, "orders").select("o_orderkey", random_int(["o_orderkey"], 10, 5).alias("part"))


@query("row_ids", "SELECT count(*) AS n_rows, count(*) AS n_ids, count(DISTINCT o_orderkey) AS n_keys FROM orders")
def row_ids(spark, d):
    """Ids depend on the layout, but no two rows share one."""
    return table(spark, d, "orders").select("o_orderkey", row_id().alias("rid")).agg(
        F.count("*").alias("n_rows"), F.countDistinct("rid").alias("n_ids"), F.countDistinct("o_orderkey").alias("n_keys"))


@query("rounded_values", "SELECT event_id, round(value / 7, 6) AS v FROM events")
def rounded_values(spark, d):
    return table(spark, d, "events").select("event_id", F.round(F.col("value") / 7, 6).alias("v"))


@query("value_maps", """
  SELECT o_orderkey, (CASE WHEN o_totalprice < 200000 THEN 1 ELSE 0 END)::INTEGER AS below, 0 AS whole FROM orders""")
def value_maps(spark, d):
    p = F.col("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", below(p, 200000).alias("below"),
                                            whole_of_fraction(p, 200000.0).alias("whole"))


@query("range_part", "SELECT part, count(*) AS cnt, min(o_orderkey) AS lo, max(o_orderkey) AS hi "
       "FROM (SELECT floor(o_orderkey / 1000)::BIGINT AS part, o_orderkey FROM orders) GROUP BY part")
def range_part(spark, d):
    return (extra.range_partition(table(spark, d, "orders"), "o_orderkey", 1000).groupBy("part")
            .agg(F.count("*").alias("cnt"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi")))


# ---- joins and unions -------------------------------------------------------

def _score_tables(spark, d):
    o = table(spark, d, "orders")
    return o, [o.select("o_orderkey", hash_unit(["o_orderkey"], i).alias(f"s{i}")) for i in (1, 2, 3)]


_JOINED = f"""
  SELECT o_orderkey, o_totalprice, round({sql_unit(1, 'o_orderkey')}, 6) AS s1,
    round({sql_unit(2, 'o_orderkey')}, 6) AS s2, round({sql_unit(3, 'o_orderkey')}, 6) AS s3 FROM orders"""


def _joined(spark, d, merge):
    o, scores = _score_tables(spark, d)
    return rounded(join_scores(o.select("o_orderkey", "o_totalprice"), scores, ["o_orderkey"], merge),
                   "s1", "s2", "s3")


@query("join_scores", _JOINED)
def joined(spark, d):
    return _joined(spark, d, False)


@query("join_scores_merge", _JOINED)
def joined_merge(spark, d):
    return _joined(spark, d, True)


@query("join_scores_bucketed", _JOINED)
def joined_bucketed(spark, d):
    """Rows and score tables stored in buckets of the key: no row is moved."""
    o, scores = _score_tables(spark, d)
    stored = []
    for i, t in enumerate([o.select("o_orderkey", "o_totalprice"), *scores]):
        path = new_path(spark, "bucketed")
        stored.append(store_bucketed(t, f"scores_{i}_{path[-32:]}", path, ["o_orderkey"], 8))
    return rounded(join_scores(stored[0], stored[1:], ["o_orderkey"], merge=True), "s1", "s2", "s3")


@query("union_missing", """
  SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer
  UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier""")
def union_missing(spark, d):
    return extra.stack_rows([
        table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"),
                                           F.col("c_mktsegment").alias("segment")),
        table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))])


@query("stack_sides", """
  SELECT side, count(*) AS cnt, round(avg(l_quantity), 6) AS mean FROM (
    SELECT 0 AS side, l_quantity FROM lineitem WHERE l_returnflag = 'A'
    UNION ALL SELECT 1, l_quantity FROM lineitem WHERE l_returnflag = 'R') GROUP BY side""")
def stacked(spark, d):
    from driftspark.operators.ks import stack_sides

    both = stack_sides(lines(spark, d, "A"), lines(spark, d, "R"), ["l_quantity"])
    return both.groupBy("side").agg(F.count("*").alias("cnt"), F.round(F.avg("l_quantity"), 6).alias("mean"))


@query("distinct_sorted", "SELECT DISTINCT l_returnflag FROM lineitem ORDER BY 1")
def distinct_sorted(spark, d):
    return extra.distinct_sorted(table(spark, d, "lineitem"), "l_returnflag")


# ---- aggregates -------------------------------------------------------------

@query("row_count", "SELECT count(*) AS cnt FROM lineitem")
def row_count(spark, d):
    return table(spark, d, "lineitem").agg(F.count("*").alias("cnt"))


@query("source_order", "SELECT event_type, count(*) AS cnt FROM events GROUP BY 1 ORDER BY 2, 1")
def source_order(spark, d):
    return win.source_order(table(spark, d, "events"), "event_type")


@query("class_distribution", """
  SELECT l_returnflag, count(*) AS cnt, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct
  FROM lineitem GROUP BY 1""")
def class_distribution(spark, d):
    return rounded(win.class_distribution(table(spark, d, "lineitem"), "l_returnflag"), "pct")


@query("class_distribution_by_source", """
  SELECT o_orderpriority, o_orderstatus, count(*) AS cnt,
    round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority), 6) AS pct
  FROM orders GROUP BY 1, 2""")
def class_distribution_by_source(spark, d):
    return rounded(win.class_distribution(table(spark, d, "orders"), "o_orderstatus", ["o_orderpriority"]), "pct")


@query("feature_moments", "SELECT l_returnflag, " + ", ".join(
    f"round(avg({c}), 4) AS {c}_mean, round(stddev_pop({c}), 4) AS {c}_std" for c in LINE_FEATURES)
    + " FROM lineitem GROUP BY 1")
def moments(spark, d):
    m = feature_moments(table(spark, d, "lineitem"), LINE_FEATURES, ["l_returnflag"])
    return rounded(m, *[c for c in m.columns if c != "l_returnflag"], digits=4)


@query("sample_deviation", "SELECT " + ", ".join(f"round(stddev_samp({c}), 4) AS {c}" for c in LINE_FEATURES) + " FROM lineitem")
def sample_deviation(spark, d):
    return lines(spark, d).agg(*[F.round(F.stddev_samp(c), 4).alias(c) for c in LINE_FEATURES])


PROBS = [i / 49 for i in range(50)]


@query("exact_quantiles", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, i::INTEGER AS i, round(q, 6) AS value FROM (SELECT unnest(quantile_cont({c}, {PROBS!r})) AS q, "
    f"unnest(range(50)) AS i FROM lineitem)" for c in LINE_FEATURES))
def exact_quantiles(spark, d):
    q = quantile_table(lines(spark, d), LINE_FEATURES, PROBS)
    return q.select("feature", F.round(F.col("p") * 49).cast("int").alias("i"), F.round("value", 6).alias("value"))


@query("approx_quantiles", " UNION ALL ".join(
    f"SELECT '{f}' AS feature, {p!r}::DOUBLE AS p, true AS close" for f in LINE_FEATURES for p in PROBS))
def approx_quantiles(spark, d):
    """The sketch promises a rank error of one hundredth: held against the
    shares of all rows below and up to each value."""
    df = lines(spark, d)
    q = quantile_table(df, LINE_FEATURES, PROBS, exact=False).collect()  # features x probabilities
    share = [(F.avg((F.col(r.feature) < r.value).cast("double")), F.avg((F.col(r.feature) <= r.value).cast("double"))) for r in q]
    cells = F.array(*[F.struct(F.lit(r.feature).alias("feature"), F.lit(r.p).alias("p"), ((a <= r.p + 0.011) & (b >= r.p - 0.011)).alias("close"))
                      for r, (a, b) in zip(q, share)])
    return df.agg(cells.alias("x")).select(F.inline("x"))


@query("shuffled_rank", f"""
  SELECT l_returnflag, {', '.join(LINE_KEY)}, row_number() OVER (PARTITION BY l_returnflag
    ORDER BY {sql_hash(3, *LINE_KEY)}, {', '.join(LINE_KEY)}, l_quantity, l_extendedprice) AS rank FROM lineitem""")
def shuffled_rank(spark, d):
    r = hash_rank(lines(spark, d), LINE_KEY, 3, ["l_returnflag"], ["l_quantity", "l_extendedprice"])
    return r.select("l_returnflag", *LINE_KEY, "rank")


@query("running_total", """
  SELECT o_orderkey, coalesce(sum(o_custkey) OVER (ORDER BY o_orderkey
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM orders""")
def running_total(spark, d):
    return extra.running_total(table(spark, d, "orders"), "o_orderkey", F.col("o_custkey"), "before").select(
        "o_orderkey", "before")


@query("equal_height", """
  WITH r AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) AS rn,
               count(*) OVER () AS n FROM lineitem),
  k AS (SELECT unnest(range(0, 21)) AS i)
  SELECT i::INTEGER AS i, v AS bound FROM k JOIN r ON rn = CASE WHEN i = 0 THEN 1 WHEN i = 20 THEN n
    ELSE greatest(1, i * (n // 20)) END""")
def equal_height(spark, d):
    return extra.equal_height_bounds(lines(spark, d), "l_extendedprice", 20)


@query("split_overshoot", """
  WITH RECURSIVE m AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(*) // 20 AS goal FROM lineitem),
  c AS (SELECT bin, count(*) AS cnt, row_number() OVER (ORDER BY bin) AS i FROM (
    SELECT least(floor((l_extendedprice - lo) / (hi - lo) * 200), 199)::INTEGER AS bin FROM lineitem, m) GROUP BY bin),
  f AS (SELECT 0::BIGINT AS i, 0::BIGINT AS here, 0::BIGINT AS g, NULL::BIGINT AS worst
    UNION ALL SELECT c.i, CASE WHEN g >= 20 THEN here WHEN here + cnt >= goal THEN 0 ELSE here + cnt END,
      g + CASE WHEN g < 20 AND here + cnt >= goal THEN 1 ELSE 0 END,
      CASE WHEN g < 20 AND here + cnt >= goal THEN greatest(coalesce(worst, here + cnt - goal), here + cnt - goal) ELSE worst END
    FROM f JOIN c ON c.i = f.i + 1, m)
  SELECT (CASE WHEN here > 0 AND g < 20 THEN greatest(coalesce(worst, here - goal), here - goal) ELSE worst END)::DOUBLE AS overshoot
  FROM f, m ORDER BY i DESC LIMIT 1""")
def split_overshoot(spark, d):
    return extra.split_overshoot(lines(spark, d), "l_extendedprice", 200, 20)


# ---- window cutting ---------------------------------------------------------

@query("split_tiles", f"""
  SELECT o_orderkey, (ntile(7) OVER (ORDER BY {sql_hash(42, 'o_orderkey')}) - 1)::INTEGER AS window_id FROM orders""")
def split_tiles(spark, d):
    return win.split_windows(table(spark, d, "orders"), ["o_orderkey"], 7).select("o_orderkey", "window_id")


@query("split_modulo", f"""
  SELECT o_orderkey, ((row_number() OVER (ORDER BY {sql_hash(42, 'o_orderkey')}) - 1) % 7)::INTEGER AS window_id FROM orders""")
def split_modulo(spark, d):
    return win.split_windows(table(spark, d, "orders"), ["o_orderkey"], 7, mode="round_robin").select(
        "o_orderkey", "window_id")


@query("split_ntile", "SELECT o_orderkey, (ntile(100) OVER (ORDER BY o_orderkey) - 1)::INTEGER AS window_id FROM orders")
def split_ntile(spark, d):
    return win.contiguous_windows(table(spark, d, "orders"), "o_orderkey", 100).select("o_orderkey", "window_id")


_PLAN = """
  WITH c AS (SELECT event_type, count(*) AS cnt FROM events GROUP BY 1),
  n AS (SELECT *, greatest(1, ceil(cnt / 700.0))::BIGINT AS raw FROM c),
  p AS (SELECT event_type, cnt, CASE WHEN raw > 1 AND cnt // raw < 500 THEN greatest(1, cnt // 500) ELSE raw END AS n_windows FROM n),
  plan AS (SELECT *, coalesce(sum(n_windows) OVER (ORDER BY cnt, event_type
     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_window FROM p)"""


@query("subwindow_plan", _PLAN + " SELECT * FROM plan")
def subwindow_plan(spark, d):
    return win.subwindow_plan(table(spark, d, "events"), "event_type", 700, 500)


@query("subwindows", _PLAN + f""",
  r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type
          ORDER BY {sql_hash(42, 'event_id')}) AS rn FROM events)
  SELECT event_id, (first_window + (rn - 1) % n_windows)::INTEGER AS window_id FROM r JOIN plan USING (event_type)""")
def subwindows(spark, d):
    return win.subwindows(table(spark, d, "events"), "event_type", ["event_id"], 700, 500).select("event_id", "window_id")
