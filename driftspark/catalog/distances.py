"""KS, Wasserstein, permutation tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftspark.catalog.base import (
    LINE_FEATURES,
    LINE_KEY,
    lines,
    query,
    rounded,
    sql_hash,
    sql_ks,
    sql_long,
    sql_perm_hash,
    sql_perm_parts,
    sql_projected,
    sql_sides,
    sql_w1,
    sql_z,
    table,
)
from driftspark.functions.hashing import PERM_PRIME
from driftspark.operators import ks
from driftspark.operators import permutation as perm
from driftspark.operators import sketches as sk
from driftspark.operators import wasserstein as ws
from driftspark.operators.drift import swd_by_window
from driftspark.operators.metrics import null_density
from driftspark.plans.workdir import new_path

_SIDES = f"sides AS ({sql_sides(LINE_FEATURES, LINE_KEY)})"
_LONG = sql_long("sides", LINE_FEATURES, "side")


def _ar(spark, d):
    return lines(spark, d, "A"), lines(spark, d, "R")


# ---- KS ---------------------------------------------------------------------

@query("ks_exact", f"WITH {_SIDES} {sql_ks(_LONG)}")
def ks_exact(spark, d):
    return ks.ks_exact(*_ar(spark, d), LINE_FEATURES)


@query("ks_max", f"WITH {_SIDES} SELECT max(ks) AS ks_max FROM ({sql_ks(_LONG)})")
def ks_max(spark, d):
    return ks.ks_max(ks.ks_exact(*_ar(spark, d), LINE_FEATURES))


_P50 = [i / 49 for i in range(50)]


@query("ks_points", f"""
  WITH {_SIDES}, long AS ({_LONG}),
  q AS (SELECT feature, unnest(quantile_cont(v, {_P50!r})) AS p FROM long WHERE side = 0 GROUP BY feature),
  g AS (SELECT q.feature, p, count(*) FILTER (side = 0 AND v <= p) / (count(*) FILTER (side = 0))::DOUBLE AS a,
          count(*) FILTER (side = 1 AND v <= p) / (count(*) FILTER (side = 1))::DOUBLE AS b
        FROM q JOIN long ON q.feature = long.feature GROUP BY q.feature, p)
  SELECT feature, round(max(abs(a - b)), 9) AS ks FROM g GROUP BY feature""")
def ks_points(spark, d):
    return rounded(ks.ks_points(*_ar(spark, d), LINE_FEATURES, exact=True), "ks", digits=9)


@query("ks_points_sketch", " UNION ALL ".join(f"SELECT '{f}' AS feature, true AS close" for f in LINE_FEATURES))
def ks_points_sketch(spark, d):
    """Points from the sketch see at most the exact distance, and miss at most
    what lies between two of them."""
    some = ks.ks_points(*_ar(spark, d), LINE_FEATURES).withColumnRenamed("ks", "sketch")
    return ks.ks_exact(*_ar(spark, d), LINE_FEATURES).join(some, "feature").select(
        "feature", ((F.col("sketch") <= F.col("ks") + 1e-9) & (F.col("sketch") >= F.col("ks") - 0.05)).alias("close"))


# ---- one-dimensional Wasserstein --------------------------------------------

EVENT_KEY = ["event_id"]
_EV = ("SELECT 'value' AS feature, value AS v, CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END AS side "
       "FROM events WHERE event_type IN ('purchase', 'view')")


def _events(spark, d):
    e = table(spark, d, "events")
    return e.where("event_type = 'purchase'"), e.where("event_type = 'view'")


def _w1(spark, d, method):
    return rounded(ws.w1_features(*_events(spark, d), ["value"], EVENT_KEY, method), "w1")


@query("w1_exact", f"SELECT feature, round(w1, 6) AS w1 FROM ({sql_w1(_EV, 'feature')})")
def w1_exact(spark, d):
    return _w1(spark, d, "exact")


_RANKED = f"""r AS (SELECT side, v, row_number() OVER (PARTITION BY side ORDER BY v) - 1 AS k FROM ({_EV})),
  n AS (SELECT count(*) FILTER (side = 0) AS n0, count(*) FILTER (side = 1) AS n1 FROM r)"""


def _at(side: int, num: str, den: str) -> str:
    """SQL value of one side's quantile function at position (n-1) * num/den."""
    k = f"((n{side} - 1) * {num}) // {den}"
    frac = f"(((n{side} - 1) * {num}) % {den}) / {den}::DOUBLE"
    return k, frac


def _level_gap(levels: str, num: str, den: str) -> str:
    k0, f0 = _at(0, num, den)
    k1, f1 = _at(1, num, den)
    return f"""
  x AS (SELECT side, k, v, coalesce(lead(v) OVER (PARTITION BY side ORDER BY k), v) AS v1 FROM r),
  l AS (SELECT *, {k0} AS k0, {f0} AS f0, {k1} AS k1, {f1} AS f1 FROM ({levels}) CROSS JOIN n)
  SELECT 'value' AS feature, round(avg(abs((a.v + (a.v1 - a.v) * f0) - (b.v + (b.v1 - b.v) * f1))), 6) AS w1
  FROM l JOIN x a ON a.side = 0 AND a.k = k0 JOIN x b ON b.side = 1 AND b.k = k1"""


@query("w1_interp", f"WITH {_RANKED}, " + _level_gap(
    "SELECT unnest(range(0, (SELECT greatest(n0, n1) FROM n))) AS i", "i", "(greatest(n0, n1) - 1)"))
def w1_interp(spark, d):
    return _w1(spark, d, "interp")


@query("w1_union", f"WITH {_RANKED}, " + _level_gap(
    "SELECT DISTINCT i // gcd(i, m) AS i, m // gcd(i, m) AS m FROM ("
    "SELECT unnest(range(1, (SELECT n0 FROM n) + 1)) AS i, (SELECT n0 FROM n) AS m UNION ALL "
    "SELECT unnest(range(1, (SELECT n1 FROM n) + 1)), (SELECT n1 FROM n))", "i", "m"))
def w1_union(spark, d):
    return _w1(spark, d, "quantile_union")


_EV_A, _EV_B = "side", "event_id"


@query("w1_sorted", f"""
  WITH e AS (SELECT event_id, value AS v, CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END AS side
             FROM events WHERE event_type IN ('purchase', 'view')),
  h AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY ('0x' || substr(md5('42:' || side || ':' || event_id), 1, 13))::BIGINT) AS rn,
          (SELECT min(c) FROM (SELECT count(*) AS c FROM e GROUP BY side)) AS few FROM e),
  s AS (SELECT side, v, row_number() OVER (PARTITION BY side ORDER BY v) AS k FROM h WHERE rn <= few)
  SELECT 'value' AS feature, round(avg(abs(a.v - b.v)), 6) AS w1 FROM s a JOIN s b ON a.k = b.k AND a.side = 0 AND b.side = 1""")
def w1_sorted(spark, d):
    return _w1(spark, d, "sorted")


# ---- sliced -----------------------------------------------------------------

N_DIRS = 12
_DIRS = ws.directions(N_DIRS, len(LINE_FEATURES), 42)


def _swd_sql(mode: str) -> str:
    return (f"WITH {_SIDES}, z AS ({sql_z('sides', LINE_FEATURES, mode, ['side'])}), "
            f"p AS ({sql_projected('z', LINE_FEATURES, _DIRS, ['side'])}), w AS ({sql_w1('SELECT * FROM p')}) ")


_AVG = "SELECT round(avg(w1), {n}) AS swd FROM w"


@query("projections", f"""WITH {_SIDES}, p AS ({sql_projected('sides', LINE_FEATURES, _DIRS, ['side'])})
  SELECT g AS proj, side, count(*) AS cnt, round(avg(v), 3) AS mean FROM p GROUP BY 1, 2""")
def projections(spark, d):
    both = ks.stack_sides(*_ar(spark, d), LINE_FEATURES)
    wide, names = ws.project(both, LINE_FEATURES, _DIRS, ["side"])
    return (wide.select("side", F.posexplode(F.array(*names)).alias("proj", "v"))
            .groupBy("proj", "side").agg(F.count("*").alias("cnt"), F.round(F.avg("v"), 3).alias("mean")))


@query("swd_directions", _swd_sql("reference") + "SELECT g AS proj, round(w1, 6) AS w1 FROM w")
def swd_directions(spark, d):
    return rounded(ws.swd_directions(*_ar(spark, d), LINE_FEATURES, LINE_KEY, N_DIRS), "w1")


def _swd(spark, d, mode, digits=6):
    return rounded(ws.swd(*_ar(spark, d), LINE_FEATURES, LINE_KEY, n_projections=N_DIRS, standardize=mode),
                   "swd", digits=digits)


@query("swd", _swd_sql("reference") + _AVG.format(n=6))
def swd(spark, d):
    return _swd(spark, d, "reference")


@query("swd_pooled", _swd_sql("pooled") + _AVG.format(n=6))
def swd_pooled(spark, d):
    return _swd(spark, d, "pooled")


@query("swd_self", _swd_sql("self") + _AVG.format(n=6))
def swd_self(spark, d):
    return _swd(spark, d, "self")


@query("swd_raw", _swd_sql("none") + _AVG.format(n=2))
def swd_raw(spark, d):
    return _swd(spark, d, "none", 2)


_VEC = [f"e{i}" for i in range(64)]
_VDIRS = ws.directions(10, 64, 42)


@query("swd_embeddings", f"""
  WITH sides AS (SELECT CASE WHEN label < 5 THEN 0 ELSE 1 END AS side, {', '.join(f'embedding[{i + 1}]::DOUBLE AS e{i}' for i in range(64))} FROM embeddings),
  z AS ({sql_z('sides', _VEC, 'reference', ['side'])}), p AS ({sql_projected('z', _VEC, _VDIRS, ['side'])}), w AS ({sql_w1('SELECT * FROM p')})
  SELECT round(avg(w1), 5) AS swd FROM w""")
def swd_embeddings(spark, d):
    e = table(spark, d, "embeddings").select(
        "vec_id", "label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(_VEC)])
    return rounded(ws.swd(e.where("label < 5"), e.where("label >= 5"), _VEC, ["vec_id"], n_projections=10),
                   "swd", digits=5)


_Y = "(extract('year' FROM l_shipdate) - 1995)::INTEGER"


@query("swd_by_window", f"""
  WITH s AS (SELECT {_Y} AS window_id, {', '.join(LINE_FEATURES)} FROM lineitem),
  m AS (SELECT window_id + 1 AS window_id, {', '.join(f'avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}' for f in LINE_FEATURES)} FROM s GROUP BY window_id),
  b AS (SELECT window_id, 1 AS side, {', '.join(LINE_FEATURES)} FROM s UNION ALL SELECT window_id + 1, 0, {', '.join(LINE_FEATURES)} FROM s),
  z AS (SELECT window_id, side, {', '.join(f'({f} - m_{f}) / s_{f} AS {f}' for f in LINE_FEATURES)} FROM b JOIN m USING (window_id)),
  p AS ({sql_projected('z', LINE_FEATURES, _DIRS, ['side', 'window_id'])}),
  w AS ({sql_w1('SELECT * FROM p', 'window_id, g')})
  SELECT window_id, round(avg(w1), 6) AS swd FROM w WHERE window_id IN (SELECT window_id FROM s) GROUP BY 1""")
def windows_in_a_row(spark, d):
    w = lines(spark, d).withColumn("window_id", F.year("l_shipdate") - 1995)
    return rounded(swd_by_window(w, "window_id", LINE_FEATURES, LINE_KEY, N_DIRS), "swd")


_GAP = "CASE WHEN (extract('year' FROM l_shipdate) - 1995) >= 3 THEN 2 ELSE 0 END + (extract('year' FROM l_shipdate) - 1995)"


@query("windows_with_a_gap", f"""
  WITH s AS (SELECT ({_GAP})::INTEGER AS window_id, {', '.join(LINE_FEATURES)} FROM lineitem),
  o AS (SELECT window_id AS prev, lead(window_id) OVER (ORDER BY window_id) AS window_id FROM (SELECT DISTINCT window_id FROM s)),
  m AS (SELECT o.window_id, {', '.join(f'avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}' for f in LINE_FEATURES)} FROM s JOIN o ON s.window_id = prev WHERE o.window_id IS NOT NULL GROUP BY 1),
  b AS (SELECT window_id, 1 AS side, {', '.join(LINE_FEATURES)} FROM s UNION ALL SELECT o.window_id, 0, {', '.join(LINE_FEATURES)} FROM s JOIN o ON s.window_id = prev),
  z AS (SELECT window_id, side, {', '.join(f'({f} - m_{f}) / s_{f} AS {f}' for f in LINE_FEATURES)} FROM b JOIN m USING (window_id)),
  p AS ({sql_projected('z', LINE_FEATURES, _DIRS, ['side', 'window_id'])}),
  w AS ({sql_w1('SELECT * FROM p', 'window_id, g')})
  SELECT window_id, round(avg(w1), 6) AS swd FROM w GROUP BY 1""")
def windows_with_a_gap(spark, d):
    y = F.year("l_shipdate") - 1995
    w = lines(spark, d).withColumn("window_id", y + F.when(y >= 3, 2).otherwise(0))
    return rounded(swd_by_window(w, "window_id", LINE_FEATURES, LINE_KEY, N_DIRS), "swd")


@query("swd_diagnostics", f"""
  WITH {_SIDES}, z AS ({sql_z('sides', LINE_FEATURES, 'reference', ['side'])}), p AS ({sql_projected('z', LINE_FEATURES, ws.directions(20, 4, 42), ['side'])}), w AS ({sql_w1('SELECT * FROM p')}),
  c AS (SELECT count(*) FILTER (side = 0) AS n_ref, count(*) FILTER (side = 1) AS n_det FROM sides),
  m AS (SELECT count(*) FILTER (a <> b) = 0 AS same FROM (SELECT count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM sides GROUP BY {', '.join(LINE_KEY)}))
  SELECT n_ref, n_det, (SELECT same FROM m) AS identical,
    (SELECT round(max(g), 6)::DOUBLE FROM (SELECT greatest({', '.join(f'max({f}) FILTER (side = {a}) - min({f}) FILTER (side = {1 - a})' for f in LINE_FEATURES for a in (0, 1))}) AS g
       FROM sides GROUP BY {', '.join(LINE_KEY)})) AS max_abs_diff,
    (SELECT round(w1, 6) FROM w WHERE g = 0) AS w1_first, (SELECT round(avg(w1), 6) FROM w) AS w1_mean,
    (SELECT round(stddev_pop(w1), 6) FROM w) AS w1_std FROM c""")
def swd_diagnostics(spark, d):
    r = ws.swd_diagnostics(*_ar(spark, d), LINE_FEATURES, LINE_KEY)
    return rounded(r, "max_abs_diff", "w1_first", "w1_mean", "w1_std")


# ---- stored sketches --------------------------------------------------------

_YEARS = "year(l_shipdate)"


def _year_sketches(spark, d):
    """Sketches of every shipping year, stored in two parts and read back."""
    rows = lines(spark, d).withColumn("y", F.year("l_shipdate"))
    path = new_path(spark, "sketches")
    for part in ("l_linenumber % 2 = 0", "l_linenumber % 2 <> 0"):
        sk.append_sketches(sk.window_sketches(rows.where(part), "y", LINE_FEATURES), path)
    return rows, sk.read_sketches(spark, path)


def _sketch_sql(earlier: str) -> str:
    return (f"WITH w AS (SELECT *, {_YEARS} AS y FROM lineitem), ys AS (SELECT DISTINCT y FROM w), p AS ("
            + " UNION ALL ".join(f"SELECT y, '{f}' AS feature, {f}::DOUBLE AS v FROM w" for f in LINE_FEATURES)
            + f""") SELECT ys.y::INTEGER AS "window", feature, count(*) FILTER (p.y = ys.y) AS n, count(*) FILTER ({earlier}) AS n_before,
    true AS within FROM ys, p GROUP BY ys.y, feature HAVING count(*) FILTER ({earlier}) > 0""")


def _sketch_facts(spark, d, against):
    """Sizes, and whether the distance of the stored sketches lies within the
    error of two such sketches of the exact one."""
    rows, stored = _year_sketches(spark, d)
    years = [r["window"] for r in stored.select("window").distinct().orderBy("window").collect()]
    before = {y: f"y < {y}" if against == "before" else f"y = {x}" for x, y in zip([None, *years], years)}
    samples = [c for y in years[1:] for c in (f"y = {y}", before[y])]
    exact = ks.ks_samples(rows, LINE_FEATURES, "y", samples, [(y, 2 * i, 2 * i + 1) for i, y in enumerate(years[1:])])
    got = sk.sketch_drift(stored, against)
    exact = exact.select(F.col("pair").alias("window"), "feature", F.col("ks").alias("exact"))
    # a bound that holds for 99 of 100 pairs: twice of it for all
    return got.join(exact, ["window", "feature"]).select(
        "window", "feature", "n", "n_before", (F.abs(F.col("ks") - F.col("exact")) <= 2 * sk.ks_error()).alias("within"))


@query("sketch_drift", _sketch_sql("p.y < ys.y"))
def sketch_drift(spark, d):
    return _sketch_facts(spark, d, "before")


@query("sketch_drift_previous", _sketch_sql("p.y = (SELECT max(o.y) FROM ys o WHERE o.y < ys.y)"))
def sketch_drift_previous(spark, d):
    return _sketch_facts(spark, d, "previous")


# ---- permutation test -------------------------------------------------------

PERMS, PDIRS = 30, 6
_PV = ws.directions(PDIRS, len(LINE_FEATURES), 42)
_A, _B = sql_perm_parts(42, "side", *LINE_KEY)


def _null_sql() -> str:
    return f"""
  WITH {_SIDES}, ab AS (SELECT *, {_A} AS a, {_B} AS b, row_number() OVER () AS rid FROM sides),
  z AS ({sql_z('ab', LINE_FEATURES, 'reference', ['side', 'a', 'b', 'rid'])}),
  lab AS (SELECT rid, 0 AS perm, side FROM z UNION ALL
    SELECT rid, perm, CASE WHEN row_number() OVER (PARTITION BY perm ORDER BY {sql_perm_hash('a', 'b', 'perm')}, a)
      <= (SELECT count(*) FROM sides WHERE side = 0) THEN 0 ELSE 1 END
    FROM z, (SELECT unnest(range(1, {PERMS + 1})) AS perm)),
  p AS ({sql_projected('z', LINE_FEATURES, _PV, ['rid'])}),
  w AS ({sql_w1('SELECT perm, g, v, lab.side FROM p JOIN lab USING (rid)', 'perm, g')}),
  dist AS (SELECT perm, avg(w1) AS swd FROM w GROUP BY perm)"""


def _null(spark, d):
    return perm.swd_null(*_ar(spark, d), LINE_FEATURES, LINE_KEY, PDIRS, PERMS)


@query("swd_null", _null_sql() + " SELECT perm::INTEGER AS perm, round(swd, 6) AS swd FROM dist")
def swd_null(spark, d):
    return rounded(_null(spark, d), "swd")


_REPORT = """
  , o AS (SELECT swd AS obs FROM dist WHERE perm = 0), n AS (SELECT swd FROM dist WHERE perm > 0),
  r AS (SELECT obs, avg(swd) AS m, stddev_pop(swd) AS s, min(swd) AS lo, max(swd) AS hi, {p} AS p FROM n, o GROUP BY obs)
  SELECT round(obs, 6) AS swd, round(m, 6) AS null_mean, round(s, 6) AS null_std, round(lo, 6) AS null_min,
    round(hi, 6) AS null_max, round(p, 6) AS p_value, round((obs - m) / (s + 1e-12), 4) AS z_score, p < 0.05 AS drift FROM r"""


def _report(spark, d, rule):
    r = perm.swd_report(_null(spark, d), pvalue=rule)
    return rounded(rounded(r, "swd", "null_mean", "null_std", "null_min", "null_max", "p_value"), "z_score", digits=4)


@query("swd_report", _null_sql() + _REPORT.format(p="(count(*) FILTER (swd > obs) + 1) / (count(*) + 1)"))
def swd_report(spark, d):
    return _report(spark, d, "plus_one")


@query("swd_report_share", _null_sql() + _REPORT.format(p="count(*) FILTER (swd >= obs) / count(*)"))
def swd_report_share(spark, d):
    return _report(spark, d, "ge_mean")


@query("null_density", _null_sql() + """
  , n AS (SELECT swd FROM dist WHERE perm > 0), m AS (SELECT min(swd) AS lo, max(swd) AS hi, count(*) AS n FROM n)
  SELECT least(floor((swd - lo) / (hi - lo) * 10), 9)::INTEGER AS bin, count(*) AS cnt, round(any_value(lo), 6) AS lo,
    round(any_value(hi), 6) AS hi, round(count(*) / (any_value(n) * (any_value(hi) - any_value(lo)) / 10), 4) AS density
  FROM n, m GROUP BY 1""")
def density(spark, d):
    return rounded(rounded(null_density(_null(spark, d), 10), "lo", "hi"), "density", digits=4)


def _balances(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"),
                                           F.col("c_nationkey").cast("double").alias("nation"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal"),
                                           F.col("s_nationkey").cast("double").alias("nation"))
    return c, s, ["bal", "nation"], ["k"]


# the presets on unequal sides; "collected" with a small number of permutations

FRESH_PERMS, FRESH_DIRS = 19, 5
_BALANCES = """sides AS (SELECT 0 AS side, c_custkey AS k, c_acctbal::DOUBLE AS bal, c_nationkey::DOUBLE AS nation FROM customer UNION ALL
    SELECT 1, s_suppkey, s_acctbal::DOUBLE, s_nationkey::DOUBLE FROM supplier)"""


def _fresh_sql(split: str, n_projections: int = FRESH_DIRS, n_permutations: int = FRESH_PERMS) -> str:
    """(perm, swd) with directions of its own for every permutation, given as
    literals; the gap is the mean over the levels i/n0 and j/n1."""
    a, b = sql_perm_parts(42, "side", "k")
    weights = ", ".join(f"({p}, {g}, {float(w[0])!r}, {float(w[1])!r})" for p in range(n_permutations + 1)
                        for g, w in enumerate(ws.directions(n_projections, 2, 42 + p)))
    h = sql_perm_hash("a", "b", "perm")
    first = (f"row_number() OVER (PARTITION BY perm ORDER BY {h}) <= n0" if split == "exact"
             else f"{h} <= floor({PERM_PRIME} * (n0 / (n0 + n1))) - 1")
    return f"""
  WITH {_BALANCES}, size AS (SELECT count(*) FILTER (side = 0) AS n0, count(*) FILTER (side = 1) AS n1 FROM sides),
  dir AS (SELECT * FROM (VALUES {weights}) t(perm, g, w0, w1)),
  ab AS (SELECT *, {a} AS a, {b} AS b FROM sides, size),
  lab AS (SELECT perm, bal, nation, CASE WHEN perm = 0 THEN side WHEN {first} THEN 0 ELSE 1 END AS side
    FROM ab, (SELECT unnest(range(0, {n_permutations + 1})) AS perm)),
  rk AS (SELECT perm, g, side, v, row_number() OVER (PARTITION BY perm, g, side ORDER BY v) - 1 AS k
    FROM (SELECT perm, g, side, bal * w0 + nation * w1 AS v FROM lab JOIN dir USING (perm))),
  cnt AS (SELECT perm, side, count(*) AS n FROM lab GROUP BY ALL),
  lev AS (SELECT DISTINCT perm, i // gcd(i, n) AS i, n // gcd(i, n) AS m FROM (SELECT perm, n, unnest(range(1, n + 1)) AS i FROM cnt)),
  spot AS (SELECT perm, side, i, m, ((n - 1) * i) // m AS k, (((n - 1) * i) % m) / m AS past, n FROM lev JOIN cnt USING (perm)),
  q AS (SELECT spot.perm, spot.side, i, m, x.g, x.v + (y.v - x.v) * past AS q FROM spot
    JOIN rk x ON x.perm = spot.perm AND x.side = spot.side AND x.k = spot.k
    JOIN rk y ON y.perm = x.perm AND y.side = x.side AND y.g = x.g AND y.k = least(spot.k + 1, n - 1)),
  w AS (SELECT a.perm, a.g, avg(abs(a.q - b.q)) AS w1 FROM q a JOIN q b
    ON a.perm = b.perm AND a.g = b.g AND a.i = b.i AND a.m = b.m AND a.side = 0 AND b.side = 1 GROUP BY ALL),
  dist AS (SELECT perm, avg(w1) AS swd FROM w GROUP BY perm)"""


_SHARE = "count(*) FILTER (swd >= obs) / count(*)"


def _preset_report(spark, d, preset, **kw):
    r = perm.swd_test(*_balances(spark, d), preset=preset, **kw)
    return rounded(rounded(r, "swd", "null_mean", "null_std", "null_min", "null_max", "p_value"), "z_score", digits=4)


@query("test_collected", _fresh_sql("exact") + _REPORT.format(p=_SHARE))
def test_collected(spark, d):
    return _preset_report(spark, d, "collected", n_projections=FRESH_DIRS, n_permutations=FRESH_PERMS)


def _preset_sql(preset: str, split: str) -> str:
    """With the numbers of directions and permutations of the preset."""
    p = perm.TEST_PRESETS[preset]
    return _fresh_sql(split, p["n_projections"], p["n_permutations"]) + _REPORT.format(p=_SHARE)


@query("test_frames", _preset_sql("frames", "hash"))
def test_frames(spark, d):
    return _preset_report(spark, d, "frames")


@query("test_fresh", _preset_sql("fresh", "exact"))
def test_fresh(spark, d):
    return _preset_report(spark, d, "fresh")


def _projected_sql() -> str:
    """(perm, swd) of equal-sized sides, each in its own z-scores."""
    a, b = sql_perm_parts(42, "side", "k")
    dirs = ws.directions(50, 2, 42)
    return f"""
  WITH {_BALANCES}, ab AS (SELECT *, {a} AS a, {b} AS b, row_number() OVER () AS rid FROM sides),
  zs AS ({sql_z('ab', ['bal', 'nation'], 'self', ['side', 'k', 'a', 'b', 'rid'])}),
  z AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY {sql_hash(42, 'side', 'k')}) AS rn FROM zs)
    WHERE rn <= (SELECT min(c) FROM (SELECT count(*) AS c FROM sides GROUP BY side))),
  lab AS (SELECT rid, 0 AS perm, side FROM z UNION ALL
    SELECT rid, perm, CASE WHEN row_number() OVER (PARTITION BY perm ORDER BY {sql_perm_hash('a', 'b', 'perm')}) <= (SELECT count(*) FROM z WHERE side = 0) THEN 0 ELSE 1 END
    FROM z, (SELECT unnest(range(1, 100)) AS perm)),
  p AS ({sql_projected('z', ['bal', 'nation'], dirs, ['rid'])}),
  w AS ({sql_w1('SELECT perm, g, v, lab.side FROM p JOIN lab USING (rid)', 'perm, g')}),
  dist AS (SELECT perm, avg(w1) AS swd FROM w GROUP BY perm)"""


@query("test_projected", _projected_sql() + _REPORT.format(p="(count(*) FILTER (swd > obs) + 1) / (count(*) + 1)"))
def test_projected(spark, d):
    return _preset_report(spark, d, "projected", n_permutations=99)
