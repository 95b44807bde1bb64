"""Ordered buckets: exact ranks, prefix sums and order statistics without a
one-task window or a global sort.

A window without ``partitionBy`` (or with a huge partition) sends all its rows
to one task. Here an order-preserving bucket splits the value axis; a small
histogram gives what lies before each bucket; only the rows of the buckets
that matter are sorted, each bucket on its own. Results are exact for any
choice of cut points: the cuts steer balance only.

The number of cut points is fixed by arguments, so what reaches the driver, a
plan or a broadcast does not grow with the rows. Buckets that are still too
large are opened in rounds: :func:`order_statistics` cuts those that hold a
wanted rank anew, :func:`subdivided` cuts every bucket into spans inside Spark.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftspark.functions.hashing import HASH_BITS, hash_key

# Rows looked at when cut points are estimated, at least.
CUT_SAMPLE_ROWS = 50_000
# Rows of a bucket that are sorted in one place, about, at most: larger buckets are opened.
ROWS_PER_BUCKET = 1_000_000
# Fewer rows are not worth a task.
ROWS_PER_TASK = 1024
# Parts an opened bucket is cut into for one rank.
PARTS = 64
# Spans a bucket is cut into, at most.
MOST_SPANS = 2**20
# Above every real bucket.
NULL_BUCKET = 2**30
# Parts a hot value is spread over.
SALTS = 64


def bucket_bits(spark: SparkSession) -> int:
    """log2 of the number of hash buckets: about twice the shuffle width, which
    a session sets by the size of its data."""
    width = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(5, (2 * width - 1).bit_length())


def by_value(df: DataFrame, cols: Sequence[str], n: int, rows: int) -> DataFrame:
    """About ``rows`` of ``n`` rows, chosen by a hash of their values: the same
    rows whatever the partitioning. Good to steer balance, not for estimates:
    equal rows are in or out together."""
    if n <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in cols]), F.lit(2**40)) < int(2**40 * rows / n))


def spread(df: DataFrame, *key: str, n: int | None = None) -> DataFrame:
    """Even partitions by row key, ahead of steps that multiply the rows: one
    shuffle of the rows themselves, small beside what follows, so that neither
    a few large input files nor a skewed layout decides the parallelism. Of
    ``n`` rows, if known, none gets much fewer than ROWS_PER_TASK."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(width if n is None else max(1, min(width, n // ROWS_PER_TASK)), *key)


def no_nan(c: str | Column) -> Column:
    """Double value with NaN turned into null."""
    v = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(v), v)


def fit_cuts(df: DataFrame, cols: Sequence[str], n_buckets: int,
             n: int | None = None) -> dict[str, list[float]]:
    """Approximate quantile cut points per column, one aggregate job.

    A value met by two neighbouring quantiles is hot: it also gets a cut just
    above it, so that it sits alone in its bucket. Such a bucket never needs
    sorting, whatever share of the rows it holds. ``n`` saves a count when the
    number of rows is known.
    """
    if n_buckets < 2:
        return {c: [0.0] for c in cols}
    n = df.count() if n is None else n
    df = by_value(df, df.columns, n, max(CUT_SAMPLE_ROWS, 20 * n_buckets))
    probs = ", ".join(f"{i / n_buckets!r}D" for i in range(1, n_buckets))
    # NaN as null; quantiles are looked for in ordinary values only
    row = df.selectExpr(*[
        f"percentile_approx(nullif(cast(`{c}` AS double), double('NaN')), array({probs}), {4 * n_buckets}) AS q{i}"
        for i, c in enumerate(cols)]).first()
    cuts = {}
    for i, c in enumerate(cols):
        q = [v for v in (row[f"q{i}"] or []) if math.isfinite(v)]
        hot = [a for a, b in zip(q, q[1:]) if a == b]
        cuts[c] = sorted(set(q) | {math.nextafter(v, math.inf) for v in hot}) or [0.0]
    return cuts


def to_long(df: DataFrame, cols: Sequence[str], cuts: dict[str, list[float]],
            keep: Sequence[str] = (), keep_nulls: bool = False,
            salt: str | None = None) -> DataFrame:
    """Unpivot ``cols`` to ``(feature_id, value, bucket)`` rows.

    ``feature_id`` is the position in ``cols``. A null goes to the bucket
    above all others, or is left out. With ``salt`` (a column that differs
    from row to row) the bucket of a hot value is spread over ``SALTS``
    buckets: all its values are equal, so any order among them is right.
    """
    ids = range(len(cols))
    extra = [f"cast(pmod({salt}, {SALTS}) AS int) AS _salt"] if salt else []
    wide = df.selectExpr(*keep, *extra, *[
        f"nullif(cast(`{c}` AS double), double('NaN')) AS _val{i}" for i, c in enumerate(cols)])
    wide = Bucketizer(
        inputCols=[f"_val{i}" for i in ids], outputCols=[f"_bkt{i}" for i in ids],
        splitsArray=[[-math.inf, *cuts[c], math.inf] for c in cols], handleInvalid="keep",
    ).transform(wide)

    def bucket(i):
        b = f"cast(_bkt{i} AS int)"
        if salt:
            hot = ", ".join(f"{v!r}D" for v in hot_values(cuts[cols[i]]))
            b = f"{b} * {SALTS}" + (f" + CASE WHEN _val{i} IN ({hot}) THEN _salt ELSE 0 END" if hot else "")
        return f"coalesce({b}, {NULL_BUCKET})"

    cells = ", ".join(f"named_struct('feature_id', {i}, 'value', _val{i}, 'bucket', {bucket(i)})" for i in ids)
    long = wide.selectExpr(*keep, f"inline(array({cells}))")
    return long if keep_nulls else long.where("value IS NOT NULL")


def hot_values(cuts: Sequence[float]) -> list[float]:
    """Values that :func:`fit_cuts` put in a bucket of their own."""
    return [a for a, b in zip(cuts, cuts[1:]) if b == math.nextafter(a, math.inf)]


def subdivided(rows: DataFrame, n: int, n_buckets: int, value: str = "value",
               on: Sequence[str] = ("feature_id", "bucket"), most: int | None = None) -> DataFrame:
    """``rows`` with the buckets (last column of ``on``) of a table of ``n``
    rows cut into equal spans of about ``most`` rows, in the same order.

    A table whose ``n_buckets`` hold few rows each stays as it is. The counts
    that are sent to every task are one row a bucket, as many as arguments say.
    """
    most = most or ROWS_PER_BUCKET
    if n <= n_buckets * most:
        return rows
    bucket, v = on[-1], F.col(value)
    hist = rows.groupBy(*(F.col(c).alias(f"_on{i}") for i, c in enumerate(on))).agg(F.count("*").alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    spans = F.least(F.ceil(F.col("_n") / most), F.lit(MOST_SPANS)).cast("double")
    spread_out = (F.col("_hi") > F.col("_lo")) & (F.abs("_lo") < math.inf) & (F.abs("_hi") < math.inf) & (F.col("_hi") - F.col("_lo") < math.inf)
    # one rounding after another keeps the order of the values
    span = F.when(spread_out, F.least(F.floor((v - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * spans), spans - 1)).otherwise(0)
    same = [F.col(c).eqNullSafe(F.col(f"_on{i}")) for i, c in enumerate(on)]
    return rows.join(F.broadcast(hist), same).select(
        *[c for c in rows.columns if c != bucket], (F.col(bucket).cast("long") * MOST_SPANS + span.cast("long")).alias(bucket))


def running(hist: DataFrame, group: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Add ``<c>_before`` (exclusive running sum over buckets) and ``<c>_all``.

    ``hist`` has one row per (group, bucket), so the window is as small as the
    number of buckets.
    """
    part = "PARTITION BY " + (", ".join(group) or "0")
    before = f"{part} ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return hist.selectExpr(
        "*", *[f"coalesce(sum({c}) OVER ({before}), 0) AS {c}_before" for c in sums],
        *[f"sum({c}) OVER ({part}) AS {c}_all" for c in sums])


def feature_name(names: Sequence[str]) -> Column:
    """Name of ``feature_id`` as a string column."""
    quoted = ", ".join("'" + n.replace("'", "\\'") + "'" for n in names)
    return F.expr(f"element_at(array({quoted}), feature_id + 1)")


def order_statistics(long: DataFrame, ranks: Callable[[int, int], Sequence[int]]):
    """Exact values at given 1-based ranks, per ``feature_id``.

    ``ranks(feature_id, n)`` names the ranks wanted once the row count is
    known. Returns ``({(feature_id, rank): value}, {feature_id: n})``. A
    histogram finds the buckets that hold a wanted rank. One of more than
    ROWS_PER_BUCKET rows is opened: a sketch cuts it into PARTS, these are
    counted, and the part of the rank is opened in turn, until it holds a
    single value or few enough rows to be sorted. What reaches the driver is
    bounded by features x (buckets + PARTS x ranks) a round, whatever the
    number of rows.
    """
    hist = (long.groupBy("feature_id", "bucket")
            .agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
            .collect())
    by_feature: dict[int, list] = {}
    for r in hist:
        by_feature.setdefault(r["feature_id"], []).append(r)
    found, totals, opened = {}, {}, []
    for fid, rows in by_feature.items():
        rows.sort(key=lambda r: r["bucket"])
        totals[fid] = sum(r["n"] for r in rows)
        for r, before, held in _holders(rows, sorted(set(ranks(fid, totals[fid])))):
            if r["lo"] == r["hi"]:
                found |= {(fid, k): r["lo"] for k in held}
            else:
                opened.append((fid, r["bucket"], r["lo"], r["hi"], r["n"], before, held))
    wanted = [o for o in opened if o[4] <= ROWS_PER_BUCKET]
    large = [o for o in opened if o[4] > ROWS_PER_BUCKET]
    while large:
        larger = []
        for (fid, bucket, *_, base, held), parts in zip(large, _parts(long, large)):
            for r, before, inner in _holders(parts, held, base):
                if r["lo"] == r["hi"]:
                    found |= {(fid, k): r["lo"] for k in inner}
                else:
                    (wanted if r["n"] <= ROWS_PER_BUCKET else larger).append(
                        (fid, bucket, r["lo"], r["hi"], r["n"], before, inner))
        large = larger
    if wanted:
        places = [(i, *w[:4]) for i, w in enumerate(wanted)]
        names = [(i, k - w[5]) for i, w in enumerate(wanted) for k in w[6]]
        ranked = _inside(long, places).selectExpr("slot", "value", "row_number() OVER (PARTITION BY slot ORDER BY value) AS rn")
        asked = long.sparkSession.createDataFrame(names, "slot int, rn int")
        for r in ranked.join(F.broadcast(asked), ["slot", "rn"]).collect():
            fid, *_, before, _ = wanted[r["slot"]]
            found[fid, before + r["rn"]] = r["value"]
    return found, totals


def _holders(rows, todo: Sequence[int], before: int = 0):
    """(row, rows before it, wanted ranks in it) of ordered counts."""
    todo = list(todo)
    for r in rows:
        held = []
        while todo and todo[0] <= before + r["n"]:
            held.append(todo.pop(0))
        if held:
            yield r, before, held
        before += r["n"]


def _inside(long: DataFrame, places: Sequence[tuple]) -> DataFrame:
    """(slot, value) of the rows in ``places`` (slot, feature, bucket, lo, hi):
    as many as there are wanted ranks at most, so they are sent to every task."""
    few = long.sparkSession.createDataFrame([(i, f, b, float(lo), float(hi)) for i, f, b, lo, hi in places],
                                            "slot int, feature_id int, bucket long, lo double, hi double")
    on = (long["feature_id"] == few["feature_id"]) & (long["bucket"] == few["bucket"]) & long["value"].between(few["lo"], few["hi"])
    return long.join(F.broadcast(few), on).select("slot", long["value"])


def _parts(long: DataFrame, large: Sequence[tuple]) -> list[list]:
    """Ordered counts of the parts of every opened bucket."""
    rows = _inside(long, [(i, *o[:4]) for i, o in enumerate(large)])
    probs = [i / PARTS for i in range(1, PARTS)]
    cuts = {r["slot"]: sorted({c for v in r["q"] for c in (float(v), math.nextafter(float(v), math.inf))})
            for r in rows.groupBy("slot").agg(F.percentile_approx("value", probs, 8 * PARTS).alias("q")).collect()}
    table = long.sparkSession.createDataFrame(list(cuts.items()), "slot int, cuts array<double>")
    part = F.size(F.filter("cuts", lambda c: c <= F.col("value")))
    counted = (rows.join(F.broadcast(table), "slot").select("slot", part.alias("part"), "value").groupBy("slot", "part")
               .agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).collect())
    out: list[list] = [[] for _ in large]
    for r in sorted(counted, key=lambda r: r["part"]):
        out[r["slot"]].append(r)
    return out


def ntile_ends(n: int, k: int) -> list[int]:
    """Last rank of each of the first k-1 tiles; the first n mod k are longer."""
    size, extra = divmod(n, k)
    return [(i + 1) * size + min(i + 1, extra) for i in range(k - 1)]


def hash_long(df: DataFrame, key: Sequence[str], seed: int) -> DataFrame:
    """Hash keys as a one-feature long frame, bucketed by their top bits."""
    shift = HASH_BITS - bucket_bits(df.sparkSession)
    return (df.select(F.lit(0).alias("feature_id"), hash_key(key, seed).alias("value"))
            .withColumn("bucket", F.shiftright("value", shift).cast("int")))


def tile_by_cuts(df: DataFrame, value: Column, cuts: Sequence[float], out: str,
                 null_tile: int | None = None) -> DataFrame:
    """Number of cuts below ``value`` (0-based tile), a binary search per row.
    A null value gets ``null_tile``."""
    if not cuts:
        return df.withColumn(out, F.lit(0))
    inner = sorted({math.nextafter(float(c), math.inf) for c in cuts})
    tile = F.col("_tile").cast("int")
    if null_tile is not None:
        tile = F.coalesce(tile, F.lit(null_tile))
    return (Bucketizer(inputCol="_tile_in", outputCol="_tile",
                       splits=[-math.inf, *inner, math.inf], handleInvalid="keep")
            .transform(df.withColumn("_tile_in", value.cast("double")))
            .withColumn(out, tile)
            .drop("_tile_in", "_tile"))


def group_key(by: Sequence[str]) -> Column:
    """The group columns as one value that is never null itself, so that a
    join on it keeps groups whose columns are null."""
    return F.struct(*[F.col(c) for c in by]) if by else F.lit(0)


def hash_tile_cuts(df: DataFrame, key: Sequence[str], k: int, seed: int) -> tuple[list[int], int]:
    """Hash keys at the tile borders of :func:`hash_tiles`, and the row count."""
    def ranks(_, n):
        # with fewer rows than tiles only the first n tiles get a row
        return [r for r in ntile_ends(n, k) if r < n]

    found, totals = order_statistics(hash_long(df, key, seed), ranks)
    n = totals.get(0, 0)
    return [found[0, r] for r in sorted(set(ranks(0, n)))], n


def hash_tiles(df: DataFrame, key: Sequence[str], k: int, seed: int, out: str) -> DataFrame:
    """Split rows at random into ``k`` tiles whose sizes differ by at most one.

    The tile borders are order statistics of the hash key, so no row is moved
    and nothing is sorted but the few buckets a border falls into. Rows with
    an equal key share a tile.
    """
    cuts, _ = hash_tile_cuts(df, key, k, seed)
    return tile_by_cuts(df, hash_key(key, seed), cuts, out)


def smallest(df: DataFrame, key: Sequence[str], n: int, seed: int) -> DataFrame:
    """``n`` rows chosen at random: those with the smallest hash keys. Rows
    that share the last key are taken in the order of their other values."""
    found, totals = order_statistics(hash_long(df, key, seed),
                                     lambda _, total: [n, n + 1] if 0 < n < total else [])
    if n <= 0:
        return df.limit(0)
    if (0, n) not in found:
        return df
    last, h = found[0, n], hash_key(key, seed)
    if found[0, n + 1] != last:
        return df.where(h <= F.lit(last))
    # a repeated key at the border: the rows of this one key are put in order
    below = df.where(h < F.lit(last))
    left = n - below.count()
    others = [f.name for f in df.schema if f.dataType.typeName() not in ("map", "variant")]
    order = Window.partitionBy("_h").orderBy(*[F.col(f"`{c}`") for c in dict.fromkeys([*key, *others])])
    at = (df.where(h == F.lit(last)).withColumn("_h", h).withColumn("_n", F.row_number().over(order))
          .where(F.col("_n") <= left).drop("_h", "_n"))
    return below.unionByName(at)


def hash_rank(df: DataFrame, key: Sequence[str], seed: int, by: Sequence[str] = (),
              ties: Sequence[str] = (), out: str = "rank",
              carry: DataFrame | None = None) -> DataFrame:
    """Exact 1-based rank in hash order, inside each group of ``by``.

    Rows move once, by (group, hash bucket): a group holding a third of the
    table is still spread over all buckets. ``carry`` is a frame keyed by
    ``by``; its other columns travel with the bucket offsets, so attaching
    per-group values costs no further join on a skewed key.
    """
    shift = HASH_BITS - bucket_bits(df.sparkSession)
    group = group_key(by)
    keyed = (df.withColumn("_g", group).withColumn("_h", hash_key(key, seed))
             .withColumn("bucket", F.shiftright("_h", shift).cast("int")))
    offsets = running(keyed.groupBy("_g", "bucket").agg(F.count("*").alias("_n")), ["_g"], ["_n"])
    offsets = offsets.select("_g", "bucket", "_n_before", "_n_all")
    if carry is not None:
        extra = [c for c in carry.columns if c not in by]
        offsets = offsets.join(carry.select(group.alias("_g"), *extra), "_g")
    w = Window.partitionBy("_g", "bucket").orderBy("_h", *key, *ties)
    return (keyed.join(offsets, ["_g", "bucket"])
            .withColumn(out, F.row_number().over(w) + F.col("_n_before"))
            .withColumnRenamed("_n_all", f"{out}_total")
            .drop("_g", "_h", "bucket", "_n_before"))
