"""Registry of named queries and the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspark.functions.hashing import PERM_PRIME

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark, sf_dir, flag=None) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    return df if flag is None else df.where(F.col("l_returnflag") == flag)


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


# ---- SQL fragments ----------------------------------------------------------

def sql_digest(seed, *cols) -> str:
    return f"md5(concat_ws(':', '{seed}', " + ", ".join(f"{c}::VARCHAR" for c in cols) + "))"


def sql_hash(seed, *cols) -> str:
    return f"('0x' || substr({sql_digest(seed, *cols)}, 1, 13))::BIGINT"


def sql_unit(seed, *cols) -> str:
    return f"({sql_hash(seed, *cols)} / {float(2**52)!r})"


def sql_perm_parts(seed, *cols) -> tuple[str, str]:
    d = sql_digest(seed, *cols)
    return f"('0x' || substr({d}, 1, 10))::BIGINT", f"('0x' || substr({d}, 11, 10))::BIGINT"


def sql_perm_hash(a, b, perm) -> str:
    return f"(({a} * ({perm} + 1) + {b}) % {PERM_PRIME})"


def sql_long(source: str, features, *keep: str) -> str:
    """Unpivot: (feature, v, keep...)."""
    k = "".join(f", {c}" for c in keep)
    return " UNION ALL ".join(f"SELECT '{f}' AS feature, {f}::DOUBLE AS v{k} FROM {source}" for f in features)


def sql_sides(features, key, flag_col="l_returnflag", ref="A", det="R", source="lineitem") -> str:
    """Side 0 and side 1 of one table."""
    return (f"SELECT CASE WHEN {flag_col} = '{ref}' THEN 0 ELSE 1 END AS side, "
            + ", ".join([*key, *features]) + f" FROM {source} WHERE {flag_col} IN ('{ref}', '{det}')")


def sql_ks(points: str, group: str = "feature") -> str:
    """Exact KS from points(group, v, side)."""
    return f"""
      SELECT {group}, max(abs(a / n0 - b / n1)) AS ks FROM (
        SELECT {group},
          (sum(c0) OVER w)::DOUBLE AS a, (sum(c1) OVER w)::DOUBLE AS b,
          (sum(c0) OVER (PARTITION BY {group}))::DOUBLE AS n0,
          (sum(c1) OVER (PARTITION BY {group}))::DOUBLE AS n1
        FROM (SELECT {group}, v, sum(CASE WHEN side = 0 THEN 1 ELSE 0 END) AS c0,
                     sum(CASE WHEN side = 1 THEN 1 ELSE 0 END) AS c1
              FROM ({points}) GROUP BY {group}, v)
        WINDOW w AS (PARTITION BY {group} ORDER BY v))
      GROUP BY {group}"""


def sql_w1(points: str, group: str = "g") -> str:
    """Exact W1 from points(group, v, side)."""
    return f"""
      SELECT {group}, sum(abs(s0 / n0 - s1 / n1) * (nv - v)) AS w1 FROM (
        SELECT {group}, v,
          (sum(CASE WHEN side = 0 THEN 1 ELSE 0 END) OVER w)::DOUBLE AS s0,
          (sum(CASE WHEN side = 1 THEN 1 ELSE 0 END) OVER w)::DOUBLE AS s1,
          (sum(CASE WHEN side = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY {group}))::DOUBLE AS n0,
          (sum(CASE WHEN side = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY {group}))::DOUBLE AS n1,
          lead(v) OVER w AS nv
        FROM ({points}) WINDOW w AS (PARTITION BY {group} ORDER BY v))
      WHERE nv IS NOT NULL GROUP BY {group}"""


def sql_z(source: str, features, mode: str, keep) -> str:
    """z-scores of the sides in CTE ``source``."""
    k = ", ".join(keep)
    if mode == "none":
        return f"SELECT {k}, " + ", ".join(f"{f}::DOUBLE AS {f}" for f in features) + f" FROM {source}"
    on = {"reference": "WHERE side = 0", "pooled": "", "self": "GROUP BY side"}[mode]
    stats = ", ".join(f"avg({f}) AS m_{f}, CASE WHEN stddev_pop({f}) = 0 THEN 1.0 ELSE stddev_pop({f}) END AS s_{f}"
                      for f in features)
    side = "side AS st_side, " if mode == "self" else ""
    cond = "ON side = st_side" if mode == "self" else "ON true"
    return (f"SELECT {k}, " + ", ".join(f"({f} - m_{f}) / s_{f} AS {f}" for f in features)
            + f" FROM {source} JOIN (SELECT {side}{stats} FROM {source} {on}) st {cond}")


def sql_projected(source: str, features, dirs, keep) -> str:
    """(g, v, keep...): dot products with literal directions."""
    k = "".join(f", {c}" for c in keep)
    return " UNION ALL ".join(
        f"SELECT {i} AS g, " + " + ".join(f"{f} * {float(w)!r}" for f, w in zip(features, d))
        + f" AS v{k} FROM {source}" for i, d in enumerate(dirs))
