"""Machine-sensor data with injected anomalies, generated on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Base range, noise deviation and drift range per sensor.
BASE = {"temperature": (48.0, 55.0), "vibration": (0.48, 0.6),
        "pressure": (101.25, 101.35), "humidity": (29.5, 30.8)}
NOISE = {"temperature": 0.5, "vibration": 0.02, "pressure": 0.02, "humidity": 0.5}
DRIFT = {"temperature": (5.0, 8.0), "vibration": (0.1, 0.15)}
START = "2026-02-24 11:00:00"


def _unit(seed: int, name: str, *key: str) -> Column:
    h = F.xxhash64(F.lit(seed), F.lit(name), *[F.col(k) for k in key])
    return F.shiftrightunsigned(h, 11) / F.lit(float(2**53))


def _uniform(lo: float, hi: float, *args) -> Column:
    return _unit(*args) * (hi - lo) + lo


def _normal(seed: int, name: str, *key: str) -> Column:
    u = F.greatest(_unit(seed, name + "/r", *key), F.lit(1e-16))
    return F.sqrt(-2.0 * F.log(u)) * F.cos(2.0 * F.pi() * _unit(seed, name + "/a", *key))


def _readings(df: DataFrame, seed: int, anomaly_prob: float) -> DataFrame:
    key = ("machine_id", "step")
    df = df.withColumns({f"base_{c}": _uniform(lo, hi, seed, "base " + c, "machine_id")
                         for c, (lo, hi) in BASE.items()})
    odd = _unit(seed, "odd", *key) < anomaly_prob
    kind = F.when(_unit(seed, "kind", *key) < 0.5, "drift").otherwise("stuck")
    df = df.withColumn("anomaly_type", F.when(odd, kind).otherwise("none"))
    df = df.withColumn("anomaly", F.when(F.col("anomaly_type") == "none", 0).otherwise(1))

    def reading(c):
        v = F.col(f"base_{c}") + F.lit(NOISE[c]) * _normal(seed, c, *key)
        if c in DRIFT:
            v = v + F.when(F.col("anomaly_type") == "drift",
                           _uniform(*DRIFT[c], seed, "drift " + c, *key)).otherwise(0.0)
        return v

    return df.withColumns({c: reading(c) for c in BASE})


def _output(df: DataFrame) -> DataFrame:
    return df.select("timestamp", "machine_id", *[F.round(c, 6).alias(c) for c in BASE],
                     "anomaly", "anomaly_type")


def sensor_hour(spark: SparkSession, n_machines: int = 5, start: str = START, seconds: int = 3600,
                anomaly_prob: float = 0.1, seed: int = 42) -> DataFrame:
    """One hour per machine in steps of 5 to 14 s. A stuck sensor repeats its
    last emitted vibration."""
    most = seconds // 5 + 1
    grid = spark.range(n_machines * most).select(
        F.floor(F.col("id") / most).cast("int").alias("machine_id"), F.pmod("id", F.lit(most)).alias("step"))
    order = Window.partitionBy("machine_id").orderBy("step")
    gap = 5 + F.floor(_unit(seed, "gap", "machine_id", "step") * 10)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    df = (grid.withColumn("_gap", gap)
          .withColumn("_at", F.coalesce(F.sum("_gap").over(before), F.lit(0)))
          .where(F.col("_at") < seconds))
    df = _readings(df, seed, anomaly_prob)
    moving = F.when(F.col("anomaly_type") != "stuck", F.col("vibration"))
    df = df.withColumn("vibration", F.coalesce(F.last(moving, ignorenulls=True).over(order),
                                               F.col("base_vibration")))
    at = F.timestamp_seconds(F.unix_timestamp(F.lit(start).cast("timestamp")) + F.col("_at"))
    return _output(df.withColumn("timestamp", at))


def sensor_ten_minutes(spark: SparkSession, rows: int = 500_000, n_machines: int = 5, start: str = START,
                       anomaly_prob: float = 0.1, seed: int = 42) -> DataFrame:
    """``rows`` readings spread evenly over ten minutes; a stuck sensor shows
    its base vibration."""
    each = rows // n_machines
    df = spark.range(each * n_machines).select(
        F.floor(F.col("id") / each).cast("int").alias("machine_id"), F.pmod("id", F.lit(each)).alias("step"))
    df = _readings(df, seed, anomaly_prob)
    df = df.withColumn("vibration", F.when(F.col("anomaly_type") == "stuck", F.col("base_vibration"))
                       .otherwise(F.col("vibration")))
    micros = F.floor(_unit(seed, "at", "machine_id", "step") * 600_000_000).cast("long")
    start_s = F.unix_timestamp(F.lit(start).cast("timestamp"))
    return _output(df.withColumn("timestamp", F.timestamp_micros(start_s * 1_000_000 + micros)))
