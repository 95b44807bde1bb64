"""Training and drift handling: facts about models and runs that SQL can state,
else row counts; the rest is checked by tests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftspark.catalog.base import LINE_FEATURES, LINE_KEY, lines, query, sql_hash, sql_unit, table
from driftspark.functions.hashing import HASH_BITS, hash_unit
from driftspark.operators import learn
from driftspark.operators import metrics as met
from driftspark.operators.drift import DriftTest, Learning, Roles, WindowLoop
from driftspark.operators.ensemble import MODEL_TYPES
from driftspark.operators.sampling import adaptive_sample, assign_blocks, split
from driftspark.plans.workdir import new_path

KEY = ["o_orderkey"]
FEATURES = ["o_totalprice", "o_custkey", "month", "noise"]


def orders(spark, d):
    """Orders with a label that depends on price, season and some noise."""
    noise = hash_unit(KEY, 11)
    return table(spark, d, "orders").select(
        "o_orderkey", "o_orderdate", "o_totalprice", F.col("o_custkey").cast("double").alias("o_custkey"),
        F.month("o_orderdate").cast("double").alias("month"), noise.alias("noise")).withColumn(
        "label", ((F.col("o_totalprice") / 500000 + F.col("month") / 24 + hash_unit(KEY, 12) / 3) > 0.85).cast("int"))


@query("train_all", " UNION ALL ".join(f"SELECT '{t}' AS model_type, true AS learns, true AS whole" for t in MODEL_TYPES))
def train_all(spark, d):
    """Every model type is fitted, does better than chance on the other rows,
    and its figures lie between 0 and 1."""
    fit, check = split(orders(spark, d), KEY)
    t = learn.metrics_table(spark, learn.fit_all(fit, check, FEATURES, "label"))
    return t.select("model_type", (F.col("auc") > 0.6).alias("learns"),
                    (F.col("f1").between(0, 1) & F.col("accuracy").between(0, 1)).alias("whole"))


@query("train_best", "SELECT true AS is_best, true AS one")
def train_best(spark, d):
    fit, check = split(orders(spark, d), KEY)
    fitted = learn.fit_all(fit, check, FEATURES, "label", scale="none", types=["dt", "lr"])
    all_ = learn.metrics_table(spark, fitted)
    most = max(f.auc for f in fitted)
    return learn.pick_best(all_).agg(F.bool_and(F.col("auc") == most).alias("is_best"), (F.count("*") == 1).alias("one"))


def _members(spark, d):
    df = orders(spark, d)
    models = [learn.build_model(FEATURES, "label", t).fit(df) for t in ("dt", "lr")]
    return df, models


@query("ensemble_scores", "SELECT o_orderkey, true AS in_range, true AS agrees FROM orders")
def ensemble_scores(spark, d):
    df, models = _members(spark, d)
    s = learn.ensemble_predict(df, list(zip(models, [1 / 3, 2 / 3])))
    return s.select("o_orderkey", F.col("ensemble_score").between(0, 1).alias("in_range"),
                    ((F.col("ensemble_score") >= 0.5).cast("double") == F.col("ensemble_prediction")).alias("agrees"))


@query("ensemble_scores_joined", "SELECT o_orderkey, true AS same FROM orders")
def ensemble_scores_joined(spark, d):
    df, models = _members(spark, d)
    parts = [learn.model_scores(df, KEY, m, f"p{i}") for i, m in enumerate(models)]
    out = learn.ensemble_by_join(df.select("o_orderkey", "label"), KEY, parts, ["p0", "p1"], [1 / 3, 2 / 3], merge=True)
    chained = learn.ensemble_predict(df, list(zip(models, [1 / 3, 2 / 3]))).select("o_orderkey", F.col("ensemble_score").alias("chained"))
    return out.join(chained, "o_orderkey").select("o_orderkey", (F.abs(F.col("ensemble_score") - F.col("chained")) < 1e-12).alias("same"))


@query("ensemble_metrics", "SELECT true AS auc, true AS f1, true AS accuracy")
def ensemble_metrics(spark, d):
    """The evaluators agree with the exact figures of the scored rows."""
    df, models = _members(spark, d)
    members = list(zip(models, [1 / 3, 2 / 3]))
    m, s = learn.evaluate_ensemble(df, members, "label"), learn.ensemble_predict(df, members)
    exact = {"auc": met.auc(s, "label", "ensemble_score"), "f1": met.weighted_f1(s, "label", "ensemble_prediction"),
             "accuracy": met.accuracy(s, "label", "ensemble_prediction")}
    return spark.range(1).select(*[F.lit(bool(abs(v.first()[k] - m[k]) < 1e-9)).alias(k) for k, v in exact.items()])


@query("compare_training", " UNION ALL ".join(f"SELECT '{p}' AS training_data, '{t}' AS model_type, true AS learns, true AS close, true AS timed"
                                              for p in ("full", "sample") for t in MODEL_TYPES))
def compare_training(spark, d):
    """All four model types learn from all rows; from the sample too, at less
    than a tenth of the area under the curve, but for the boosted trees, whose
    leaves ask for 500 rows each, more than a small sample has."""
    df = orders(spark, d)
    sample = adaptive_sample(df, FEATURES, KEY)
    c = F.col
    few = (c("training_data") == "sample") & (c("model_type") == "gbt")
    full = F.max(F.when(c("training_data") == "full", c("auc"))).over(Window.partitionBy("model_type"))
    return learn.compare_training(df, sample, FEATURES, "label", KEY).select(
        "training_data", "model_type", (few | (c("auc") > 0.6)).alias("learns"), (few | (F.abs(c("auc") - full) < 0.1)).alias("close"), (c("seconds") > 0).alias("timed"))


@query("rescore_saved", " UNION ALL ".join(f"SELECT '{m}' AS model, '{p}' AS data, true AS learns, true AS same"
                                           for m in ("dt", "lr") for p in ("sample", "test")))
def rescore_saved(spark, d):
    """A model read back scores each part as the fitted one did."""
    df = orders(spark, d)
    fit, check = split(df, KEY)
    base = new_path(spark, "models")
    paths = {t: f"{base}/{t}" for t in ("dt", "lr")}
    models = {t: learn.build_model(FEATURES, "label", t, model_set="notebook", scale="std").fit(fit) for t in paths}
    for t, p in paths.items():
        learn.save_model(models[t], p)
    parts = {"sample": adaptive_sample(df, FEATURES, KEY), "test": check}
    before = [(t, p, learn.evaluators("label")["auc"].evaluate(m.transform(rows).withColumn("label", F.col("label").cast("double"))))
              for t, m in models.items() for p, rows in parts.items()]
    before = spark.createDataFrame(before, "model string, data string, fitted double")
    return learn.rescore_saved(paths, parts, "label").join(before, ["model", "data"]).select(
        "model", "data", (F.col("auc") > 0.6).alias("learns"), (F.abs(F.col("auc") - F.col("fitted")) < 1e-9).alias("same"))


@query("static_baseline", """SELECT extract('year' FROM o_orderdate)::INTEGER - 1995 AS "window", count(*) AS cnt, true AS good FROM orders GROUP BY 1""")
def static_baseline(spark, d):
    """Trained on the first year, tested on every year."""
    df = orders(spark, d).withColumn("window", F.year("o_orderdate") - 1995)
    model = learn.static_baseline(df.where("window = 0"), FEATURES, "label", KEY)
    return model.transform(df).groupBy("window").agg(
        F.count("*").alias("cnt"), (F.avg((F.col("prediction") == F.col("label")).cast("double")) > 0.6).alias("good"))


def block_trees(spark, d):
    df = orders(spark, d)
    fit, check = split(df, KEY)
    return learn.block_trees(assign_blocks(fit, KEY, 5), check, FEATURES, "label", KEY, range(5))


@query("block_trees", f"""
  SELECT o_orderkey, (o_totalprice / 500000 + extract('month' FROM o_orderdate) / 24 + {sql_unit(12, 'o_orderkey')} / 3 > 0.85)::INTEGER AS label,
    true AS voted, true AS learns FROM orders WHERE {sql_hash(42, 'o_orderkey')} >= {int(0.8 * 2**HASH_BITS)}""")
def block_votes(spark, d):
    """Every test row gets a vote, and over two thirds of the votes are right."""
    votes = block_trees(spark, d)
    right = votes.agg(F.avg((F.col("vote") == F.col("label")).cast("double"))).first()[0]
    return votes.select("o_orderkey", "label", F.col("vote").isin(0, 1).alias("voted"), F.lit((right or 0) > 2 / 3).alias("learns"))


@query("kmeans_on_sample", "SELECT 4 AS clusters, true AS whole")
def kmeans_on_sample(spark, d):
    sample = adaptive_sample(lines(spark, d), LINE_FEATURES, LINE_KEY)
    n = sample.count()
    return learn.cluster(sample, LINE_FEATURES, 4)[1].agg(F.count("*").cast("int").alias("clusters"), (F.sum("size") == n).alias("whole"))


def _loop(spark, d):
    """Windows by year, the last ones with shifted prices: cold start, quiet
    windows, drift, retraining."""
    df = orders(spark, d).withColumn("window_id", F.year("o_orderdate") - 1995)
    late = F.col("window_id") >= 4
    df = df.withColumn("o_totalprice", F.when(late, F.col("o_totalprice") * 1.5).otherwise(F.col("o_totalprice")))
    return df, WindowLoop(spark, Roles(FEATURES, KEY), DriftTest(n_projections=10, n_permutations=99),
                          Learning(["dt", "lr"], static=True))


@query("drift_log", """
  SELECT (extract('year' FROM o_orderdate) - 1995)::BIGINT AS "window", count(*) AS n, "window" > 0 AS scored, "window" = 0 AS first, true AS decided
  FROM orders GROUP BY 1""")
def drift_log(spark, d):
    """Every window is in the log with all its rows; all but the first are
    scored; the first trains, and later ones where the test says so."""
    df, loop = _loop(spark, d)
    c = F.col
    return loop.run(df).select(
        "window", "n", (c("auc").between(0, 1) & c("f1").between(0, 1)).eqNullSafe(True).alias("scored"),
        (c("retrained") & ~c("drift")).alias("first"),
        ((c("drift") == (c("p_value") < 0.05)) & c("static_accuracy").between(0, 1)).alias("decided"))


_SCORED_ROWS = "SELECT (extract('year' FROM o_orderdate) - 1995)::BIGINT AS \"window\" FROM orders"


@query("run_scores", f"SELECT \"window\", count(*) AS cnt, true AS in_range FROM ({_SCORED_ROWS}) WHERE \"window\" > 0 GROUP BY 1")
def run_scores(spark, d):
    """Every row of every window after the first is scored once."""
    df, loop = _loop(spark, d)
    loop.run(df)
    s = loop.scores().groupBy(F.col("window").cast("long").alias("window"))
    return s.agg(F.countDistinct("o_orderkey").alias("cnt"), F.bool_and(F.col("ensemble_score").between(0, 1)).alias("in_range"))


@query("run_confusion", f"SELECT count(*) AS cnt, true AS agrees FROM ({_SCORED_ROWS}) WHERE \"window\" > 0")
def run_confusion(spark, d):
    """The confusion counts of a run hold all scored rows, and their diagonal
    gives the accuracy of the log."""
    df, loop = _loop(spark, d)
    log = loop.run(df).where("accuracy IS NOT NULL").agg(F.sum(F.col("accuracy") * F.col("n")).alias("right")).first()["right"]
    cells = met.confusion(loop.scores().withColumn("window", F.col("window").cast("int")), "label", "ensemble_prediction", ["window"])
    right = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("cnt")).otherwise(0))
    return cells.agg(F.sum("cnt").alias("cnt"), (F.abs(right - F.lit(log)) < 1e-6).alias("agrees"))
