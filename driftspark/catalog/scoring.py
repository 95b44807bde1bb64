"""Ensemble arithmetic and evaluation on a stored score table.

Scores come from the orders: each model sees the price through its own hash
noise; the label is whether the order is a large one.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from driftspark.catalog.base import query, rounded, sql_hash, sql_unit, table
from driftspark.functions.columns import threshold
from driftspark.functions.hashing import hash_key, hash_unit
from driftspark.operators import ensemble as ens
from driftspark.operators import metrics as met

ORDER = ["o_orderkey"]
MODELS = range(5)
_LABEL = "(CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END)::INTEGER"


def _p(m: int) -> str:
    return f"({sql_unit(m, *ORDER)} + least(o_totalprice / 500000, 1.0)) / 2"


_SCORES = " UNION ALL ".join(
    f"SELECT o_orderkey, {m} AS model_id, {_p(m)} AS p, {_LABEL} AS label FROM orders" for m in MODELS)
_SCORED = (f"SELECT o_orderkey, {_p(1)} AS score, {_LABEL} AS label, "
           f"(CASE WHEN {_p(1)} >= 0.5 THEN 1.0 ELSE 0.0 END)::DOUBLE AS prediction FROM orders")


def _price():
    return F.least(F.col("o_totalprice") / 500000, F.lit(1.0))


def _label():
    return F.when(F.col("o_totalprice") > 250000, 1).otherwise(0).alias("label")


def scores(spark, d):
    cells = F.array(*[F.struct(F.lit(m).alias("model_id"), ((hash_unit(ORDER, m) + _price()) / 2).alias("p"))
                      for m in MODELS])
    return (table(spark, d, "orders").select("o_orderkey", _label(), F.explode(cells).alias("x"))
            .select("o_orderkey", "label", "x.*"))


def scored(spark, d):
    s = table(spark, d, "orders").select("o_orderkey", "o_orderstatus",
                                         ((hash_unit(ORDER, 1) + _price()) / 2).alias("score"), _label())
    return s.withColumn("prediction", threshold(F.col("score")))


# one model per year of orders; its type follows from the year's hash
_MEMBERS = f"""
  SELECT y - 1995 AS window_idx, y - 1995 AS model_id,
    (['dt', 'rf', 'gbt', 'lr'])[({sql_hash(1, 'y')} % 4 + 1)::INTEGER] AS model_type
  FROM (SELECT DISTINCT extract('year' FROM o_orderdate)::INTEGER AS y FROM orders)"""


def members(spark, d):
    types = F.array(*[F.lit(t) for t in ens.MODEL_TYPES])
    return (table(spark, d, "orders").select(F.year("o_orderdate").alias("y")).distinct()
            .select((F.col("y") - 1995).alias("window_idx"), (F.col("y") - 1995).alias("model_id"),
                    F.element_at(types, (F.pmod(hash_key(["y"], 1), F.lit(4)) + 1).cast("int")).alias("model_type")))


_NEWEST = "row_number() OVER (ORDER BY window_idx DESC)"
_WEIGHTS = f"""SELECT window_idx, model_id, model_type, pow(0.5, age - 1) / sum(pow(0.5, age - 1)) OVER () AS weight
  FROM (SELECT *, {_NEWEST} AS age FROM m) WHERE age <= 5"""


@query("recency_weights", f"""WITH m AS ({_MEMBERS}) SELECT window_idx, round(pow(0.5, age - 1) / sum(pow(0.5, age - 1)) OVER (), 9) AS weight
  FROM (SELECT *, {_NEWEST} AS age FROM m)""")
def recency_weights(spark, d):
    return rounded(ens.recency_weights(members(spark, d)).select("window_idx", "weight"), "weight", digits=9)


@query("evict", f"WITH m AS ({_MEMBERS}) SELECT window_idx, model_type FROM (SELECT *, {_NEWEST} AS age FROM m) WHERE age <= 5")
def evict(spark, d):
    return ens.evict(members(spark, d), 5).select("window_idx", "model_type")


_ALIVE = f"""WITH m AS ({_MEMBERS}),
  e AS (SELECT *, coalesce(lead(window_idx, 3) OVER (ORDER BY window_idx) - 1, (SELECT max(window_idx) FROM m)) AS last FROM m),
  a AS (SELECT w AS "window", model_type, row_number() OVER (PARTITION BY w ORDER BY window_idx DESC) AS age
        FROM e JOIN (SELECT DISTINCT window_idx AS w FROM m) ON w BETWEEN window_idx AND last),
  t AS (SELECT "window", model_type, pow(0.5, age - 1) / sum(pow(0.5, age - 1)) OVER (PARTITION BY "window") AS weight FROM a)"""


@query("composition", _ALIVE + """
  SELECT "window", """ + ", ".join(
    f"round(coalesce(sum(weight) FILTER (model_type = '{t}'), 0), 9)::DOUBLE AS {t}" for t in ens.MODEL_TYPES)
    + ' FROM t GROUP BY 1')
def composition(spark, d):
    m = members(spark, d)
    last = m.agg(F.max("window_idx")).first()[0]
    return rounded(ens.composition(ens.ensemble_by_window(m, last, 3)), *ens.MODEL_TYPES, digits=9)


@query("soft_vote", f"""
  WITH m AS ({_MEMBERS}), w AS ({_WEIGHTS}), k AS (SELECT row_number() OVER (ORDER BY window_idx) - 1 AS model_id, weight FROM w),
  s AS (SELECT o_orderkey, sum(p * weight) AS score FROM ({_SCORES}) JOIN k USING (model_id) GROUP BY 1)
  SELECT o_orderkey, round(score, 6) AS ensemble_score, (CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END)::DOUBLE AS ensemble_prediction FROM s""")
def soft_vote(spark, d):
    from pyspark.sql import Window

    alive = ens.recency_weights(ens.evict(members(spark, d), 5))
    alive = alive.withColumn("model_id", F.row_number().over(Window.orderBy("window_idx")) - 1)
    return rounded(ens.soft_vote(scores(spark, d), alive, ORDER), "ensemble_score")


_VOTES = f"SELECT o_orderkey, (CASE WHEN p >= 0.5 THEN 1 ELSE 0 END + model_id % 2)::INTEGER AS prediction FROM ({_SCORES})"


@query("majority_vote", f"""
  WITH c AS (SELECT o_orderkey, prediction, count(*) AS n FROM ({_VOTES}) GROUP BY 1, 2)
  SELECT o_orderkey, prediction AS vote FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY n DESC, prediction) AS r FROM c) WHERE r = 1""")
def majority_vote(spark, d):
    votes = scores(spark, d).withColumn("prediction", threshold(F.col("p")).cast("int") + F.col("model_id") % 2)
    return ens.majority_vote(votes, ORDER)


_AUC = """SELECT {by} sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS auc FROM (
  SELECT *, sum(neg) OVER ({part} ORDER BY s) - neg AS below FROM (
    SELECT {by} s, (count(*) FILTER (label = 1))::DOUBLE AS pos, (count(*) FILTER (label = 0))::DOUBLE AS neg FROM ({src}) GROUP BY {by} s)) {group}"""


@query("auc", "SELECT round(auc, 9) AS auc FROM (" + _AUC.format(
    by="", part="", src=f"SELECT score AS s, label FROM ({_SCORED})", group="") + ")")
def auc(spark, d):
    return rounded(met.auc(scored(spark, d)), "auc", digits=9)


_AUC_BY = _AUC.format(by="model_id,", part="PARTITION BY model_id", src=f"SELECT model_id, p AS s, label FROM ({_SCORES})",
                      group="GROUP BY model_id")


@query("auc_by_model", f"SELECT model_id, round(auc, 9) AS auc FROM ({_AUC_BY})")
def auc_by_model(spark, d):
    return rounded(met.auc(scores(spark, d), score="p", by=["model_id"]), "auc", digits=9)


@query("best_model", f"SELECT model_id, round(auc, 9) AS auc FROM ({_AUC_BY}) ORDER BY auc DESC, model_id LIMIT 1")
def best_model(spark, d):
    return rounded(ens.best_by(met.auc(scores(spark, d), score="p", by=["model_id"]), "auc", "model_id"), "auc", digits=9)


@query("roc_points", f"""
  SELECT round(s, 9) AS threshold, round((sum(neg) OVER w)::DOUBLE / (sum(neg) OVER ()), 9) AS fpr,
    round((sum(pos) OVER w)::DOUBLE / (sum(pos) OVER ()), 9) AS tpr
  FROM (SELECT score AS s, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM ({_SCORED}) GROUP BY 1)
  WINDOW w AS (ORDER BY s DESC)""")
def roc_points(spark, d):
    return rounded(met.roc_points(scored(spark, d)), "threshold", "fpr", "tpr", digits=9)


@query("accuracy", f"SELECT round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 9)::DOUBLE AS accuracy FROM ({_SCORED})")
def accuracy(spark, d):
    return rounded(met.accuracy(scored(spark, d)), "accuracy", digits=9)


@query("accuracy_multiclass", "SELECT round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 9)::DOUBLE AS accuracy "
       "FROM (SELECT label, vec_id % 10 AS prediction FROM embeddings)")
def accuracy_multiclass(spark, d):
    e = table(spark, d, "embeddings").withColumn("prediction", F.col("vec_id") % 10)
    return rounded(met.accuracy(e), "accuracy", digits=9)


_F1 = """WITH s AS ({src}), c AS (SELECT {by} k, count(*) FILTER (label = k) AS y, count(*) FILTER (prediction = k) AS p,
    count(*) FILTER (label = k AND prediction = k) AS hit FROM s, (SELECT DISTINCT label AS k FROM s) GROUP BY {by} k)
  SELECT {by} round(sum(y * 2.0 * hit / (y + p)) / sum(y), 9)::DOUBLE AS f1 FROM c {group}"""


@query("weighted_f1", _F1.format(src=_SCORED, by="", group=""))
def weighted_f1(spark, d):
    return rounded(met.weighted_f1(scored(spark, d)), "f1", digits=9)


@query("weighted_f1_by_status", _F1.format(src=_SCORED.replace("SELECT o_orderkey,", "SELECT o_orderkey, o_orderstatus,"),
                                           by="o_orderstatus,", group="GROUP BY o_orderstatus"))
def weighted_f1_by_status(spark, d):
    return rounded(met.weighted_f1(scored(spark, d), by=["o_orderstatus"]), "f1", digits=9)


@query("confusion", f"""
  SELECT l AS label, p AS prediction, (SELECT count(*) FROM ({_SCORED}) WHERE label = l AND prediction = p) AS cnt
  FROM (SELECT unnest([0, 1]) AS l), (SELECT unnest([0, 1]) AS p)""")
def confusion(spark, d):
    return met.confusion(scored(spark, d))


@query("confusion_three_classes", """
  WITH s AS (SELECT label % 3 AS y, vec_id % 4 AS p FROM embeddings), c AS (SELECT DISTINCT y AS k FROM s UNION SELECT DISTINCT p FROM s)
  SELECT a.k::INTEGER AS label, b.k::INTEGER AS prediction, (SELECT count(*) FROM s WHERE y = a.k AND p = b.k) AS cnt FROM c a, c b""")
def confusion_three_classes(spark, d):
    e = table(spark, d, "embeddings").select((F.col("label") % 3).alias("label"), (F.col("vec_id") % 4).alias("prediction"))
    return met.confusion(e)


@query("score_hist", f"""
  WITH s AS ({_SCORED}), m AS (SELECT label, min(score) AS lo, max(score) AS hi FROM s GROUP BY 1)
  SELECT label, least(floor((score - lo) / (hi - lo) * 30), 29)::INTEGER AS bin, count(*) AS cnt FROM s JOIN m USING (label) GROUP BY 1, 2""")
def score_hist(spark, d):
    return met.histogram(scored(spark, d), "score", 30, ["label"]).select("label", "bin", "cnt")


@query("threshold", f"SELECT o_orderkey, prediction FROM ({_SCORED})")
def thresholded(spark, d):
    return scored(spark, d).select("o_orderkey", "prediction")
