"""MLlib ensemble queries. Fits have no SQL form; the voting step on a table of probabilities has."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartwise.functions.stats import sigmoid
from chartwise.operators import classify as cl
from chartwise.operators import metrics as mt
from chartwise.operators import splits as sp
from chartwise.operators.joins import materialise
from chartwise.plans.catalog import query
from chartwise.plans.split_plans import _STRAT, STRAT_SEED, STRAT_TEST
from chartwise.sources import fixtures as fx


def _run(t):
    """Split, fit and score; every query fits its own models."""
    classes = fx.classes(t)
    split = sp.stratified(classes.select("id", "label"), "label", STRAT_TEST, STRAT_SEED)
    train = split.where("split = 'train'").withColumn("_h", sp.hash_key("id", STRAT_SEED))
    thirds = sp.thirds(train, ["_h", "id"], hash_ordered=True)
    return cl.ensemble_run(classes, split, thirds)


def _data(t):
    """Balanced training rows and test rows of the stratified split."""
    classes = fx.classes(t)
    split = sp.stratified(classes.select("id", "label"), "label", STRAT_TEST, STRAT_SEED)
    data = cl.with_features(classes).join(split.select("id", "split"), "id")
    return mt.with_class_weights(data.where("split = 'train'"), "label"), data.where("split = 'test'")


@query("fit_certificates", """
SELECT * FROM (VALUES ('lr', 'gradient near zero', true), ('dt', 'leaves give class shares', true), ('dt', 'root split is best', true),
                      ('dt', 'depth within limit', true), ('svc', 'objective near its minimum', true)) AS v(model, "check", ok)""", ids="J1 J2 J3")
def fit_certificates(t):
    """The three fitted models pass the checks that hold at an optimum, on the training rows."""
    train = materialise(_data(t)[0])
    return cl.certificates(cl.BalancedModels(train), train)


@query("ensemble_votes", f"""WITH {_STRAT.strip()}
SELECT label, count(*) AS support, count(*) AS voted, count(*) AS mean_of_three, count(*) AS majority_by_mean FROM strat WHERE split = 'test' GROUP BY label""",
       ids="J4 D24 I2")
def ensemble_votes(t):
    """Per class of the test rows: how many there are, got one vote, have the models' mean as probability, and are voted by it."""
    train, test = _data(t)
    voted = cl.soft_vote(cl.BalancedModels(materialise(train)), test)
    mean = (F.col("p_lr") + F.col("p_dt") + F.col("p_svc")) / 3
    inside = F.col("p_lr").between(0, 1) & F.col("p_dt").between(0, 1) & F.col("p_svc").between(0, 1)
    return voted.groupBy("label").agg(
        F.count("*").alias("support"), F.count_distinct("id").alias("voted"),
        F.count_if(inside & (F.abs(F.col("p_mean") - mean) < 1e-12)).alias("mean_of_three"),
        F.count_if(F.col("pred") == (F.col("p_mean") > 0.5).cast("int")).alias("majority_by_mean"))


@query("kernel_scale", """
WITH v AS (SELECT unnest(embedding)::DOUBLE AS x, len(embedding) AS d FROM embeddings)
SELECT round(1 / (max(d) * var_pop(x)), 6) AS gamma FROM v""", ids="J3")
def kernel_scale(t):
    """The kernel width of the support-vector model over all rows."""
    e = cl.with_features(t["embeddings"])
    return t.spark.createDataFrame([(round(cl.scale_gamma(e), 6),)], "gamma double")


@query("ensemble_scores", ids="J1 J2 J3 J4 D22 I2 I3 D25")
def ensemble_scores(t):
    """Accuracy of each third-fitted model alone and of the refit soft-vote ensemble."""
    return _run(t)["scores"]


@query("ensemble_confusion", ids="J4 D23")
def ensemble_confusion(t):
    return mt.report(_run(t)["voted"])["confusion"]


@query("ensemble_report", ids="J4 D24")
def ensemble_report(t):
    return mt.report(_run(t)["voted"])["report"]


@query("soft_vote", """
WITH p AS (SELECT vec_id AS id, 1 / (1 + exp(-CAST(embedding[1] AS DOUBLE))) AS p_lr, 1 / (1 + exp(-CAST(embedding[2] AS DOUBLE))) AS p_dt,
                  1 / (1 + exp(-CAST(embedding[3] AS DOUBLE))) AS p_svc FROM embeddings)
SELECT id, round((p_lr + p_dt + p_svc) / 3, 6) AS p_mean, CAST((p_lr + p_dt + p_svc) / 3 > 0.5 AS INTEGER) AS pred FROM p""", ids="J4")
def soft_vote(t):
    """The averaging step on probabilities that three models would give (here logistic in three components)."""
    e = t["embeddings"]
    p = e.select(F.col("vec_id").alias("id"), *[
        sigmoid(F.get("embedding", F.lit(i)).cast("double")).alias(f"p_{m}") for i, m in enumerate(cl.MODELS)])
    return cl.vote(p).select("id", F.round("p_mean", 6).alias("p_mean"), "pred")
