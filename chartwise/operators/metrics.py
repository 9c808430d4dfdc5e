"""Metrics as aggregates: masked likelihood/error/correlation, losses,
class losses and AUC, histograms, metric logs and running best.

All are partial-aggregate friendly (sums and counts combined map-side);
the only ordered computations (AUC's cumulative negatives, the running
best) use the slice-parallel ``ranking.running``.

* ``masked_summary``     Σ m·NLL / Σ m, Σ m·(x − μ)² / Σ m              (D10, D11)
* ``masked_corr``        per feature; ``reference`` (unmasked means over
                         mask count) and ``pearson`` (masked means)        (D12)
* ``corr_summary``       mean / max / min over features, NaN skipped      (D13)
* ``observation_losses`` pre-update (logvar, logvar without constant,
                         variance form) and post-update KL, combined      (D14–D17)
* ``class_losses``       BCE sum, AUC (rank form, ties averaged, single-
                         class fallback) per batch                        (D18, D19, H15, H16)
* ``smoothed_class_loss`` per-entity Σ step losses + final, ÷ steps       (D20)
* ``histogram``          equal-width bins incl. empty ones, summary row   (D9)
* ``running_best``       new-best flag per epoch (start −1000, strict)    (E16)
* ``metric_log``         wide metrics → (run, step, tag, value)           (A12)
* ``report``             accuracy, confusion, per-class P/R/F1, averages  (D22–D24)
* ``class_weights``      n / (k · n_c)                                    (D25)
* ``batch_total_loss``   (Σ loss + λ · Σ class BCE) / batch size           (D17)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartwise.functions import stats as st
from chartwise.operators.joins import join_derived
from chartwise.operators.ranking import running


def _ratio(num, den):
    return F.try_divide(num, den)


def masked_summary(ev: DataFrame) -> DataFrame:
    """Likelihood and error over observed values that have a prediction; ``num_unmatched`` counts those without."""
    matched = F.when(F.col("mean").isNotNull() & F.col("logvar").isNotNull(), F.col("m"))
    nll = st.gaussian_nll(F.col("x"), F.col("mean"), F.col("logvar"))
    return ev.agg(
        F.sum("m").alias("num_obs"),
        F.coalesce(F.sum(F.when(matched.isNull(), F.col("m"))), F.lit(0.0)).alias("num_unmatched"),
        _ratio(F.sum(nll * matched), F.sum(matched)).alias("loglik"),
        _ratio(F.sum(F.pow(F.col("x") - F.col("mean"), 2) * matched), F.sum(matched)).alias("mse"),
    )


def masked_corr(ev: DataFrame) -> DataFrame:
    """Per feature k: ``corr_reference`` and ``corr_pearson``, in one aggregation (m is 0 or 1).

    Both are made of moments about the masked means, which merge without
    cancellation: a sum about another centre c is n * (moment + (mean - c)^2).
    """
    x, h, m = F.col("x"), F.col("mean"), F.col("m")
    on = (m == 1) & x.isNotNull() & h.isNotNull()
    xm, hm = F.when(on, x), F.when(on, h)
    g = ev.where(h.isNotNull()).groupBy("k").agg(
        F.sum(m).alias("n"), F.sum(x).alias("sx"), F.sum(h).alias("sh"), F.avg(xm).alias("ax"), F.avg(hm).alias("ah"),
        F.var_pop(xm).alias("vx"), F.var_pop(hm).alias("vh"), F.covar_pop(xm, hm).alias("c"))
    dx, dh = F.col("ax") - _ratio(F.col("sx"), F.col("n")), F.col("ah") - _ratio(F.col("sh"), F.col("n"))
    return g.select(
        "k",
        _ratio(F.col("c") + dx * dh, F.sqrt(F.col("vx") + dx * dx) * F.sqrt(F.col("vh") + dh * dh)).alias("corr_reference"),
        _ratio(F.col("c"), F.sqrt("vx") * F.sqrt("vh")).alias("corr_pearson"),
    )


def corr_summary(corr: DataFrame, column: str = "corr_reference") -> DataFrame:
    c = F.when(~F.isnan(column), F.col(column))
    return corr.agg(F.avg(c).alias("corr_mean"), F.max(c).alias("corr_max"), F.min(c).alias("corr_min"))


def observation_losses(obs_long: DataFrame, pred: DataFrame, mixing: float = 1e-4,
                       obs_noise_std: float = 0.01) -> DataFrame:
    """Per id: pre-update losses against ``seq`` 0 and KL against ``seq`` 1.

    Every observed value counts in ``num_obs``; those that lack one of the
    two predictions have no loss and are counted in ``num_unmatched``.
    """
    both = pred.where("seq IN (0, 1)").groupBy("id", "tick", "k").agg(*[
        F.max(F.when(F.col("seq") == s, F.col(c))).alias(f"{a}{s}") for s in (0, 1) for c, a in (("mean", "mu"), ("logvar", "lv"))])
    j = obs_long.join(both, ["id", "tick", "k"], "left")
    x, m = F.col("x"), F.col("m")
    found = F.col("mu0").isNotNull() & F.col("lv0").isNotNull() & F.col("mu1").isNotNull() & F.col("lv1").isNotNull()

    def total(loss):
        return F.coalesce(F.sum(F.when(found, loss * m)), F.lit(0.0))

    per_id = j.groupBy("id").agg(
        total(st.obs_loss_logvar(x, F.col("mu0"), F.col("lv0"))).alias("loss_pre"),
        total(st.obs_loss_logvar(x, F.col("mu0"), F.col("lv0"), constant=False)).alias("loss_pre_noconst"),
        total(st.obs_loss_var(x, F.col("mu0"), F.col("lv0"))).alias("loss_pre_var"),
        total(st.gaussian_kl(F.col("mu1"), st.sigma_from_logvar(F.col("lv1")), x, obs_noise_std)).alias("kl_post"),
        total(st.gaussian_kl(F.col("mu1"), st.sigma_from_var(F.col("lv1")), x, obs_noise_std)).alias("kl_post_var"),
        F.sum(m).alias("num_obs"),
        F.coalesce(F.sum(F.when(~found, m)), F.lit(0.0)).alias("num_unmatched"),
    )
    return per_id.withColumn("loss", F.col("loss_pre") + F.lit(mixing) * F.col("kl_post"))


def _auc(scores: DataFrame, group: list[str], score: str, label: str, fallback: float) -> DataFrame:
    levels = scores.groupBy(*group, score).agg(
        F.sum(F.col(label).cast("long")).alias("_pos"), F.sum((1 - F.col(label)).cast("long")).alias("_neg")
    )
    ranked = running(levels, "_neg", [score], group=group, out="_neg_below")
    per = ranked.groupBy(*group).agg(
        F.sum(F.col("_pos") * (F.col("_neg_below") + F.lit(0.5) * F.col("_neg"))).alias("_u"),
        F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n"),
    )
    auc = F.when((F.col("_p") == 0) | (F.col("_n") == 0), F.lit(float(fallback))).otherwise(
        F.col("_u") / (F.col("_p").cast("double") * F.col("_n")))
    return per.select(*group, auc.alias("auc"))


def class_losses(scores: DataFrame, group=("batch",), logit: str = "logit", label: str = "label",
                 fallback: float = 0.5) -> DataFrame:
    """Per group: rows, positives, BCE sum on logits, AUC of sigmoid scores."""
    group = list(group)
    s = scores.withColumn("_score", st.sigmoid(F.col(logit)))
    sums = s.groupBy(*group).agg(
        F.count("*").alias("n"), F.sum(F.col(label)).cast("bigint").alias("n_pos"),
        F.sum(st.bce_with_logits(F.col(logit), F.col(label).cast("double"))).alias("bce_sum"),
    )
    return sums.join(_auc(s, group, "_score", label, fallback), group)


def smoothed_class_loss(step_logits: DataFrame, final_logits: DataFrame, labels: DataFrame) -> DataFrame:
    """(Σ BCE over observation steps + BCE of the final logit) ÷ number of steps."""
    steps = step_logits.join(labels, "id").groupBy("id").agg(
        F.sum(st.bce_with_logits(F.col("logit"), F.col("label").cast("double"))).alias("_s"),
        F.count("*").alias("n_steps"),
    )
    final = final_logits.join(labels, "id").select(
        "id", st.bce_with_logits(F.col("logit"), F.col("label").cast("double")).alias("_f"))
    j = final.join(steps, "id", "left")
    return j.select("id", F.coalesce("n_steps", F.lit(0)).alias("n_steps"),
                    _ratio(F.coalesce("_s", F.lit(0.0)) + F.col("_f"), F.col("n_steps")).alias("class_loss"))


def histogram(values: DataFrame, column: str, bins: int = 1000) -> dict[str, DataFrame]:
    """Equal-width histogram; the right edge falls in the last bin.

    Range is [min, max] (widened by 0.5 each side when equal). Bin counts
    are aggregated map-side; the full bin spine (empty bins included) is
    generated from the one-row range and left-joined.
    """
    v = values.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    summary = v.agg(
        F.min("v").alias("min"), F.max("v").alias("max"), F.count("*").alias("num"),
        F.sum("v").alias("sum"), F.sum(F.col("v") * F.col("v")).alias("sum_squares"),
    )
    # one struct as a scalar: the range is computed once, by one scan
    rng = summary.select(F.when(F.col("num") > 0, F.struct(
        F.when(F.col("min") == F.col("max"), F.col("min") - 0.5).otherwise(F.col("min")).alias("lo"),
        F.when(F.col("min") == F.col("max"), F.col("max") + 0.5).otherwise(F.col("max")).alias("hi"),
    )).alias("r")).scalar()
    nb = F.lit(bins)
    ranged = v.withColumn("_r", rng)
    lo, hi = F.col("_r.lo"), F.col("_r.hi")
    bin_of = F.least(F.floor((F.col("v") - lo) * nb / (hi - lo)), F.lit(bins - 1)).cast("int")
    counts = ranged.select(bin_of.alias("bin")).groupBy("bin").agg(F.count("*").alias("count"))
    spine = values.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), rng.alias("_r")).select(
        "bin", F.col("_r.lo").alias("lo"), F.col("_r.hi").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / nb
    hist = spine.join(counts, "bin", "left").select(
        "bin",
        (F.col("lo") + F.col("bin") * width).alias("lower"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("bucket_limit"),
        F.coalesce("count", F.lit(0)).cast("bigint").alias("count"),
    )
    return {"bins": hist, "summary": summary}


def running_best(metrics: DataFrame, value: str = "val_metric", group=("run",), order=("step",),
                 start: float = -1000.0) -> DataFrame:
    r = running(metrics, value, list(order), group=list(group), how="max", out="_best_before")
    best = F.coalesce(F.col("_best_before"), F.lit(float(start)))
    return r.withColumn("best_before", F.greatest(best, F.lit(float(start)))).withColumn(
        "new_best", F.col(value) > F.col("best_before")).drop("_best_before")


def metric_log(metrics: DataFrame, ids=("run", "step"), tags=("val_metric", "loss")) -> DataFrame:
    return metrics.unpivot(list(ids), list(tags), "tag", "value")


def epoch_summary(metrics: DataFrame, value: str = "loss", group=("run",)) -> DataFrame:
    return metrics.groupBy(*group).agg(F.avg(value).alias(f"mean_{value}"), F.count("*").alias("n_batches"))


def report(pred: DataFrame, label: str = "label", predicted: str = "pred") -> dict[str, DataFrame]:
    """Accuracy, confusion matrix and a classification report (P/R/F1/support).

    Everything follows from the confusion counts, so each table scans the
    predictions once; later steps work on one row per pair of classes.
    """
    y, p = F.col(label).cast("int"), F.col(predicted).cast("int")
    confusion = pred.groupBy(y.alias("y"), p.alias("p")).agg(F.count("*").alias("n"))
    accuracy = confusion.agg(
        _ratio(F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).cast("double"), F.sum("n")).alias("accuracy"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"))
    parts = confusion.select(F.explode(F.array(
        F.struct(F.col("y").alias("c"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("tp"),
                 F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted")),
        F.struct(F.col("p").alias("c"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("support"),
                 F.col("n").alias("predicted")))).alias("s")).select("s.*")
    counts = parts.groupBy("c").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
    precision = F.coalesce(_ratio(F.col("tp"), F.col("predicted")), F.lit(0.0))
    recall = F.coalesce(_ratio(F.col("tp"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(_ratio(2 * precision * recall, precision + recall), F.lit(0.0))
    per = counts.select(F.col("c").cast("string").alias("class"), precision.alias("precision"),
                        recall.alias("recall"), f1.alias("f1"), F.col("support").cast("bigint").alias("support"))
    measures = ("precision", "recall", "f1")
    # classes and their averages in one aggregation: the grand total gives two rows
    rolled = per.rollup("class").agg(
        F.grouping_id().alias("_all"), F.sum("support").alias("support"),
        *[F.avg(c).alias(f"m_{c}") for c in measures],
        *[_ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(f"w_{c}") for c in measures])
    own = F.struct("class", *[F.col(f"m_{c}").alias(c) for c in measures], "support")
    macro = F.struct(F.lit("macro avg").alias("class"), *[F.col(f"m_{c}").alias(c) for c in measures], "support")
    weighted = F.struct(F.lit("weighted avg").alias("class"), *[F.col(f"w_{c}").alias(c) for c in measures], "support")
    rows = rolled.select(F.explode(F.when(F.col("_all") == 0, F.array(own)).otherwise(F.array(macro, weighted))).alias("r"))
    return {"accuracy": accuracy, "confusion": confusion, "report": rows.select("r.*")}


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights n / (k · n_c) per class; the window spans one row per class."""
    counts = df.groupBy(label).agg(F.count("*").alias("n_c"))
    every = Window.partitionBy(F.lit(0))
    return counts.select(label, "n_c", (F.sum("n_c").over(every) / (F.count("*").over(every) * F.col("n_c"))).alias("weight"))


def with_class_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    w = class_weights(df, label).select(label, F.col("weight").alias(out))
    return join_derived(df, w, label, "inner")


def batch_total_loss(id_loss: DataFrame, class_logits: DataFrame, labels: DataFrame, assign: DataFrame,
                     lam: float = 1.0, group=("fold", "split", "batch")) -> DataFrame:
    """Per batch: (Σ observation loss + λ · Σ BCE of the class logits) / batch size (D17).

    ``id_loss`` (id, loss), ``class_logits`` (id, logit), ``labels`` (id, label),
    ``assign`` (id and the batch keys); all per-id sums are combined before the shuffle.
    """
    bce = class_logits.join(labels, "id").select(
        "id", st.bce_with_logits(F.col("logit"), F.col("label").cast("double")).alias("_bce"))
    per_id = assign.select("id", *group).join(id_loss.select("id", "loss"), "id", "left").join(bce, "id", "left")
    return per_id.groupBy(*group).agg(
        F.count("*").alias("batch_size"),
        ((F.coalesce(F.sum("loss"), F.lit(0.0)) + F.lit(float(lam)) * F.coalesce(F.sum("_bce"), F.lit(0.0)))
         / F.count("*")).alias("total_loss"),
    )
