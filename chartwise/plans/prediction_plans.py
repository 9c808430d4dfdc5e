"""Prediction and metric queries: grid, as-of match, masked metrics, losses,
class losses and AUC, histogram, metric log, running best, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartwise.functions import stats as st
from chartwise.operators import metrics as mt
from chartwise.operators import observations as ob
from chartwise.operators import predictions as pr
from chartwise.plans.catalog import query
from chartwise.plans.observation_plans import MAX_VAL_SAMPLES, T_VAL
from chartwise.plans.timeline_plans import round_doubles, round_sig, round_sig_sql
from chartwise.sources import fixtures as fx

# Horizon and step of the reference's MIMIC run (T = 48, dt = 0.1).
T_END, DT = 48.0, 0.1
MIXING = 1e-4
HIST_BINS = 1000
N = fx.N_FEATURES
C = repr(st.LOG_SQRT_2PI)
C2 = repr(st.LOG_2PI)


def _long_all(wide, keys=("id", "tick")):
    """Every feature of every row: ``keys, k, x, m`` (x = 0 where unobserved)."""
    return wide.select(
        *keys,
        F.posexplode(F.arrays_zip(
            F.array(*[F.col(f"value_{i}").cast("double") for i in range(N)]).alias("x"),
            F.array(*[F.col(f"mask_{i}").cast("double") for i in range(N)]).alias("m"),
        )).alias("k", "z"),
    ).select(*keys, "k", F.col("z.x").alias("x"), F.col("z.m").alias("m"))


def _long_all_sql(src: str) -> str:
    return " UNION ALL ".join(
        f"SELECT id, tick, {i} AS k, value_{i} AS x, CAST(mask_{i} AS DOUBLE) AS m FROM {src}" for i in range(N)
    )


def _evals(t):
    after = ob.validation_split(fx.obs(t), T_VAL, max_val_samples=MAX_VAL_SAMPLES, parts=("after",))["after"]
    return pr.eval_table(after, fx.pred(t), N)


_FIRST = """first_p AS (SELECT id, tick, k, mean, logvar FROM (
   SELECT *, row_number() OVER (PARTITION BY id, tick, k ORDER BY seq) AS rn FROM fx_pred) AS q WHERE rn = 1)"""

_EVAL = f"""
val_ids AS (SELECT id FROM fx_obs GROUP BY id
   HAVING max(CASE WHEN t <= {T_VAL} THEN 1 ELSE 0 END) = 1 AND max(CASE WHEN t > {T_VAL} THEN 1 ELSE 0 END) = 1),
ev AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY t) AS rn
       FROM fx_obs WHERE id IN (SELECT id FROM val_ids) AND t > {T_VAL}) AS a WHERE rn <= {MAX_VAL_SAMPLES}),
{_FIRST},
pt AS (SELECT DISTINCT id, tick FROM first_p),
mt AS (SELECT id, tick AS eval_tick, matched_tick FROM (
   SELECT e.id, e.tick, p.tick AS matched_tick,
          row_number() OVER (PARTITION BY e.id, e.tick ORDER BY abs(p.tick - e.tick), p.tick) AS rn
   FROM (SELECT DISTINCT id, tick FROM ev) AS e JOIN pt AS p ON e.id = p.id) AS q WHERE rn = 1),
lg AS ({_long_all_sql('ev')}),
evt AS (SELECT l.id, mt.eval_tick, mt.matched_tick, l.k, l.x, l.m, f.mean, f.logvar
        FROM lg AS l JOIN mt ON l.id = mt.id AND l.tick = mt.eval_tick
        LEFT JOIN first_p AS f ON f.id = l.id AND f.tick = mt.matched_tick AND f.k = l.k)"""


@query("time_grid", f"""
SELECT id, CAST(r AS INTEGER) AS tick, round(r * CAST({DT} AS DOUBLE), 6) AS t, 'grid' AS kind
FROM (SELECT DISTINCT id FROM fx_obs) AS i CROSS JOIN range(0, {pr.n_ticks(T_END, DT) + 1}) AS g(r)
UNION ALL
SELECT id, CAST(ceil(t / CAST({DT} AS DOUBLE) - 0.001) AS INTEGER) AS tick, round(t, 6) AS t, 'obs' AS kind FROM fx_obs""",
       ids="I9 I10 G1")
def time_grid(t):
    return round_doubles(pr.time_grid(fx.obs(t), T_END, DT))


@query("grid_check", f"""
SELECT count(*) AS n_times, count(*) + 1 AS n_pointers, count(CASE WHEN t > {T_END} THEN 1 END) AS n_after_T,
       count(CASE WHEN t > {T_END} THEN 1 END) = 0 AS ok FROM (SELECT DISTINCT t FROM fx_obs) AS d""", ids="I11")
def grid_check(t):
    return pr.grid_check(fx.obs(t), T_END)


@query("pred_first", f"WITH {_FIRST} SELECT id, tick, k, round(mean, 6) AS mean, round(logvar, 6) AS logvar FROM first_p",
       ids="E17")
def pred_first(t):
    return round_doubles(pr.first_per_tick(fx.pred(t)))


@query("eval_nearest", f"""WITH {_EVAL.strip()}
SELECT id, eval_tick, matched_tick, round(eval_tick * CAST({DT} AS DOUBLE), 1) AS t_rounded, k, round(x, 6) AS x, m,
       round(mean, 6) AS mean, round(logvar, 6) AS logvar FROM evt""", ids="C7 C8 H18")
def eval_nearest(t):
    e = _evals(t).withColumn("t_rounded", pr.round_to_step(F.col("eval_tick") * F.lit(DT), DT))
    return round_doubles(e.select("id", "eval_tick", "matched_tick", "t_rounded", "k", "x", "m", "mean", "logvar"))


@query("eval_metrics", f"""WITH {_EVAL.strip()}
SELECT sum(m) AS num_obs, CAST(coalesce(sum(CASE WHEN mean IS NULL THEN m END), 0) AS DOUBLE) AS num_unmatched,
       round(sum(({C} + logvar / 2 + pow(x - mean, 2) / (2.0 * exp(logvar))) * m) / sum(m), 6) AS loglik,
       round(sum(pow(x - mean, 2) * m) / sum(m), 6) AS mse FROM evt""", ids="D10 D11")
def eval_metrics(t):
    return round_doubles(mt.masked_summary(_evals(t)))


_CORR = """
means AS (SELECT k, sum(x) / sum(m) AS mt, sum(mean) / sum(m) AS mh,
                 sum(x * m) / sum(m) AS pt, sum(mean * m) / sum(m) AS ph FROM evt GROUP BY k),
parts AS (SELECT e.k, sum((x - mt) * (mean - mh) * m) AS num, sqrt(sum(pow(x - mt, 2) * m)) AS d1,
                 sqrt(sum(pow(mean - mh, 2) * m)) AS d2, sum((x - pt) * (mean - ph) * m) AS pnum,
                 sqrt(sum(pow(x - pt, 2) * m)) AS pd1, sqrt(sum(pow(mean - ph, 2) * m)) AS pd2
          FROM evt AS e JOIN means AS mm ON e.k = mm.k GROUP BY e.k),
corr AS (SELECT k, CASE WHEN d1 * d2 = 0 THEN NULL ELSE num / (d1 * d2) END AS corr_reference,
                   CASE WHEN pd1 * pd2 = 0 THEN NULL ELSE pnum / (pd1 * pd2) END AS corr_pearson FROM parts)"""


@query("eval_corr", f"""WITH {_EVAL.strip()}, {_CORR.strip()}
SELECT k, round(corr_reference, 6) AS corr_reference, round(corr_pearson, 6) AS corr_pearson FROM corr""", ids="D12")
def eval_corr(t):
    return round_doubles(mt.masked_corr(_evals(t)))


@query("eval_corr_summary", f"""WITH {_EVAL.strip()}, {_CORR.strip()}
SELECT round(avg(c), 6) AS corr_mean, round(max(c), 6) AS corr_max, round(min(c), 6) AS corr_min
FROM (SELECT CASE WHEN isnan(corr_reference) THEN NULL ELSE corr_reference END AS c FROM corr) AS q""", ids="D13")
def eval_corr_summary(t):
    return round_doubles(mt.corr_summary(mt.masked_corr(_evals(t))))


@query("tail_prob", f"""WITH {_EVAL.strip()}
SELECT id, eval_tick, k, round(0.5 - 0.5 * {st.erf_sql(f"((x - mean) / (exp(0.5 * logvar) * {repr(2 ** 0.5)}))")}, 6)
       AS p_upper FROM evt""", ids="H21")
def tail_prob(t):
    return round_doubles(pr.upper_tail(_evals(t)).select("id", "eval_tick", "k", "p_upper"))


@query("pred_band", f"""WITH {_EVAL.strip()}
SELECT k, row_number() OVER (PARTITION BY k ORDER BY eval_tick, id) AS idx, id, eval_tick, round(mean, 6) AS mean,
       round(mean + 3.0 * logvar, 6) AS upper, round(mean - 3.0 * logvar, 6) AS lower,
       round(mean + 3.0 * exp(logvar / 2), 6) AS upper_std, round(mean - 3.0 * exp(logvar / 2), 6) AS lower_std,
       round(x, 6) AS actual
FROM evt WHERE k IN (0, 1, 2)""", ids="H20 E18")
def pred_band(t):
    return round_doubles(pr.band(_evals(t)))


@query("pred_halves", """
SELECT id, tick, seq, list_transform(list(mean ORDER BY k) || list(logvar ORDER BY k), lambda v: round(v, 6)) AS p,
       list_transform(list(mean ORDER BY k), lambda v: round(v, 6)) AS mean,
       list_transform(list(logvar ORDER BY k), lambda v: round(v, 6)) AS logvar
FROM fx_pred GROUP BY id, tick, seq""", ids="H19")
def pred_halves(t):
    out = pr.split_halves(pr.pack_halves(fx.pred(t)))
    return out.select("id", "tick", "seq", *[F.transform(c, lambda v: F.round(v, 6)).alias(c) for c in ("p", "mean", "logvar")])


@query("observation_losses", f"""
WITH lg AS ({_long_all_sql('fx_obs')}),
pre AS (SELECT id, tick, k, mean AS mu0, logvar AS lv0 FROM fx_pred_obs WHERE seq = 0),
post AS (SELECT id, tick, k, mean AS mu1, logvar AS lv1 FROM fx_pred_obs WHERE seq = 1),
j AS (SELECT lg.*, mu0, lv0, mu1, lv1 FROM lg LEFT JOIN pre USING (id, tick, k) LEFT JOIN post USING (id, tick, k)),
s AS (SELECT id,
  sum(0.5 * (pow(x - mu0, 2) / exp(lv0) + lv0 + {C2}) * m) AS loss_pre,
  sum(0.5 * (pow(x - mu0, 2) / exp(lv0) + lv0) * m) AS loss_pre_noconst,
  sum(0.5 * (pow(x - mu0, 2) / (abs(lv0) + 1e-6) + ln(abs(lv0) + 1e-6)) * m) AS loss_pre_var,
  sum((ln(0.01) - ln(exp(0.5 * lv1)) + (pow(exp(0.5 * lv1), 2) + pow(mu1 - x, 2)) / (2.0 * 0.01 * 0.01) - 0.5) * m) AS kl_post,
  sum((ln(0.01) - ln(sqrt(abs(lv1) + 1e-5)) + (pow(sqrt(abs(lv1) + 1e-5), 2) + pow(mu1 - x, 2)) / (2.0 * 0.01 * 0.01) - 0.5) * m)
    AS kl_post_var,
  sum(m) AS num_obs, CAST(coalesce(sum(CASE WHEN mu0 IS NULL OR mu1 IS NULL THEN m END), 0) AS DOUBLE) AS num_unmatched
  FROM j GROUP BY id)
SELECT id, {round_sig_sql('loss_pre')} AS loss_pre, {round_sig_sql('loss_pre_noconst')} AS loss_pre_noconst, {round_sig_sql('loss_pre_var')} AS loss_pre_var, {round_sig_sql('kl_post')} AS kl_post, {round_sig_sql('kl_post_var')} AS kl_post_var,
       num_obs, num_unmatched, {round_sig_sql(f'loss_pre + {MIXING} * kl_post')} AS loss FROM s""", ids="D14 D15 D16 D17 H17")
def observation_losses(t):
    o = _long_all(fx.obs(t))
    out = mt.observation_losses(o, fx.pred_obs(t), MIXING)
    # per-id sums reach ~1e9 (KL with σ = 0.01): compared on 10 significant digits
    cols = ["loss_pre", "loss_pre_noconst", "loss_pre_var", "kl_post", "kl_post_var"]
    return out.select("id", *[round_sig(c).alias(c) for c in cols], "num_obs", "num_unmatched", round_sig("loss").alias("loss"))


_AUC = """
s AS (SELECT *, 1.0 / (1.0 + exp(-logit)) AS score FROM fx_scores),
lv AS (SELECT batch, score, sum(label) AS pos, sum(1 - label) AS neg FROM s GROUP BY batch, score),
r AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY batch ORDER BY score
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below FROM lv),
auc AS (SELECT batch, CASE WHEN sum(pos) = 0 OR sum(neg) = 0 THEN 0.5
                      ELSE sum(pos * (neg_below + 0.5 * neg)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) END AS auc
        FROM r GROUP BY batch)"""


@query("class_losses", f"""WITH {_AUC.strip()},
sums AS (SELECT batch, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_pos,
                sum(greatest(logit, 0) - logit * label + ln(1 + exp(-abs(logit)))) AS bce_sum FROM fx_scores GROUP BY batch)
SELECT sums.batch, n, n_pos, round(bce_sum, 6) AS bce_sum, round(auc, 6) AS auc FROM sums JOIN auc ON sums.batch = auc.batch""",
       ids="D18 D19 H15 H16")
def class_losses(t):
    return round_doubles(mt.class_losses(fx.scores(t)))


@query("auc_summary", f"WITH {_AUC.strip()} SELECT round(avg(auc), 6) AS mean_auc, count(*) AS n_batches FROM auc",
       ids="D21 D19")
def auc_summary(t):
    per = mt.class_losses(fx.scores(t))
    return round_doubles(per.agg(F.avg("auc").alias("mean_auc"), F.count("*").alias("n_batches")))


@query("smoothed_class_loss", f"""
WITH steps AS (SELECT id, (mean - 101) / 50 AS logit FROM fx_pred WHERE seq = 1 AND k = 0),
fin AS (SELECT id, (mean - 100) / 50 AS logit FROM fx_pred WHERE seq = 0 AND k = 0 AND tick = 480),
sl AS (SELECT s.id, sum(greatest(logit, 0) - logit * label + ln(1 + exp(-abs(logit)))) AS ssum, count(*) AS n_steps
       FROM steps AS s JOIN fx_labels AS l ON s.id = l.id GROUP BY s.id),
fl AS (SELECT f.id, greatest(logit, 0) - logit * label + ln(1 + exp(-abs(logit))) AS fl FROM fin AS f JOIN fx_labels AS l ON f.id = l.id)
SELECT fl.id, coalesce(n_steps, 0) AS n_steps,
       round(CASE WHEN coalesce(n_steps, 0) = 0 THEN NULL ELSE (coalesce(ssum, 0) + fl) / n_steps END, 6) AS class_loss
FROM fl LEFT JOIN sl ON fl.id = sl.id""", ids="D20")
def smoothed_class_loss(t):
    p = fx.pred(t)
    steps = p.where("seq = 1 AND k = 0").select("id", ((F.col("mean") - 101) / 50).alias("logit"))
    final = p.where("seq = 0 AND k = 0 AND tick = 480").select("id", ((F.col("mean") - 100) / 50).alias("logit"))
    return round_doubles(mt.smoothed_class_loss(steps, final, fx.labels(t)))


_HIST = f"""
v AS (SELECT value_0 AS v FROM fx_obs WHERE mask_0 = 1),
sm AS (SELECT min(v) AS mn, max(v) AS mx, count(*) AS num, sum(v) AS s, sum(v * v) AS ss FROM v),
rg AS (SELECT CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS lo, CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS hi FROM sm)"""


@query("histogram", f"""WITH {_HIST.strip()},
c AS (SELECT CAST(least(floor((v - lo) * {HIST_BINS} / (hi - lo)), {HIST_BINS - 1}) AS INTEGER) AS bin, count(*) AS n
      FROM v CROSS JOIN rg GROUP BY 1)
SELECT CAST(b.r AS INTEGER) AS bin, round(lo + b.r * ((hi - lo) / {HIST_BINS}), 6) AS lower,
       round(lo + (b.r + 1) * ((hi - lo) / {HIST_BINS}), 6) AS bucket_limit, CAST(coalesce(c.n, 0) AS BIGINT) AS count
FROM rg CROSS JOIN range(0, {HIST_BINS}) AS b(r) LEFT JOIN c ON c.bin = b.r""", ids="D9")
def histogram(t):
    return round_doubles(mt.histogram(fx.obs(t).where("mask_0 = 1"), "value_0", HIST_BINS)["bins"])


@query("histogram_summary", f"""WITH {_HIST.strip()}
SELECT round(mn, 6) AS min, round(mx, 6) AS max, num, round(s, 6) AS sum, round(ss, 4) AS sum_squares FROM sm""", ids="D9")
def histogram_summary(t):
    s = mt.histogram(fx.obs(t).where("mask_0 = 1"), "value_0", HIST_BINS)["summary"]
    return s.select(F.round("min", 6).alias("min"), F.round("max", 6).alias("max"), "num",
                    F.round("sum", 6).alias("sum"), F.round("sum_squares", 4).alias("sum_squares"))


@query("best_epoch", """
SELECT run, step, val_metric, best_before, val_metric > best_before AS new_best
FROM (SELECT *, greatest(coalesce(max(val_metric) OVER (PARTITION BY run ORDER BY step
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1000.0), -1000.0) AS best_before FROM fx_metrics) AS q""",
       ids="E16")
def best_epoch(t):
    out = mt.running_best(fx.metrics(t).select("run", "step", "val_metric"))
    # values are copied, not computed: compared exactly
    return out.select("run", "step", "val_metric", "best_before", "new_best")


@query("metric_log", """
SELECT run, step, 'val_metric' AS tag, val_metric AS value FROM fx_metrics
UNION ALL SELECT run, step, 'loss' AS tag, loss AS value FROM fx_metrics""", ids="A12")
def metric_log(t):
    return mt.metric_log(fx.metrics(t))


@query("epoch_summary", """
SELECT run, round(avg(loss), 6) AS mean_loss, count(*) AS n_batches FROM fx_metrics GROUP BY run""", ids="D21")
def epoch_summary(t):
    return round_doubles(mt.epoch_summary(fx.metrics(t)))


_PRED = "pr AS (SELECT label AS y, CASE WHEN 1.0 / (1.0 + exp(-logit)) >= 0.5 THEN 1 ELSE 0 END AS p FROM fx_scores)"


def _scored(t):
    s = fx.scores(t)
    return s.withColumn("pred", (st.sigmoid(F.col("logit")) >= 0.5).cast("int"))


@query("class_accuracy", f"WITH {_PRED} SELECT round(avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM pr",
       ids="D22")
def class_accuracy(t):
    return round_doubles(mt.report(_scored(t))["accuracy"])


@query("confusion_matrix", f"WITH {_PRED} SELECT y, p, count(*) AS n FROM pr GROUP BY y, p", ids="D23")
def confusion_matrix(t):
    return mt.report(_scored(t))["confusion"]


@query("class_report", f"""WITH {_PRED},
cl AS (SELECT y AS c FROM pr UNION SELECT p FROM pr),
per AS (SELECT cl.c, (SELECT count(*) FROM pr WHERE y = cl.c AND p = cl.c) AS tp,
               (SELECT count(*) FROM pr WHERE y = cl.c) AS support, (SELECT count(*) FROM pr WHERE p = cl.c) AS predicted FROM cl),
m AS (SELECT CAST(c AS VARCHAR) AS class, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS precision,
             CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall, support FROM per),
f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM m)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM f
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
                 round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f""", ids="D24")
def class_report(t):
    return round_doubles(mt.report(_scored(t))["report"])


@query("class_weights", """
SELECT label, count(*) AS n_c, round((SELECT count(*) FROM fx_classes) / ((SELECT count(DISTINCT label) FROM fx_classes) * count(*)), 6)
       AS weight FROM fx_classes GROUP BY label""", ids="D25")
def class_weights(t):
    return round_doubles(mt.class_weights(fx.classes(t)))


def _assign_sql():
    from chartwise.plans import split_plans as sp
    return f"{sp._FOLDS.strip()}, {sp._BATCHES.strip()}, a AS (SELECT id, fold, split, batch FROM assign)"


_ASSIGN = _assign_sql()
LAMBDA = 1.0  # weight of the class loss in the batch total (a training parameter)


@query("batch_total_loss", f"""
WITH lg AS ({_long_all_sql('fx_obs')}),
pre AS (SELECT id, tick, k, mean AS mu0, logvar AS lv0 FROM fx_pred_obs WHERE seq = 0),
post AS (SELECT id, tick, k, mean AS mu1, logvar AS lv1 FROM fx_pred_obs WHERE seq = 1),
j AS (SELECT lg.*, mu0, lv0, mu1, lv1 FROM lg LEFT JOIN pre USING (id, tick, k) LEFT JOIN post USING (id, tick, k)),
il AS (SELECT id, sum(0.5 * (pow(x - mu0, 2) / exp(lv0) + lv0 + {C2}) * m)
                 + {MIXING} * sum((ln(0.01) - ln(exp(0.5 * lv1)) + (pow(exp(0.5 * lv1), 2) + pow(mu1 - x, 2)) / (2.0 * 0.01 * 0.01) - 0.5) * m)
                 AS loss FROM j GROUP BY id),
cl AS (SELECT p.id, greatest(z, 0) - z * l.label + ln(1 + exp(-abs(z))) AS bce
       FROM (SELECT id, (mean - 100) / 50 AS z FROM fx_pred WHERE seq = 0 AND k = 0 AND tick = 480) AS p
       JOIN fx_labels AS l ON p.id = l.id),
{_ASSIGN}
SELECT a.fold, a.split, a.batch, count(*) AS batch_size,
       {round_sig_sql(f"((coalesce(sum(il.loss), 0) + {LAMBDA} * coalesce(sum(cl.bce), 0)) / count(*))")} AS total_loss
FROM a LEFT JOIN il ON a.id = il.id LEFT JOIN cl ON a.id = cl.id GROUP BY a.fold, a.split, a.batch""", ids="D17 D18")
def batch_total_loss(t):
    from chartwise.plans.split_plans import _assign
    o = _long_all(fx.obs(t))
    id_loss = mt.observation_losses(o, fx.pred_obs(t), MIXING)
    p = fx.pred(t)
    logits = p.where("seq = 0 AND k = 0 AND tick = 480").select("id", ((F.col("mean") - 100) / 50).alias("logit"))
    out = mt.batch_total_loss(id_loss, logits, fx.labels(t), _assign(t), LAMBDA)
    # the summed KL terms reach ~1e8: compared on 10 significant digits
    return out.select("fold", "split", "batch", "batch_size", round_sig("total_loss").alias("total_loss"))
