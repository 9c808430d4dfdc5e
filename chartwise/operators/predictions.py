"""Model predictions as a table, and everything computed from them.

Predictions arrive in long form ``id, tick, seq, k, mean, logvar``: integer
time ticks (t = tick·dt), ``seq`` 0 for the prediction before an update and
1 after it, ``k`` the feature. Times are compared as integer ticks, never
as floats.

* ``time_grid``        per id, grid ticks 0..ceil(T/dt) merged with the
                       observations, each mapped to the first tick at or
                       after it (tolerance 0.001·dt)                    (I9, I10)
* ``grid_check``       all times ≤ T; pointer count = times + 1         (I11)
* ``first_per_tick``   the prediction before the update at each tick    (E17)
* ``nearest_ticks``    as-of match of evaluation ticks to prediction
                       ticks: exact first, else smallest gap, tie → earlier (C7, H18)
* ``eval_table``       evaluation rows with the matched mean/logvar     (C8)
* ``pack_halves`` / ``split_halves``  mean and log-variance halves       (H19)
* ``band``             mean ± 3·v plot rows, v = logvar or its std      (H20, E18)
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartwise.functions.stats import gaussian_upper_tail
from chartwise.operators.ranking import positions


def n_ticks(T: float, dt: float) -> int:
    return int(math.ceil(T / dt - 1e-9))


def obs_tick(t: Column, dt: float) -> Column:
    """First grid tick at or after ``t`` (the solver's 0.001·dt tolerance)."""
    return F.ceil(t / F.lit(float(dt)) - F.lit(0.001)).cast("int")


def round_to_step(t: Column, dt: float) -> Column:
    """Round times to as many places as the step is written with, half to even (0.1 → 1, 0.25 → 2, 1.5 → 1)."""
    exponent = Decimal(str(dt)).normalize().as_tuple().exponent
    return F.bround(t, max(0, -exponent))


def time_grid(obs: DataFrame, T: float, dt: float) -> DataFrame:
    """Grid rows (kind 'grid') then observation rows (kind 'obs') per id."""
    grid = obs.select("id").distinct().select(
        "id", F.explode(F.sequence(F.lit(0), F.lit(n_ticks(T, dt)))).alias("tick")
    ).select("id", "tick", (F.col("tick") * F.lit(float(dt))).alias("t"), F.lit("grid").alias("kind"))
    seen = obs.select("id", obs_tick(F.col("t"), dt).alias("tick"), "t", F.lit("obs").alias("kind"))
    return grid.unionByName(seen)


def grid_check(obs: DataFrame, T: float) -> DataFrame:
    times = obs.select("t").distinct()
    return times.agg(
        F.count("*").alias("n_times"),
        (F.count("*") + 1).alias("n_pointers"),
        F.count(F.when(F.col("t") > F.lit(float(T)), 1)).alias("n_after_T"),
        (F.count(F.when(F.col("t") > F.lit(float(T)), 1)) == 0).alias("ok"),
    )


def first_per_tick(pred: DataFrame) -> DataFrame:
    """One prediction per (id, tick, k): the lowest ``seq`` (before the update)."""
    # min_by keeps fixed-width buffers, so this stays a hash aggregate
    return pred.groupBy("id", "tick", "k").agg(
        F.min_by("mean", "seq").alias("mean"), F.min_by("logvar", "seq").alias("logvar"))


SLICE_TICKS = 4096


def nearest_ticks(evals: DataFrame, pred_ticks: DataFrame, slice_ticks: int = SLICE_TICKS) -> DataFrame:
    """``id, tick → matched_tick``: nearest prediction tick of the same id.

    The smaller gap wins, ties go to the earlier tick. Both key sets are
    unioned and cut into slices of ``slice_ticks`` ticks, so a slice of an
    id has at most two rows a tick whatever the id holds, and one id's slices
    go to many tasks. Within a slice the last prediction tick at or before a
    row and the first at or after it come from two scans in tick order; rows
    with none on one side take it from the nearest slice of the id on that side
    that has one: a scan over one row per slice. Predictions of ids without
    evaluations are left out first.
    """
    e = evals.select("id", "tick").distinct().withColumn("_is_pred", F.lit(0))
    p = pred_ticks.select("id", "tick").join(e.select("id").distinct(), "id", "left_semi").distinct().withColumn("_is_pred", F.lit(1))
    u = e.unionByName(p).select(
        "id", "tick", "_is_pred", F.floor(F.col("tick") / slice_ticks).cast("bigint").alias("_slice"),
        F.when(F.col("_is_pred") == 1, F.col("tick")).alias("_pt"))
    so_far = (Window.unboundedPreceding, 0)
    within = Window.partitionBy("id", "_slice")
    back = within.orderBy(F.col("tick"), F.col("_is_pred").desc()).rowsBetween(*so_far)
    fwd = within.orderBy(F.col("tick").desc(), F.col("_is_pred").desc()).rowsBetween(*so_far)
    local = u.withColumn("_back", F.max("_pt").over(back)).withColumn("_fwd", F.min("_pt").over(fwd)).where("_is_pred = 0")
    # every slice of an id, with the prediction ticks of earlier and later slices
    ends = u.groupBy("id", "_slice").agg(F.min("_pt").alias("_lo"), F.max("_pt").alias("_hi"))
    by_id = Window.partitionBy("id")
    carried = ends.select(
        "id", "_slice",
        F.max("_hi").over(by_id.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.min("_lo").over(by_id.orderBy(F.col("_slice").desc()).rowsBetween(Window.unboundedPreceding, -1)).alias("_after"))
    m = local.join(carried, ["id", "_slice"]).select(
        "id", "tick", F.coalesce("_back", "_before").alias("_back"), F.coalesce("_fwd", "_after").alias("_fwd"))
    gap_b = F.col("tick") - F.col("_back")
    gap_f = F.col("_fwd") - F.col("tick")
    matched = (
        F.when(F.col("_back").isNull(), F.col("_fwd"))
        .when(F.col("_fwd").isNull(), F.col("_back"))
        .when(gap_b <= gap_f, F.col("_back"))
        .otherwise(F.col("_fwd"))
    )
    return m.select("id", "tick", matched.alias("matched_tick"))


def eval_table(evals_wide: DataFrame, pred: DataFrame, n_features: int) -> DataFrame:
    """Evaluation rows × features with the matched prediction (C7 + C8).

    ``evals_wide`` is wide observations (id, tick, value_k, mask_k);
    output ``id, eval_tick, matched_tick, k, x, m, mean, logvar``.
    """
    # The search needs only the distinct prediction ticks; the "before the
    # update" dedup runs only on the rows of the matched ticks.
    match = nearest_ticks(evals_wide, pred)
    wanted = match.select("id", F.col("matched_tick").alias("tick")).distinct()
    # plain semi join: materialising ``wanted`` first would run the whole
    # search twice; AQE picks the strategy from the measured sides
    first = first_per_tick(pred.join(wanted, ["id", "tick"], "left_semi"))
    long = evals_wide.select(
        "id", "tick",
        F.posexplode(F.arrays_zip(
            F.array(*[F.col(f"value_{i}").cast("double") for i in range(n_features)]).alias("x"),
            F.array(*[F.col(f"mask_{i}").cast("double") for i in range(n_features)]).alias("m"),
        )).alias("k", "z"),
    ).select("id", "tick", "k", F.col("z.x").alias("x"), F.col("z.m").alias("m"))
    rows = long.join(match, ["id", "tick"]).withColumnRenamed("tick", "eval_tick")
    fetched = rows.join(
        first.withColumnRenamed("tick", "matched_tick"), ["id", "matched_tick", "k"], "left"
    )
    return fetched.select("id", "eval_tick", "matched_tick", "k", "x", "m", "mean", "logvar")


def upper_tail(evals: DataFrame) -> DataFrame:
    return evals.withColumn("p_upper", gaussian_upper_tail(F.col("x"), F.col("mean"), F.col("logvar")))


def pack_halves(pred: DataFrame) -> DataFrame:
    """Per (id, tick, seq): ``p`` = means by feature then log-variances."""
    g = pred.groupBy("id", "tick", "seq").agg(F.sort_array(F.collect_list(F.struct("k", "mean", "logvar"))).alias("_r"))
    return g.select(
        "id", "tick", "seq",
        F.concat(F.transform("_r", lambda r: r["mean"]), F.transform("_r", lambda r: r["logvar"])).alias("p"),
    )


def split_halves(packed: DataFrame) -> DataFrame:
    half = (F.size("p") / 2).cast("int")
    return packed.select(
        "id", "tick", "seq", "p",
        F.slice("p", F.lit(1), half).alias("mean"),
        F.slice("p", half + 1, half).alias("logvar"),
    )


def band(evals: DataFrame, features=(0, 1, 2), width: float = 3.0) -> DataFrame:
    """Plot rows per feature: index 1..n, mean, mean ± width·v (v = logvar
    as the reference plots) and ± width·std, and the actual value."""
    rows = evals.where(F.col("k").isin(list(features)))
    rows = positions(rows, ["eval_tick", "id"], group=["k"], out="_i")
    v, sd = F.col("logvar"), F.exp(F.col("logvar") / 2)
    return rows.select(
        "k", (F.col("_i") + 1).alias("idx"), "id", "eval_tick", "mean",
        (F.col("mean") + F.lit(width) * v).alias("upper"), (F.col("mean") - F.lit(width) * v).alias("lower"),
        (F.col("mean") + F.lit(width) * sd).alias("upper_std"), (F.col("mean") - F.lit(width) * sd).alias("lower_std"),
        F.col("x").alias("actual"),
    )

