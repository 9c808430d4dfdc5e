"""Batch tables: the table form of the reference's collate functions.

No tensors are built; each batch becomes rows a trainer can stream.

* ``time_batch``   rows of a batch sorted by time, the batch position of
                   each row's id, distinct times with counts and row
                   pointers (a leading 0 then running totals)            (I7, D4, E12, C10, F2)
* ``seq_batch``    rows ordered by (time, observed count desc, id), the
                   observed values and feature numbers, lengths, arrays
                   padded with 0 to the longest row of the batch         (I8, F3, H22, H23)
* ``held_out_rows`` / ``last_rows``  rows after the cut sorted by (id, t),
                   and the last row before it in the same id order      (I7, I8, E8)

A batch is a (fold, split, batch) group; one plan covers all of them, and a
loader takes the one it needs with a filter.

Pointers are running totals per batch computed slice-parallel. A row's number
is the pointer of its time plus its place among the rows of that time: a batch
has a bounded number of ids and an id one row a time, so this window is
bounded, and rows are shuffled once. Padding uses a per-batch maximum
(map-side combined) joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartwise.operators.joins import Derived, join_derived
from chartwise.operators.observations import last_before_cut, observed_per_row
from chartwise.operators.ranking import positions, running


GROUP = ("fold", "split", "batch")


def batch_rows(obs: DataFrame, assign, group=GROUP) -> DataFrame:
    """Observation rows of the assigned ids with their batch keys and ``obs_idx``."""
    return join_derived(obs, assign, "id", "inner")


def assigned(assign: DataFrame, group=GROUP) -> Derived:
    """The batch keys and position of every id, written once for the joins of a batch."""
    return Derived(assign.select("id", *group, F.col("pos_in_batch").alias("obs_idx")))


def time_batch(obs: DataFrame, assign, cov: DataFrame | None = None, labels: DataFrame | None = None,
               group=GROUP) -> dict[str, DataFrame]:
    """``rows``: the batch's observations in time order with values, masks and, if given, covariates and label;
    ``times``: distinct times with counts and row pointers."""
    group = list(group)
    side = assign if isinstance(assign, Derived) else assigned(assign, group)
    rows = batch_rows(obs, side, group)
    ptr = _pointers(rows, group)
    full = rows
    for table in (cov, labels):
        if table is not None:
            full = full.join(table, "id", "left")
    return {"rows": _numbered(full, ptr, ["id"], group), "times": ptr}


def _pointers(rows: DataFrame, group) -> DataFrame:
    """Distinct times of every batch with counts and row pointers."""
    times = rows.groupBy(*group, "tick", "t").agg(F.count("*").alias("n"))
    ptr = running(times, "n", ["tick"], group=group, out="ptr_start")
    return ptr.withColumn("ptr_start", F.col("ptr_start").cast("bigint")).withColumn(
        "ptr_end", (F.col("ptr_start") + F.col("n")).cast("bigint"))


def _numbered(rows: DataFrame, ptr: DataFrame, order, group) -> DataFrame:
    """``rows`` with ``row_idx``: their place in the batch by (tick, order)."""
    key = [*group, "tick"]
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    starts = ptr.groupBy(*key).agg(F.min("ptr_start").alias("_start"))
    return rows.withColumn("_place", place).join(starts, key).withColumn(
        "row_idx", (F.col("_start") + F.col("_place") - 1).cast("bigint")).drop("_place", "_start")


def held_out_rows(after: DataFrame, assign, group=GROUP) -> DataFrame:
    """The batch's held-out rows sorted by (id, t), numbered per batch."""
    return positions(join_derived(after, assign, "id"), ["id", "t"], group=list(group), out="val_idx")


def last_rows(before: DataFrame, assign, group=GROUP) -> DataFrame:
    """The last row before the cut of every id of the batch, in the held-out rows' id order."""
    return positions(join_derived(last_before_cut(before), assign, "id"), ["id"], group=list(group), out="last_idx")


def seq_batch(obs: DataFrame, assign, group=GROUP) -> DataFrame:
    """Rows by (time, observed count desc, id); observed values and features padded to the batch's longest row."""
    group = list(group)
    side = assign if isinstance(assign, Derived) else assigned(assign, group)
    rows = batch_rows(observed_per_row(obs), side, group)
    ordered = _numbered(rows, _pointers(rows, group), [F.col("num_obs").desc(), "id"], group)
    longest = rows.groupBy(*group).agg(F.max("length").alias("_maxlen"))
    ordered = join_derived(ordered, longest, group, "inner")
    pad = F.col("_maxlen") - F.col("length")
    return ordered.select(
        *group, "row_idx", "id", "obs_idx", "tick", "t", "num_obs", "length",
        F.concat("obs_values", F.array_repeat(F.lit(0.0), pad)).alias("x_padded"),
        F.concat("obs_features", F.array_repeat(F.lit(0), pad)).alias("f_padded"),
    )


def seq_batch_check(rows: DataFrame, times: DataFrame, group=GROUP) -> DataFrame:
    """Per batch: row total equals the last pointer (the collate assert)."""
    group = list(group)
    n_rows = rows.groupBy(*group).agg(F.count("*").alias("n_rows"))
    last = times.groupBy(*group).agg(F.max("ptr_end").alias("last_ptr"))
    return n_rows.join(last, group, "full_outer").select(
        *group, "n_rows", "last_ptr", (F.col("n_rows") == F.col("last_ptr")).alias("ok")
    )
