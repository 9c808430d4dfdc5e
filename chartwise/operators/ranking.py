"""Exact row positions over a total order without a single-task window.

``row_number() OVER (ORDER BY ...)`` with no partition key, or with a key
of a handful of values (fold, split, class), runs in one task. Here the
rows are range-partitioned on (group, order) so every task sorts a slice,
each row gets its offset inside its slice, and a small table of slice
counts per group supplies the running offset of earlier slices. A group
holding a third of all rows is spread over many slices like any other.

The order columns must make the order total (add a unique tie-break),
which also makes the positions reproducible when a task is re-run. The
sliced rows are materialised once in the shared checkpoint folder before
counting: range boundaries are sampled from shuffle output whose order
varies, so two evaluations could disagree on which slice a row is in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartwise.operators.joins import materialise, slice_count


_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row offset in the low 33 bits


def _as_cols(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def hash_slice(hex_col: str, n: int) -> Column:
    """Order-preserving slice of a hex digest column: its 6-digit prefix scaled to 0..n-1."""
    return F.floor(F.conv(F.substring(F.col(hex_col), 1, 6), 16, 10).cast("double") * n / float(16 ** 6)).cast("int")


def positions(df: DataFrame, order, group=(), out: str = "pos", slices: int | None = None,
              hash_ordered: bool = False) -> DataFrame:
    """Add ``out`` = 0-based position of each row within ``group`` by ``order``.

    ``hash_ordered``: the first order column is a hex digest (md5), so a
    slice is a pure function of the row (``hash_slice``), evenly filled,
    and nothing needs to be materialised; ranks are taken per
    (group, slice) and offset by the counts of earlier slices.
    """
    group = list(group)
    order_cols = _as_cols(order)
    n = slices or slice_count(df)
    if hash_ordered:
        first = order[0]
        sliced = df.withColumn("_slice", hash_slice(first, n))
        local = Window.partitionBy(*group, "_slice").orderBy(*order_cols)
        sliced = sliced.withColumn("_local", (F.row_number().over(local) - 1).cast("bigint"))
        counts = sliced.groupBy("_slice", *group).agg(F.count("*").alias("_n"))
        w = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.select("_slice", *group, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
        joined = sliced.join(offsets, ["_slice", *group], "inner")
        return joined.withColumn(out, (F.col("_before") + F.col("_local")).cast("bigint")).drop(
            "_slice", "_local", "_before")
    sliced = (
        df.repartitionByRange(n, *_as_cols(group), *order_cols)
        .sortWithinPartitions(*_as_cols(group), *order_cols)
        .withColumn("_mid", F.monotonically_increasing_id())
        .withColumn("_slice", F.shiftright("_mid", _LOCAL_BITS))
        .withColumn("_local", F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)))
    )
    sliced = materialise(sliced)
    counts = sliced.groupBy("_slice", *group).agg(
        F.count("*").alias("_n"), F.min("_local").alias("_first")
    )
    w = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_slice", *group, "_first", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    # The offsets side has one row per (slice, group); AQE broadcasts it
    # from its measured size.
    joined = sliced.join(offsets, ["_slice", *group], "inner")
    return joined.withColumn(out, (F.col("_before") + F.col("_local") - F.col("_first")).cast("bigint")).drop(
        "_mid", "_slice", "_local", "_first", "_before"
    )


def running(df: DataFrame, value: str, order, group=(), how: str = "sum", out: str = "running",
            inclusive: bool = False, slices: int | None = None) -> DataFrame:
    """Running ``sum`` or ``max`` of ``value`` over ``order`` within ``group``.

    Exclusive by default (rows strictly before), which is what offsets,
    pointer tables and "best so far" flags need. Computed per range slice
    (a bounded window per slice) plus a prefix over the per-slice totals,
    so a group with few keys or one huge key still runs in parallel.
    The order must be total.
    """
    group = list(group)
    order_cols = _as_cols(order)
    n = slices or slice_count(df)
    agg = {"sum": F.sum, "max": F.max}[how]
    sliced = materialise(
        df.repartitionByRange(n, *_as_cols(group), *order_cols).withColumn("_slice", F.spark_partition_id())
    )
    frame = (Window.unboundedPreceding, 0 if inclusive else -1)
    local = sliced.withColumn(
        "_local", agg(value).over(Window.partitionBy("_slice", *group).orderBy(*order_cols).rowsBetween(*frame))
    )
    totals = sliced.groupBy("_slice", *group).agg(agg(value).alias("_tot"))
    prior = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_slice", *group, agg("_tot").over(prior).alias("_prior"))
    joined = local.join(totals, ["_slice", *group], "inner")
    if how == "sum":
        combined = F.coalesce(F.col("_prior"), F.lit(0)) + F.coalesce(F.col("_local"), F.lit(0))
    else:
        combined = F.greatest(F.col("_prior"), F.col("_local"))  # greatest skips NULLs
    return joined.withColumn(out, combined).drop("_slice", "_local", "_prior")


def first_by(df: DataFrame, group, order, last: bool = False) -> DataFrame:
    """One row per ``group``: the row that sorts first (or last) by ``order``.

    A map-side-combinable ``min``/``max`` over ``struct(order..., row)``
    instead of ``row_number() OVER (PARTITION BY group)``: a group holding a
    third of all rows is reduced in every task before the shuffle.
    ``order`` entries may be column names or expressions (aliased).
    """
    group = list(group)
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    keys = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    row = F.struct(*[F.col(c) for c in df.columns]).alias("_row")
    pick = F.max if last else F.min
    best = df.groupBy(*group).agg(pick(F.struct(*keys, row)).alias("_best"))
    return best.select(*[F.col(f"_best._row.{c}").alias(c) for c in df.columns])


def first_n(df: DataFrame, group, order, n: int) -> DataFrame:
    """The first ``n`` rows of every ``group`` by ``order`` (total within the group).

    A ``row_number() <= n`` filter, which Spark plans as a WindowGroupLimit:
    every task cuts each group to ``n`` rows before the shuffle, so a group
    holding a third of all rows sends at most ``n`` rows per task.
    """
    w = Window.partitionBy(*group).orderBy(*_as_cols(order))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
