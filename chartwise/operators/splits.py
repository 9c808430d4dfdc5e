"""Reproducible splits and batches of entity ids.

Every random choice is an md5 of (id, seed) so Spark, a re-run task and the
DuckDB oracle pick the same rows. Ranks come from ``ranking.positions``
(range slices plus offsets): a fold, split or class holding a third of the
ids is still sorted by many tasks.

* ``folds``          repeated train/val/test split per fold (not k-fold): test = ceil(p·N),
                     val = ceil(q·(N − test)), seed + fold                   (I1)
* ``stratified``     per-class test share, rounded half up per class           (I2)
* ``thirds``         contiguous thirds of an ordered table, rest to the last   (I3)
* ``batches``        seeded shuffle then fixed-size batches per fold/split     (F7, C10)
* ``write_folds`` / ``read_fold``  partitioned fold sink and pruned reader     (A11)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartwise.operators.joins import join_derived
from chartwise.operators.ranking import positions


def hash_key(id_col: str, seed) -> Column:
    """md5 of "<id>-<seed>"; ``seed`` may be a column (seed + fold)."""
    s = seed if isinstance(seed, Column) else F.lit(seed)
    return F.md5(F.concat_ws("-", F.col(id_col).cast("string"), s.cast("string")))


def _count(df: DataFrame) -> Column:
    """Row count of ``df`` as a scalar subquery (planned once, inlined as a value)."""
    return df.agg(F.count("*")).scalar()


def folds(ids: DataFrame, n_folds: int = 5, test_size: float = 0.1, val_size: float = 0.2,
          seed: int = 432) -> DataFrame:
    """``fold, split, id`` for every fold; splits overlap across folds."""
    distinct = ids.select("id").distinct()
    n = _count(distinct)
    per_fold = distinct.select("id", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))).alias("fold"))
    keyed = per_fold.withColumn("_h", hash_key("id", F.lit(seed) + F.col("fold")))
    ranked = positions(keyed, ["_h", "id"], group=["fold"], out="_rank", hash_ordered=True)
    n_test = F.ceil(F.lit(float(test_size)) * n)
    n_val = F.ceil(F.lit(float(val_size)) * (n - n_test))
    split = (
        F.when(F.col("_rank") < n_test, "test").when(F.col("_rank") < n_test + n_val, "val").otherwise("train")
    )
    return ranked.select("fold", split.alias("split"), "id")


def stratified(df: DataFrame, label: str = "label", test_size: float = 0.25, seed: int = 42) -> DataFrame:
    """Adds ``split`` (train/test) with round(test_size · n_class) test rows per class."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))  # one row per class, measured before broadcast
    keyed = df.withColumn("_h", hash_key("id", seed))
    ranked = join_derived(positions(keyed, ["_h", "id"], group=[label], out="_rank", hash_ordered=True), counts, label)
    n_test = F.floor(F.lit(float(test_size)) * F.col("_n") + F.lit(0.5))
    return ranked.withColumn("split", F.when(F.col("_rank") < n_test, "test").otherwise("train")).drop(
        "_h", "_rank", "_n"
    )


def thirds(df: DataFrame, order, out: str = "part", hash_ordered: bool = False) -> DataFrame:
    """Contiguous thirds in ``order``: size n div 3, the remainder joins the last."""
    ranked = positions(df, order, out="_pos", hash_ordered=hash_ordered)
    size = F.greatest(F.floor(_count(df) / 3), F.lit(1))
    return ranked.withColumn(out, F.least(F.floor(F.col("_pos") / size), F.lit(2)).cast("int")).drop("_pos")


def batches(assign: DataFrame, batch_size: int = 500, seed: int = 0, group=("fold", "split")) -> DataFrame:
    """Seeded shuffle of ids within each group, cut into ``batch_size`` batches.

    ``pos_in_batch`` is the id's position in its batch (the batch index map).
    """
    keyed = assign.withColumn("_h", hash_key("id", seed))
    ranked = positions(keyed, ["_h", "id"], group=list(group), out="_pos", hash_ordered=True)
    return ranked.select(
        *group, "id",
        F.floor(F.col("_pos") / batch_size).cast("bigint").alias("batch"),
        (F.col("_pos") % batch_size).cast("bigint").alias("pos_in_batch"),
    )


def write_folds(split: DataFrame, path: str) -> None:
    """One directory per (fold, split); readers prune to the partition they need.

    Range-partitioned on (fold, split, id) so a large split is written by
    many tasks rather than one. Directories that ``split`` has rows for are
    replaced, others stay, so writing twice leaves the same files.
    """
    (split.repartitionByRange("fold", "split", "id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("fold", "split").parquet(path))


def read_fold(spark, path: str, fold: int, split: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.where((F.col("fold") == fold) & (F.col("split") == split))
