"""Join helpers with a measured broadcast decision.

A side derived from the data (a cohort's id set, a per-subject maximum)
is broadcast only after it has been materialised once in the shared
checkpoint folder and its size measured; above the limit the join stays
a shuffle join, which AQE can still split when a key is skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartwise import scratch

# Largest derived side that is broadcast, and how much larger rows are in
# memory than in the compressed files their size is taken from.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024
MEMORY_FACTOR = 8


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and cut its lineage (see ``scratch``)."""
    return scratch.save(df)


class Derived:
    """A derived join side, materialised once, and whether its measured size may be broadcast."""

    def __init__(self, df: DataFrame, limit_bytes: int = BROADCAST_LIMIT_BYTES):
        self.df = materialise(df)
        self.fits = scratch.written_bytes(self.df) * MEMORY_FACTOR <= limit_bytes

    def side(self) -> DataFrame:
        return F.broadcast(self.df) if self.fits else self.df


def join_derived(big: DataFrame, small, on, how: str = "inner",
                 limit_bytes: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Join ``big`` with a data-derived ``small`` side, broadcasting it only if measured small.

    A side used by several joins is passed as ``Derived`` and written once.
    """
    small = small if isinstance(small, Derived) else Derived(small, limit_bytes)
    return big.join(small.side(), on, how)


def _bytes_read(df: DataFrame) -> int:
    """Size of the tables that ``df`` reads."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    # a leaf whose size Spark does not know (rows made in the session) reports the largest there is
    return sum(x for x in sizes if x < 1 << 60)


def _conf_bytes(spark, key: str, default: str) -> int:
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key, default))


def slice_count(df: DataFrame, expansion: int = 1) -> int:
    """Tasks for sorting or expanding ``df``: one per advisory partition of the tables it reads, at least the shuffle width.

    ``expansion``: bytes made of each byte read.
    """
    spark = df.sparkSession
    advisory = _conf_bytes(spark, "spark.sql.adaptive.advisoryPartitionSizeInBytes", "64m")
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-_bytes_read(df) * expansion // advisory))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give a CPU-heavy row expansion (tokenising whole texts) every core, however few files it comes from.

    An input that has a split for every core already is left where it is, so
    that large tables are not shuffled. Smaller ones get a hash repartition
    on ``key``, which is deterministic on retry. Its number is
    stated, since adaptive execution would join partitions by their bytes
    although the work on each byte is what counts.
    """
    spark = df.sparkSession
    split = _conf_bytes(spark, "spark.sql.files.maxPartitionBytes", "128m")
    if _bytes_read(df) >= split * spark.sparkContext.defaultParallelism:
        return df
    return df.repartition(slice_count(df), key)
