"""Connected components of a large edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartwise.llm.common import drop, save


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of ``edges`` (u, v): root is the smallest id in reach.

    Every round is two aggregations to a minimum (combined before the
    shuffle) and two joins by vertex that adaptive execution splits when
    one vertex holds many edges. The rounds end when the edges no longer
    change; a star needs one, a path of n edges about log n.
    """
    now = save(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = save(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following = save(small.union(low).distinct())
        drop(now)
        drop(large)
        now, before = following, mark
        mark = _mark(now)
        if mark == before:
            break
    return now.select(F.col("u").alias("v"), F.col("v").alias("root"))
