"""Exact dedup by deterministic block naming (operator 10).

A text's bytes are cut into fixed-size blocks. The distinct blocks are
sorted and numbered, so equal numbers mean equal bytes; then adjacent
pairs of numbers are sorted and numbered, level after level, until each
document is left with one number. Numbers are dealt task by task, each of
which sorts its own share. A SHA-256 of a block routes it to its number, and two
blocks meeting under one digest stop the run; rows that share a doc_id are
told apart by the SHA-256 of their texts. No result rests on a shorter hash.

Block texts cross the network once, as a distinct with map-side
reduction; everything after it moves numbers. A block, pair or text that
a third of the documents share is one row after the map side, and the
joins that bring numbers back are plain sort-merge joins that adaptive
execution splits.

Cases: null text is empty; an empty text is one empty block; rows that
repeat doc_id and text are counted and kept or dropped alike; null doc_id
takes part but never stays while its group has an id (its group's keep_id
is null if all are null; kept is then true); extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartwise.llm.common import boxed, drop, nz, save

BLOCK_BYTES = 8192


def _identity(text):
    """What tells texts of one doc_id apart."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _number(distinct: DataFrame, cols: list[str], out: str) -> DataFrame:
    """Number the distinct rows: every task sorts its share and counts on from its partition's base."""
    return distinct.sortWithinPartitions(*cols).withColumn(out, F.monotonically_increasing_id())


def name_texts(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, _h, level, name) per distinct (doc_id, text); equal (level, name) means equal text."""
    text = nz()
    raw = docs.select("doc_id", _identity(text).alias("_h"), text.cast("binary").alias("_b"))
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("_b") / block_bytes)).cast("int")
    blocks = raw.select(
        "doc_id", "_h", count.alias("_n"),
        F.posexplode(F.transform(
            F.sequence(F.lit(0), count - 1),
            lambda i: F.substring(F.col("_b"), i * block_bytes + 1, F.lit(block_bytes)))).alias("_i", "_block"))
    digest = F.unhex(F.sha2("_block", 256))
    names = save(_number(blocks.select("_block").distinct(), ["_block"], "_name").select(digest.alias("_d"), "_name"))
    if names.groupBy("_d").count().filter("count > 1").limit(1).count():
        raise ValueError("two different blocks share a SHA-256 digest")
    level = save(blocks.select("doc_id", "_h", "_n", "_i", digest.alias("_d")).join(names, "_d")
                 .select("doc_id", "_h", "_n", "_i", "_name").distinct())
    drop(names)
    done = [level.filter("_n = 1").select("doc_id", "_h", F.lit(0).alias("level"), F.col("_name").alias("name"))]
    most = level.agg(F.max("_n")).first()[0] or 1
    k = 0
    while most > 1:
        k += 1
        pairs = save(
            level.filter("_n > 1")
            .groupBy("doc_id", "_h", "_n", F.expr("_i div 2").cast("int").alias("_i"))
            .agg(F.max(F.expr("if(_i % 2 = 0, _name, null)")).alias("_a"),
                 F.coalesce(F.max(F.expr("if(_i % 2 = 1, _name, null)")), F.lit(-1)).alias("_c")))
        names = save(_number(pairs.select("_a", "_c").distinct(), ["_a", "_c"], "_name"))
        level = save(pairs.join(names, ["_a", "_c"])
                     .select("doc_id", "_h", F.ceil(F.col("_n") / 2).cast("int").alias("_n"), "_i", "_name"))
        drop(pairs)
        drop(names)
        done.append(level.filter("_n = 1").select("doc_id", "_h", F.lit(k).alias("level"), F.col("_name").alias("name")))
        most = (most + 1) // 2
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def exact_groups(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select("doc_id", _identity(nz()).alias("_h"), F.sha2(nz().cast("binary"), 256).alias("text_sha256"))
    names = name_texts(docs, block_bytes).withColumnRenamed("doc_id", "_id").withColumnRenamed("_h", "_g")
    named = save(rows.join(names, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_g")))
                 .select("doc_id", "text_sha256", "level", "name"))
    # saved, so that the join below has plain shuffles on both sides and a large group of copies can be split
    groups = save(named.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    return named.join(groups, ["level", "name"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with the columns of ``docs``."""
    kept = exact_groups(docs).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_s")).distinct()
    rows = boxed(docs, _doc=F.col("doc_id"), _t=F.sha2(nz().cast("binary"), 256))
    return rows.join(kept, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_s")), "left_semi").select("_row.*")
