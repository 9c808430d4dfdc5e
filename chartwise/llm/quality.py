"""Quality classifier by importance resampling (operator 3).

Two generative models of hashed n-grams (words and word pairs, lower
case, runs of punctuation as words; a pair of equal words counts a further
gram that all such pairs share) are counted: a target model from
documents labelled good, and a raw model from all documents. A document's
log importance weight is the sum over its n-grams of
log target(gram) - log raw(gram). Adding Gumbel noise to it and taking the
k largest draws k documents without replacement in proportion to their
weights (Gumbel top-k).

As a filter, k follows from labelled documents kept out of the target
model: the cutoff on the noisy weight is placed where those documents are
told apart with the least loss, a lost good document costing GOOD_COST
times a kept bad one. All documents above the cutoff are the top k.

The raw model reads every document. The labelled rows are a bounded
sample: the LABELLED rows with the smallest hash of their id, a third of
them for the cutoff. What returns to the driver is one row per hash
bucket and one per held-out label; noise depends on the id alone, so every
run and every retried task draws alike.

Cases: null or empty text has weight 0 plus noise; rows that repeat a
doc_id draw alike; null doc_id draws as id 0; a document labelled twice
counts as bad if any label says so; without labels of both classes nothing
is rejected; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartwise.llm.common import boxed, chunks, lower, mix, ship, text_bytes, word_hashes

BUCKETS = 1 << 14
LABELLED = 50_000
GOOD_COST = 5.0
SEED = 17
CHUNK_BYTES = 256 << 10
_KIND = np.zeros(256, np.int8)  # 0 white space or control, 1 punctuation, 2 letters, digits and all bytes of other characters
_KIND[33:127] = 1
_KIND[128:] = 2
for _a, _b in ((48, 58), (65, 91), (95, 96), (97, 123)):
    _KIND[_a:_b] = 2
_TWICE = np.uint64(0xA5A5A5A5A5A5A5A5)
_PAIR = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


def grams(text: pa.Array):
    """Per bounded piece of an Arrow text column: (first row, rows, bucket of each n-gram, its row)."""
    buf, off = text_bytes(text)
    for a, b in chunks(off, CHUNK_BYTES):
        part, rows = lower(buf[off[a]: off[b]]), off[a: b + 1] - off[a]
        kind = _KIND[part]
        edge = np.ones(len(part), bool)
        edge[1:] = kind[1:] != kind[:-1]
        edge[rows[1:-1][rows[1:-1] < len(part)]] = True
        start = np.flatnonzero(edge)
        end = np.append(start[1:], len(part))
        word = kind[start] > 0 if len(start) else np.zeros(0, bool)
        start, end = start[word], end[word]
        row = np.searchsorted(rows, start, side="right") - 1
        h = word_hashes(part, start, end)
        pair = mix(h[:-1] * _PAIR[0] + h[1:] * _PAIR[1])
        same = row[1:] == row[:-1]
        twice = same & (h[1:] == h[:-1])
        gram = np.concatenate([h, pair[same], np.full(np.count_nonzero(twice), _TWICE)])
        yield a, b - a, (gram >> np.uint64(50)).astype(np.int64), np.concatenate([row, row[1:][same], row[1:][twice]])


def labelled(labels: DataFrame, limit: int = LABELLED) -> DataFrame:
    """(doc_id, good, held): at most ``limit`` labelled documents; a third is held out."""
    one = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    return (one.withColumn("_o", F.xxhash64("doc_id", F.lit(SEED))).orderBy("_o", "doc_id").limit(limit)
            .select("doc_id", "good", (F.pmod("_o", F.lit(3)) == 0).alias("held")))


def model(docs: DataFrame, sample: DataFrame) -> np.ndarray:
    """log target - log raw for every bucket, add-one smoothed."""
    ship(docs.sparkSession)
    target = sample.filter("good and not held").select(F.col("doc_id").alias("_id"), F.lit(True).alias("_target"))

    def count(batches):
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            chosen = batch.column(1).fill_null(False).to_numpy(zero_copy_only=False)
            for a, _, gram, row in grams(batch.column(0)):
                raw += np.bincount(gram, minlength=BUCKETS)
                good += np.bincount(gram[chosen[row + a]], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(raw[at]), pa.array(good[at])], names=["bucket", "raw", "good"])

    marked = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(target), F.col("doc_id") == F.col("_id"), "left")
    # LABELLED bounds the broadcast side; one row per bucket and task is shuffled, one per bucket comes back
    rows = marked.select("text", "_target").mapInArrow(count, "bucket long, raw long, good long").groupBy("bucket").agg(
        F.sum("raw"), F.sum("good")).collect()
    raw, good = np.ones(BUCKETS), np.ones(BUCKETS)
    for bucket, r, g in rows:
        raw[bucket] += r
        good[bucket] += g
    if good.sum() == BUCKETS:  # no target text: nothing to tell apart
        return np.zeros(BUCKETS)
    return np.log(good / good.sum()) - np.log(raw / raw.sum())


def log_weight(ratio: np.ndarray) -> Column:
    """Log importance weight of the text column."""
    @F.pandas_udf("double")
    def weigh(text: pd.Series) -> pd.Series:
        out = np.zeros(len(text))
        for a, n, gram, row in grams(pa.array(text, pa.string(), from_pandas=True)):
            out[a: a + n] = np.bincount(row, weights=ratio[gram], minlength=n)
        return pd.Series(out)

    return weigh("text")


def gumbel(id_col: str = "doc_id", seed: int = SEED) -> Column:
    """Standard Gumbel noise as a function of the id."""
    u = (F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(id_col), F.lit(0)), F.lit(seed), F.lit("gumbel")), 11) + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def weighted(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """``docs`` with _log_weight and _key (the noisy weight)."""
    ship(docs.sparkSession)
    return docs.withColumn("_log_weight", log_weight(ratio)).withColumn("_key", F.col("_log_weight") + gumbel())


def cutoff(docs: DataFrame, sample: DataFrame, ratio: np.ndarray) -> float:
    """The key that separates held-out good and bad documents at the least cost; -inf without both."""
    held = sample.filter("held").select(F.col("doc_id").alias("_id"), "good")
    some = docs.select("doc_id", "text").join(F.broadcast(held), F.col("doc_id") == F.col("_id"))
    per_id = weighted(some, ratio).groupBy("doc_id").agg(F.min("_key").alias("_key"), F.first("good").alias("good"))  # an id may stand on many rows
    rows = sorted((r["_key"], r["good"]) for r in per_id.collect())  # at most LABELLED rows
    good = np.array([g for _, g in rows], bool)
    if good.all() or not good.any():
        return float("-inf")
    key = np.array([k for k, _ in rows])
    # cost of cutting before each row: good rows below it are lost, bad rows from it on stay
    lost = np.concatenate([[0], np.cumsum(good)])
    stay = (~good).sum() - np.concatenate([[0], np.cumsum(~good)])
    at = int(np.argmin(GOOD_COST * lost + stay))
    if at == 0:
        return float("-inf")
    return float((key[at - 1] + key[min(at, len(key) - 1)]) / 2)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    sample = labelled(labels)
    ratio = model(docs, sample)
    return ratio, cutoff(docs, sample, ratio)


def resampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, log_weight, noisy_weight, kept) per row of ``docs``."""
    ratio, least = fit(docs, labels)
    return weighted(docs.select("doc_id", "text"), ratio).select(
        "doc_id", F.col("_log_weight").alias("log_weight"), F.col("_key").alias("noisy_weight"),
        (F.col("_key") >= least).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents above the cutoff, with the columns of ``docs``."""
    ratio, least = fit(docs, labels)
    rows = boxed(docs, doc_id=F.col("doc_id"), text=F.col("text"))
    return weighted(rows, ratio).filter(F.col("_key") >= least).select("_row.*")


def top_k(docs: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """(doc_id, noisy_weight) of the k documents drawn by Gumbel top-k, ties to the smaller id."""
    ratio = model(docs, labelled(labels))
    return (weighted(docs.select("doc_id", "text"), ratio).select("doc_id", F.col("_key").alias("noisy_weight"))
            .orderBy(F.desc("noisy_weight"), "doc_id").limit(k))
