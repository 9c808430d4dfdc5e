"""Best-fit packing of token sequences by large-item matching (operator 9).

Piece lengths are whole numbers up to the capacity, so a packing is fully
described by a table with one row per (length, kind of bin). Spark counts
pieces per length (at most 2048 rows reach the driver, whatever the input),
the driver packs those counts, and Spark deals the pieces to the bins by
their rank within their length.

The packing: lengths above a third of the capacity fit at most twice in a
bin; from the longest down, each takes the longest partner that still fits
(greedy matching). Smaller lengths, from the longest down, go to the bin
with the smallest gap that holds them; new bins open when none does.

Ranks within a length are taken per (length, hash slice) and moved by the
counts of earlier slices, so a length that a third of all pieces have is
sorted by many tasks.

Cases: null or empty text is one piece holding only the closing id 0;
documents over the capacity are cut into full pieces, the first being the
rest; repeated rows are packed as often as they occur; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartwise.llm import tokens
from chartwise.llm.common import save, ship

CAPACITY = 2048
ROWS_PER_SLICE = 1_000_000
MIN_SLICES = 64
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, json_file: str, rank_file: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and a closing 0, cut to ``capacity``."""
    ship(docs.sparkSession)

    def cut(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(tokens.ids_of(text.as_py(), json_file, rank_file), np.uint32(0)).astype("<u4")
                n = len(ids)
                first = (n - 1) % capacity + 1
                edges = [0, *range(first, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    for col, v in zip(out, (doc, k, a, b - a, zlib.crc32(ids[a:b])), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:])],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, _PIECES)


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Pack counted lengths. Rows (length, from_rank, to_rank, first_bin, per_bin, offset).

    Ranks ``from_rank <= r < to_rank`` of a length go to bin
    ``first_bin + (r - from_rank) div per_bin`` at
    ``offset + (r - from_rank) mod per_bin * length``.
    """
    left = {s: c for s, c in counts.items() if c > 0}
    used: dict[int, int] = defaultdict(int)
    rows: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> runs of equal bins (first, count)
    bins = 0

    def put(size, first, count, each, at):
        rows.append((size, used[size], used[size] + count * each, first, each, at))
        used[size] += count * each
        left[size] -= count * each

    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    for s in large:
        while left[s] > 0:
            t = next((t for t in large if t <= capacity - s and left[t] > 0 and (t != s or left[s] > 1)), None)
            if t == s:
                m = left[s] // 2
                put(s, bins, m, 2, 0)
            elif t is not None:
                m = min(left[s], left[t])
                put(s, bins, m, 1, 0)
                put(t, bins, m, 1, s)
            else:
                m = left[s]
                put(s, bins, m, 1, 0)
            gap = capacity - s - (t or 0)
            if gap:
                gaps[gap].append((bins, m))
            bins += m
    open_gaps = sorted(gaps)
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[s] > 0:
            at = bisect.bisect_left(open_gaps, s)
            if at == len(open_gaps):
                each = capacity // s
                m = max(1, left[s] // each)
                first, gap = bins, capacity
                bins += m
            else:
                gap = open_gaps[at]
                first, m = gaps[gap].pop()
                if not gaps[gap]:
                    open_gaps.pop(at)
                each = gap // s
            whole = min(m, left[s] // each)
            parts = [(first, whole, each)] if whole else []
            rest = left[s] - whole * each
            if whole < m and rest:
                parts.append((first + whole, 1, min(rest, each)))
            for start, n, per in parts:
                put(s, start, n, per, capacity - gap)
                _open(gaps, open_gaps, gap - per * s, start, n)
            taken = sum(n for _, n, _ in parts)
            _open(gaps, open_gaps, gap, first + taken, m - taken)
    return rows


def _open(gaps, open_gaps, gap, first, count) -> None:
    if gap and count:
        if not gaps[gap]:
            bisect.insort(open_gaps, gap)
        gaps[gap].append((first, count))


def ranked(pieces: DataFrame, slices: int) -> DataFrame:
    """Add ``_rank`` from 0 within each length."""
    sliced = pieces.withColumn("_slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(slices)))
    local = sliced.withColumn("_local", F.row_number().over(
        Window.partitionBy("length", "_slice").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    before = sliced.groupBy("length", "_slice").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("length", "_slice", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    return local.join(before, ["length", "_slice"]).withColumn("_rank", F.col("_before") + F.col("_local")).drop(
        "_slice", "_local", "_before")


def pack(docs: DataFrame, json_file: str, rank_file: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of ``docs``."""
    spark = docs.sparkSession
    pieces = save(token_pieces(docs, json_file, rank_file, capacity))
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # one row per length: <= capacity
    rows = plan_bins(counts, capacity)
    plan = spark.createDataFrame(rows or [(0, 0, 0, 0, 1, 0)], "_size long, _from long, _to long, _first long, _each long, _at long")
    slices = max(MIN_SLICES, sum(counts.values()) // ROWS_PER_SLICE)
    r = F.col("_rank") - F.col("_from")
    # the plan's size depends on the capacity (kinds of bins), not on the number of documents
    return ranked(pieces, slices).join(
        F.broadcast(plan), (F.col("length") == F.col("_size")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    ).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("_first") + F.floor(r / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_at") + F.pmod(r, F.col("_each")) * F.col("length")).cast("long").alias("offset"))
