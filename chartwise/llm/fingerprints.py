"""Document fingerprints that tell which paragraphs two versions differ in (operator 13).

A fingerprint is an invertible Bloom lookup sketch of a text's distinct
paragraph digests (64 bits of BLAKE2b). Each digest goes to one cell in each
of three equal parts of the sketch; a cell holds how many digests it has, their
exclusive-or, and that of their check sums. Subtracting two sketches leaves
what differs. A cell with a count of 1 or -1 whose check sum fits holds one
differing digest: it is taken out of its other cells, which frees more cells
(peeling). If cells remain, both versions are sketched again with twice the
cells and other places, until peeling empties them.

So the recovered difference is exact (up to equal 64-bit digests), and the
likeness is that of the two sets of paragraphs: shared by all. The base
sketch has BASE_CELLS cells whatever the text; the larger ones exist only
while two versions are compared.

Paragraphs are lines with the white space around them taken off, empty ones
left out; a line of over LONG_LINE characters falls into its sentences.

``with_edits`` compares every document with an edited version and with the
next document in descending order of ids. Documents are dealt once, into
ranges of ids; a range also gets the first document of the range after it,
so neighbours meet in one task without a window over everything, and a task
reads its documents as a stream.

Cases: null text is empty; two empty texts have likeness 1; an id that
repeats orders its rows by text hash and text; documents without id come
last; a single document is its own next one; a text without line or sentence ends is
one paragraph; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartwise.llm.common import mix, nz, ship, trim
from chartwise.operators.joins import slice_count

PARTS = 3
BASE_CELLS = 8 * PARTS
LONG_LINE = 200
RANGES_PER_TASK = 4
MOST_RANGES = 16384
SAMPLE_IDS = 100_000
_SENTENCE = re.compile(r"(?<=[.!?;])\s+")
_CELL = np.dtype([("count", "<i4"), ("check", "<u4"), ("key", "<u8")])


def paragraphs(text: str) -> list[str]:
    """Distinct units of ``text`` that are compared, in order of appearance."""
    out: dict[str, None] = {}
    for line in text.split("\n"):
        line = line.strip()
        for unit in _SENTENCE.split(line) if len(line) > LONG_LINE else [line]:
            if unit:
                out[unit] = None
    return list(out)


def digests(text: str) -> np.ndarray:
    """Sorted 64-bit digests of the distinct paragraphs."""
    raw = b"".join(hashlib.blake2b(p.encode(), digest_size=8).digest() for p in paragraphs(text))
    return np.unique(np.frombuffer(raw, "<u8"))


def _places(keys: np.ndarray, cells: int) -> np.ndarray:
    """(PARTS, keys): the cells of each key in a sketch of ``cells`` cells."""
    part = cells // PARTS
    return np.stack([mix(keys + np.uint64((cells << 8) + p + 1)) % np.uint64(part) + np.uint64(p * part) for p in range(PARTS)]).astype(np.int64)


def _check(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)


def sketches(keys: np.ndarray, off: np.ndarray, cells: int) -> np.ndarray:
    """One sketch per text (rows); ``off`` bounds each text's keys."""
    n = len(off) - 1
    out = np.zeros(n * cells, _CELL)
    row = np.repeat(np.arange(n), np.diff(off)) * cells
    check = _check(keys)
    for place in _places(keys, cells):
        at = row + place
        np.add.at(out["count"], at, 1)
        np.bitwise_xor.at(out["key"], at, keys)
        np.bitwise_xor.at(out["check"], at, check)
    return out.reshape(n, cells)


def subtract(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a.copy()
    out["count"] -= b["count"]
    out["key"] ^= b["key"]
    out["check"] ^= b["check"]
    return out


def peel(diff: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, side, done): the keys recovered from each row's difference (side 1: only in the first), and whether all were."""
    n, cells = diff.shape
    flat = diff.copy().reshape(-1)
    rows, keys, sides = [], [], []
    while True:
        one = np.abs(flat["count"]) == 1
        at = np.flatnonzero(one)
        at = at[_check(flat["key"][at]) == flat["check"][at]]
        if not len(at):
            break
        key, row, side = flat["key"][at], at // cells, flat["count"][at]
        order = np.lexsort((key, row))  # a key can be alone in several of its cells
        key, row, side = key[order], row[order], side[order]
        fresh = np.append(True, (key[1:] != key[:-1]) | (row[1:] != row[:-1]))
        key, row, side = key[fresh], row[fresh], side[fresh]
        # of a wrong cell (a check sum that fits by chance) nothing else is right; such a row never empties and is made anew
        check = _check(key)
        for place in _places(key, cells):
            where = row * cells + place
            np.subtract.at(flat["count"], where, side)
            np.bitwise_xor.at(flat["key"], where, key)
            np.bitwise_xor.at(flat["check"], where, check)
        rows.append(row)
        keys.append(key)
        sides.append(side)
        if sum(map(len, keys)) > n * cells:
            break
    left = flat.reshape(n, cells)
    done = ~((left["count"] != 0) | (left["key"] != 0) | (left["check"] != 0)).any(axis=1)
    cat = [np.concatenate(x) if x else np.zeros(0, t) for x, t in ((rows, np.int64), (keys, np.uint64), (sides, np.int32))]
    return cat[0], cat[1], cat[2], done


def _flat(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    off = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    return (np.concatenate(lists) if lists else np.zeros(0, "<u8")).astype(np.uint64), off


def differences(a: list[np.ndarray], b: list[np.ndarray], cells: int = BASE_CELLS) -> tuple[list, np.ndarray]:
    """Per pair of versions (digests each): (only in a, only in b), and the cells it took."""
    out: list = [None] * len(a)
    took = np.zeros(len(a), np.int64)
    todo = np.arange(len(a))
    while len(todo):
        diff = subtract(sketches(*_flat([a[i] for i in todo]), cells), sketches(*_flat([b[i] for i in todo]), cells))
        row, key, side, done = peel(diff)
        order = np.argsort(row, kind="stable")
        row, key, side = row[order], key[order], side[order]
        cut = np.searchsorted(row, np.arange(len(todo) + 1))
        for k in np.flatnonzero(done):
            ks, sd = key[cut[k]: cut[k + 1]], side[cut[k]: cut[k + 1]]
            out[todo[k]] = (np.sort(ks[sd > 0]), np.sort(ks[sd < 0]))
            took[todo[k]] = cells
        todo = todo[~done]
        cells *= 2
    return out, took


def likeness(a: np.ndarray, b: np.ndarray, only_a: np.ndarray, only_b: np.ndarray) -> float:
    """Shared paragraphs by all paragraphs; 1 if neither version has any."""
    shared = len(a) - len(only_a)
    every = shared + len(only_a) + len(only_b)
    return shared / every if every else 1.0


def written(sketch: np.ndarray) -> str:
    """A fingerprint as text: the cells' bytes in base 64."""
    return base64.b64encode(np.ascontiguousarray(sketch).tobytes()).decode()


def read_back(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), _CELL)


def edited(text: str, following: str) -> str:
    """``text`` with its last half of code points replaced by the first as many (or all) of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_versions(pairs: DataFrame, cells: int = BASE_CELLS) -> DataFrame:
    """(key, only_old, only_new, cells, likeness) per row of ``pairs`` (key, old, new): the digests of paragraphs that differ."""
    ship(pairs.sparkSession)

    def run(batches):
        for batch in batches:
            a = [digests(x.as_py() or "") for x in batch.column(1)]
            b = [digests(x.as_py() or "") for x in batch.column(2)]
            got, took = differences(a, b, cells)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([g[k].view(np.int64) for g in got], pa.list_(pa.int64())) for k in (0, 1)), pa.array(took),
                 pa.array([likeness(x, y, *g) for x, y, g in zip(a, b, got, strict=True)], pa.float64())],
                names=["key", "only_old", "only_new", "cells", "likeness"])
        trim()

    return pairs.select(F.col("key").cast("string"), "old", "new").mapInArrow(
        run, "key string, only_old array<long>, only_new array<long>, cells long, likeness double")


def _bounds(rows: DataFrame, ranges: int) -> np.ndarray:
    """Ascending ids that cut the ids into about ``ranges`` equal parts, from at most about SAMPLE_IDS of them.

    They only say which task a document goes to; results are the same for any bounds.
    """
    every = max(1, rows.count() // SAMPLE_IDS)
    ids = rows.select("doc_id").filter(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)).distinct()
    got = np.sort(ids.toArrow().column(0).to_numpy())
    return np.unique(got[np.arange(1, ranges) * len(got) // ranges]) if len(got) else got


def in_order(docs: DataFrame) -> DataFrame:
    """Documents (part, guest, doc_id, _h, text) with all rows of a range in one partition, in descending order of ids.

    A range's guests are the rows with the first id of the next range, the
    last range's those of the first: what follows a range's last document.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), nz().alias("text"))
    tasks = slice_count(docs)
    bounds = _bounds(rows, min(tasks * RANGES_PER_TASK, MOST_RANGES))
    last = len(bounds) + 1

    @F.arrow_udf("int")
    def part(ids: pa.Array) -> pa.Array:  # high ids first; documents without id after all
        at = last - 1 - np.searchsorted(bounds, ids.fill_null(0).to_numpy(zero_copy_only=False), side="right")
        return pa.array(np.where(ids.is_null().to_numpy(zero_copy_only=False), last, at).astype(np.int32))

    rows = rows.withColumn("part", part("doc_id"))
    firsts = {r.part: r.first for r in rows.groupBy("part").agg(F.max("doc_id").alias("first")).collect()}  # one row a range
    parts = sorted(firsts)
    table = spark.createDataFrame([(p, firsts[p], parts[k - 1]) for k, p in enumerate(parts)], "_part int, _first long, _before int")
    marked = rows.join(F.broadcast(table), F.col("part") == F.col("_part"), "left")
    own = F.struct(F.col("part"), F.lit(False).alias("guest"))
    places = F.when(F.col("doc_id").eqNullSafe(F.col("_first")),
                    F.array(own, F.struct(F.col("_before").alias("part"), F.lit(True).alias("guest")))).otherwise(F.array(own))
    placed = marked.select(F.explode(places).alias("_p"), "doc_id", "text").select(
        "_p.part", "_p.guest", "doc_id", F.xxhash64("text").alias("_h"), "text")
    return placed.repartition(tasks, "part").sortWithinPartitions("part", "guest", F.col("doc_id").desc_nulls_last(), "_h", "text")


_EDITS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_cells long"


def with_edits(docs: DataFrame) -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and its likeness to that text and to the next document."""
    ship(docs.sparkSession)
    names = [c.split()[0] for c in _EDITS.split(", ")]

    def made(rows):
        """``rows``: (doc_id, text, digests, next text, next digests)."""
        if not rows:
            return pa.RecordBatch.from_arrays([pa.array([], t) for t in (
                pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64())], names=names)
        new = [edited(t, f) for _, t, _, f, _ in rows]
        own, following = [r[2] for r in rows], [r[4] for r in rows]
        changed = [digests(t) for t in new]
        to_edit, took = differences(own, changed)
        to_next, _ = differences(own, following)
        prints = [[written(s) for s in sketches(*_flat(x), BASE_CELLS)] for x in (own, changed)]
        return pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows], pa.int64()), pa.array([len(r[1]) for r in rows], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new]), *map(pa.array, prints),
            *(pa.array([likeness(a, b, *g) for a, b, g in zip(own, other, got, strict=True)], pa.float64())
              for other, got in ((changed, to_edit), (following, to_next))), pa.array(took)], names=names)

    def run(batches):
        held = None  # (part, doc_id, text, digests) waiting for the document after it
        for batch in batches:
            rows = []
            for part, guest, doc, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True):
                if guest and (held is None or held[0] != part):
                    continue  # the range has its neighbour already
                now = (part, doc, text, digests(text))
                if held is not None:
                    rows.append((*held[1:], text, now[3]))
                held = None if guest else now
            yield made(rows)
        trim()

    return in_order(docs).mapInArrow(run, _EDITS)
