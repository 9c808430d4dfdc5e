"""Removal of byte strings that repeat anywhere in the corpus, with suffix arrays (operator 8).

A byte goes if a string of ``length`` (400) bytes that covers it also
starts elsewhere. So every 400-byte window of every text must be compared
with every other; the work is dealt so that equal windows always meet.

1. Anchors. Each window names as its anchor the position of its smallest
   GRAM-byte hash (leftmost if tied). Equal windows have equal anchors at
   equal places, and neighbouring windows mostly share one: a text falls
   into runs of windows by anchor, one run per about 140 bytes, each with
   the bytes its windows cover (a segment).
2. Segments that occur twice as a whole repeat in all their windows.
   Counting them moves 40 bytes per run, with map-side reduction, so a
   passage copied into a third of all rows is a few rows. They are counted by
   name: 128 bits of BLAKE2b of the whole string.
3. One copy of every distinct segment whose gram occurs in another
   segment goes to the group of its gram, and groups go to tasks. A task
   cuts its segments into shards of SHARD_BYTES. Each shard sorts its suffixes
   (Larsson-Sadakane refinement), takes common prefixes (Kasai) and marks
   the windows that share 400 bytes with another. Shards of one group are
   merged by binary search: each one's windows are looked up among the
   others' sorted suffixes.
4. A group of over GROUP_BYTES is dealt further by a second anchor (the
   smallest under another hash of the grams), by which its segments fall
   into shorter runs: equal windows have that in common too. Its runs are
   counted, and grouped by both grams, as segments were; then by a third
   anchor. What still stands in groups that large has the same grams
   around it everywhere and is cut into single windows, counted by name.
5. Marked windows are carried back to all copies of their segment and cut
   out of the texts.

Cases: null text is empty; texts under 400 bytes keep all bytes; rows that
repeat a doc_id and text are repeats of each other; rows that share a
doc_id but not the text are told apart; runs of one byte give one segment
per window, all equal; extra columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartwise.llm.common import chunks, drop, mix, nz, save, ship, shuffle_width, span_hashes, text_bytes, trim
from chartwise.llm.suffixes import common_prefixes, found_in, suffix_array

LENGTH = 400
GRAM = 128
PIECE_BYTES = 256 << 10  # bytes worked on at a time (about 20 arrays of 8 bytes each)
SHARD_BYTES = 512 << 10
GROUP_BYTES = 4 << 20
TASK_BYTES = 2 << 20
LEVELS = 3
_POS = np.uint64((1 << 24) - 1)


def _gram_hashes(buf: np.ndarray, gram: int) -> np.ndarray:
    n = len(buf) - gram + 1
    start = np.arange(n)
    return span_hashes(buf, start, start + gram)


def _leftmost_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours."""
    n = len(x)
    m = -(-n // w)
    full = np.full(m * w, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = x
    rows = full.reshape(m, w)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1: n])


def _names(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit names of spans, as two columns of 64 bits."""
    view = memoryview(np.ascontiguousarray(buf))
    raw = b"".join(hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True))
    both = np.frombuffer(raw, "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def segments(buf: np.ndarray, off: np.ndarray, length: int, gram: int, level: int = 0):
    """Runs of windows with the same ``level`` + 1 anchors: row, start, windows, group by all but the last anchor, group by all, names.

    A group is named by the hashes of the grams at the anchors; without a last anchor to leave out it is 0.
    """
    n = len(buf)
    if n < length:
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.int64)] * 4
    h = _gram_hashes(buf, gram)
    w = length - gram + 1
    places = np.arange(len(h), dtype=np.uint64)
    best = []
    for k in range(level + 1):
        salted = mix(h ^ np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))) if k else h
        best.append((_leftmost_min((salted & ~_POS) | places, w) & _POS).astype(np.int64))
    m = len(best[0])
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))[:m]
    valid = np.arange(m) + length <= off[row + 1]
    edge = np.ones(m, bool)
    edge[1:] = (row[1:] != row[:-1]) | (valid[1:] != valid[:-1])
    for x in best:
        edge[1:] |= x[1:] != x[:-1]
    first = np.flatnonzero(edge)
    windows = np.diff(np.append(first, m))
    ok = valid[first]
    first, windows = first[ok], windows[ok]
    before = own = np.zeros(len(first), np.uint64)
    for k, x in enumerate(best):
        before, own = own, (mix(own + np.uint64(k)) ^ h[x[first]]) if k else h[x[first]]
    return [row[first], first - off[row[first]], windows, before.view(np.int64), own.view(np.int64),
            *_names(buf, first, first + windows - 1 + length)]


def _pieces(buf: np.ndarray, off: np.ndarray, length: int):
    """(bytes, offsets, row numbers, shift) of bounded size; a long text comes in parts that overlap by length - 1."""
    for a, b in chunks(off, PIECE_BYTES):
        part = buf[off[a]: off[b]]
        if len(part) <= PIECE_BYTES:
            yield part, off[a: b + 1] - off[a], a, 0
        else:  # one long row
            for s in range(0, max(1, len(part) - length + 1), PIECE_BYTES):
                cut = part[s: s + PIECE_BYTES + length - 1]
                yield cut, np.array([0, len(cut)]), a, s


_ANCHOR = "doc_id long, _h long, start long, windows long, gram long, seg_a long, seg_b long"


def anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            buf, off = text_bytes(batch.column(2))
            ids, hs = batch.column(0), batch.column(1)
            for part, po, a, shift in _pieces(buf, off, length):
                row, start, windows, _, g, sa, sb = segments(part, po, length, gram)
                at = pa.array(row + a)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(at), hs.take(at), pa.array(start + shift), pa.array(windows), *map(pa.array, (g, sa, sb))],
                    names=["doc_id", "_h", "start", "windows", "gram", "seg_a", "seg_b"])
        trim()

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(nz()).alias("_h"), "text").mapInArrow(run, _ANCHOR)


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    d = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(d == 1).tolist(), np.flatnonzero(d == -1).tolist(), strict=True))


class Shard:
    """Segments with their sorted windows; ``marked``: bytes at which a window starts that also starts elsewhere."""

    def __init__(self, parts: list[bytes], length: int):
        self.sizes = np.array([len(p) for p in parts])
        self.ends = np.cumsum(self.sizes)
        self.length = length
        self.buf = np.frombuffer(b"".join(parts), dtype=np.uint8)
        order = suffix_array(self.buf, 2 * length)
        lcp = common_prefixes(self.buf, order, length)
        fits = order + length <= self.ends[np.searchsorted(self.ends, order, side="right")]
        group = np.cumsum(lcp < length)
        count = np.bincount(group, weights=fits)
        self.marked = np.zeros(len(self.buf), bool)
        self.marked[order] = fits & (count[group] > 1)
        self.windows = order[fits]

    def merge(self, other: Shard) -> None:
        """Mark the windows of both that the other has too, by binary search in its sorted windows."""
        for a, b in ((self, other), (other, self)):
            a.marked[a.windows[found_in(a.buf, a.windows, b.buf, b.windows, self.length)]] = True

    def flags(self) -> list[np.ndarray]:
        return [self.marked[e - s: max(e - s, e - self.length + 1)] for s, e in zip(self.sizes, self.ends, strict=True)]


def repeated_windows(parts: list[bytes], length: int, shard_bytes: int = SHARD_BYTES) -> list[np.ndarray]:
    """Per segment: which of its windows also start elsewhere in ``parts``."""
    off = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    shards = [Shard(parts[a:b], length) for a, b in chunks(off, shard_bytes)]
    for i, one in enumerate(shards):
        for other in shards[:i]:
            one.merge(other)
    return [f for s in shards for f in s.flags()]


def _intervals(flags: np.ndarray, length: int) -> list[int]:
    """Byte ranges (from, to, from, to, ...) covered by marked windows, from the segment's start."""
    out: list[int] = []
    for a, b in _runs(flags):
        b += length - 1
        if out and a <= out[-1]:
            out[-1] = b
        else:
            out += [a, b]
    return out


_COVER = "seg_a long, seg_b long, cover array<int>"


def _marked_in_shards(held: DataFrame, length: int) -> DataFrame:
    """(seg_a, seg_b, cover) of segments with repeated windows; ``held``: grp, seg_a, seg_b, bytes."""
    total = held.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    tasks = max(shuffle_width(held.sparkSession), -(-total // TASK_BYTES))
    schema = pa.schema([("seg_a", pa.int64()), ("seg_b", pa.int64()), ("cover", pa.list_(pa.int32()))])

    def whole(t: pa.Table) -> pa.Table:
        t = t.sort_by("grp")  # rows come in the order of the join before
        out = []
        for lo, hi in _groups_of(t, SHARD_BYTES):  # whole groups; one of over SHARD_BYTES by itself, in several shards
            sub = t.slice(lo, hi - lo)
            flags = repeated_windows([x.as_py() for x in sub.column("bytes")], length)
            keep = [i for i, f in enumerate(flags) if f.any()]
            out.append(pa.RecordBatch.from_arrays([
                sub.column("seg_a").take(pa.array(keep, pa.int64())).combine_chunks(),
                sub.column("seg_b").take(pa.array(keep, pa.int64())).combine_chunks(),
                pa.array([_intervals(flags[i], length) for i in keep], pa.list_(pa.int32()))], schema=schema))
        trim()
        return pa.Table.from_batches(out, schema)

    # the number of tasks is stated: adaptive execution would join tasks by their bytes, and sorting costs far more a byte than reading
    dealt = held.withColumn("task", F.pmod(F.xxhash64("grp"), F.lit(tasks))).repartition(tasks, "task")
    return dealt.groupBy("task").applyInArrow(whole, _COVER)


def _groups_of(t: pa.Table, limit: int):
    """Row ranges of whole groups of about ``limit`` bytes in a table sorted by group."""
    gram = t.column("grp").to_numpy()
    size = np.array([len(x.as_py()) for x in t.column("bytes")])
    edges = np.append(np.flatnonzero(np.append(True, gram[1:] != gram[:-1])), len(gram))
    total = np.concatenate([[0], np.cumsum(size)])
    lo = 0
    for k in range(1, len(edges)):
        if k == len(edges) - 1 or total[edges[k + 1]] - total[lo] > limit:
            yield lo, int(edges[k])
            lo = int(edges[k])


def _finer(hot: DataFrame, length: int, gram: int, level: int) -> DataFrame:
    """Runs of the segments in ``hot`` by one more anchor: seg_a, seg_b, at, before (group one level up), grp, sub_a, sub_b, bytes.

    Beyond the last level every window is a run, and its name its group.
    """
    names = ["seg_a", "seg_b", "at", "before", "grp", "sub_a", "sub_b", "bytes"]

    def run(batches):
        for batch in batches:
            parts = [x.as_py() for x in batch.column(2)]
            buf = np.frombuffer(b"".join(parts), np.uint8)
            off = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            for a, b in chunks(off, PIECE_BYTES):
                po = off[a: b + 1] - off[a]
                part = buf[off[a]: off[b]]
                row, start, windows, before, own, sa, sb = segments(part, po, length, gram, min(level, LEVELS - 1))
                if level >= LEVELS:
                    first = np.repeat(po[row] + start, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
                    row, before = np.repeat(row, windows), np.repeat(own, windows)
                    start, windows = first - po[row], np.ones(len(row), np.int64)
                    sa, sb = _names(part, first, first + length)
                    own = sa
                lo = po[row] + start
                data = [part[x:y].tobytes() for x, y in zip(lo.tolist(), (lo + windows - 1 + length).tolist(), strict=True)]
                at = pa.array(row + a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(start.astype(np.int32)), *map(pa.array, (before, own, sa, sb)),
                     pa.array(data, pa.binary())], names=names)
        trim()

    return hot.select("seg_a", "seg_b", "bytes").mapInArrow(
        run, "seg_a long, seg_b long, at int, before long, grp long, sub_a long, sub_b long, bytes binary")


def _marked(held: DataFrame, length: int, gram: int) -> list[DataFrame]:
    """Tables (seg_a, seg_b, cover) of the windows that ``held`` (grp, seg_a, seg_b, bytes; distinct) shares among its segments."""
    found = []
    units, runs = held, None  # at finer levels units are distinct runs; ``runs`` says where they stand in segments
    for level in range(LEVELS + 1):
        sizes = units.groupBy("grp").agg(F.sum(F.octet_length("bytes")).alias("_bytes"), F.count("*").alias("_n"))
        sized = units.join(sizes.filter("_n > 1"), "grp")
        if level < LEVELS:
            cover = save(_marked_in_shards(sized.filter(F.col("_bytes") <= GROUP_BYTES).select("grp", "seg_a", "seg_b", "bytes"), length))
            found.append(cover if runs is None else _placed(runs, cover))
        if level == LEVELS:
            break
        large = save(sizes.filter(F.col("_bytes") > GROUP_BYTES).select(F.col("grp").alias("before")))
        if not large.limit(1).count():
            break
        # the segments that stand in such a group, by one more anchor; of their runs those of such a group
        hot = held.join(large.toDF("grp"), "grp", "left_semi") if runs is None else held.join(
            runs.join(large.toDF("grp"), "grp", "left_semi").select("seg_a", "seg_b").distinct(), ["seg_a", "seg_b"], "left_semi")
        runs = save(_finer(hot, length, gram, level + 1).join(large, "before", "left_semi"))
        counted = runs.groupBy("grp", "sub_a", "sub_b").agg(F.count("*").alias("n"), F.first("bytes").alias("bytes"))
        units = save(counted.select("grp", F.col("sub_a").alias("seg_a"), F.col("sub_b").alias("seg_b"), "n", "bytes"))
        runs = runs.drop("bytes")
        found.append(_placed(runs, units.filter("n > 1").select("seg_a", "seg_b", F.array(F.lit(0), F.octet_length("bytes")).alias("cover"))))
        units = units.drop("n")
    return found


def _placed(runs: DataFrame, cover: DataFrame) -> DataFrame:
    """Covers of runs as covers of the segments they stand in."""
    return runs.join(cover.toDF("sub_a", "sub_b", "cover"), ["sub_a", "sub_b"]).select(
        "seg_a", "seg_b", F.transform("cover", lambda x: x + F.col("at")).alias("cover"))


def _cut(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, seg_a, seg_b, bytes) for the segments that ``wanted`` places in documents."""
    spans = wanted.groupBy("doc_id", "_h").agg(F.collect_list(F.struct("start", "size", "gram", "seg_a", "seg_b")).alias("spans"))
    text = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64(nz()).alias("_g"), nz().cast("binary").alias("_b"))
    one = text.join(spans, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_g") == F.col("_h")))
    return one.select("_b", F.explode("spans").alias("s")).select(
        "s.gram", "s.seg_a", "s.seg_b", F.expr("substring(_b, int(s.start) + 1, int(s.size))").alias("bytes")).dropDuplicates(["seg_a", "seg_b"])


def covered(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, _h, runs): per text with repeats, what its segments say is to go: start and byte ranges [from, to, ...] from there."""
    runs = save(anchors(docs, length, gram))
    segs = save(runs.groupBy("gram", "seg_a", "seg_b").agg(
        F.count("*").alias("n"), F.first("doc_id").alias("doc_id"), F.first("_h").alias("_h"),
        F.first("start").alias("start"), (F.first("windows") + length - 1).alias("size")))
    grams = segs.groupBy("gram").agg(F.count("*").alias("segs")).filter("segs > 1")
    held = save(_cut(docs, segs.join(grams.select("gram"), "gram")).withColumnRenamed("gram", "grp"))
    whole = segs.filter("n > 1").select("seg_a", "seg_b", F.array(F.lit(0), F.col("size").cast("int")).alias("cover"))
    hits = whole
    for cover in _marked(held, length, gram):
        hits = hits.unionByName(cover)
    found = runs.join(hits, ["seg_a", "seg_b"]).select("doc_id", "_h", "start", "cover")
    drop(held)
    # rows that repeat (doc_id, text) give the same ranges again
    return found.groupBy("doc_id", "_h").agg(F.collect_set(F.struct("start", "cover")).alias("runs"))


def _merged(runs) -> list[tuple[int, int]]:
    """Sorted byte ranges, those that touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((r["start"] + x, r["start"] + y) for r in runs or () for x, y in zip(r["cover"][::2], r["cover"][1::2], strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) per row of ``docs``; kept: the remaining bytes."""
    spans = covered(docs, length, gram).toDF("_id", "_g", "runs")
    text = docs.select(F.col("doc_id").cast("long"), F.xxhash64(nz()).alias("_h"), "text")
    both = text.join(spans, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_g") == F.col("_h")), "left").select("doc_id", "text", "runs")

    def run(batches):
        for batch in batches:
            buf, off = text_bytes(batch.column(1))
            cols: list[list] = [[], [], [], [], []]
            for i, s in enumerate(batch.column(2)):
                raw = buf[off[i]: off[i + 1]].tobytes()
                spans = _merged(s.as_py())
                out, last, gone = [], 0, 0
                for a, b in spans:
                    out.append(raw[last:a])
                    gone += b - a
                    last = b
                left = b"".join([*out, raw[last:]])
                for c, v in zip(cols, (len(raw), gone, len(spans), hashlib.sha256(left).hexdigest(), left), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
        trim()

    return both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
