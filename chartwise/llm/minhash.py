"""Near-duplicate documents by bottom-k sketches (operator 6).

One hash function maps every word shingle to 64 bits. A document's sketch
is the K smallest values of its shingle set. Of two sets with Jaccard
similarity J, each of the smallest values of their union lies in both with
probability J, so similar documents retain nearly the same values.

1. Texts with the same shingle set are one class from here on, with a number
   of its own; its representative has the smallest id. Links of classes
   become links of ids at the end, so an id that stands on several texts
   has the links of all.
2. Inverted lists: every three neighbouring retained values are a key;
   documents with a key in common are candidates. Single values would put
   all documents that share a passage into one list; three in a row rarely
   are neighbours in two documents that are not alike. At J = 0.8 a pair
   shares no three in a row of K with probability below 1e-7; sets of at
   most K values are listed whole, and two such sets with J >= 0.8 always
   share a key (sets of at most five values also list pairs).
3. Union sketch: the K smallest values of both sketches together, and how
   many of them both hold, estimate J. Pairs below LEAST_ESTIMATE
   (six standard deviations below 0.8) are dropped.
4. The full shingle sets confirm the rest exactly. Shingles are told apart by
   64-bit hashes of their words (words of over 64 bytes: of BLAKE2b), so a
   link can be wrong only where different shingles of the two texts collide:
   for two texts of n shingles with probability n^2 / 2^64.

Lists are not expanded into all pairs. First each member is paired with
the list's first member and with its neighbours in the list; confirmed
links give components. Lists within one component are then finished.
In the others only pairs across components remain. Lists of up to
LIST_LIMIT members give them one by one. Longer lists (one passage in very
many documents, large families of copies) are joined to clusters, whose
members are compared in blocks of about BLOCK_SHINGLES: a task holds two
blocks, drops pairs by component, size and retained values, confirms the
others on full sets, and returns only links that join components.

Cases: null text or text without words has no shingles and no links; with
fewer than ``words`` words the whole sequence is the only shingle; rows
that repeat a doc_id are one vertex; rows with null doc_id are returned
unlinked with a null component; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartwise.llm.common import boxed, chunks, drop, lower, mix, nz, save, ship, text_bytes, trim, word_hashes, word_spans
from chartwise.llm.components import components
from chartwise.operators.joins import join_derived

K = 48
LEAST_ESTIMATE = 0.45
CHUNK_BYTES = 256 << 10
LIST_LIMIT = 32
BLOCK_SHINGLES = 300_000
_M = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3,
                             0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x2F2BE8E9A9C1E9B5)]


def shingle_sets(text: pa.Array, words: int):
    """Per row of an Arrow text column: its distinct shingle hashes in order (uint64)."""
    buf, off = text_bytes(text)
    for a, b in chunks(off, CHUNK_BYTES):
        part = lower(buf[off[a]: off[b]])
        rows = off[a: b + 1] - off[a]
        start, end, row = word_spans(part, rows)
        h = word_hashes(part, start, end)
        first = np.searchsorted(row, np.arange(b - a + 1))
        full = max(0, len(h) - words + 1)
        sh = np.zeros(full, np.uint64)
        for k in range(words):
            sh += mix(h[k: k + full] * _M[k % len(_M)] + np.uint64(k + 1))
        sh = mix(sh)
        for i in range(b - a):
            lo, hi = first[i], first[i + 1]
            if hi - lo >= words:
                yield np.unique(sh[lo: hi - words + 1])
            elif hi > lo:
                with np.errstate(over="ignore"):
                    one = np.uint64(hi - lo)
                    for k in range(lo, hi):
                        one = mix(one * _M[0] + h[k: k + 1])[0]
                yield np.array([one], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def _lists(values: list[np.ndarray]) -> pa.Array:
    edges = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values).view(np.int64) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(flat, pa.int64()))


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, _h, n_shingles, sig_a, sig_b, sketch): the text's hash, set size, two 64-bit sums naming the set, K smallest values."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            n, a, b, s = [], [], [], []
            for v in shingle_sets(batch.column(2), words):
                n.append(len(v))
                a.append(int(np.sum(mix(v ^ _M[1])).view(np.int64)))
                b.append(int(np.sum(mix(v ^ _M[2])).view(np.int64)))
                s.append(v[:K])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), _lists(s)],
                names=["doc_id", "_h", "n_shingles", "sig_a", "sig_b", "sketch"])
        trim()

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(nz()).alias("_h"), "text").mapInArrow(
        run, "doc_id long, _h long, n_shingles long, sig_a long, sig_b long, sketch array<long>")


def _estimated(pairs: DataFrame, sketch: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) whose union sketch and set sizes allow the threshold."""
    s = sketch.select("class_id", "n_shingles", "sketch")
    both = (pairs.join(s.toDF("u", "nu", "su"), "u").join(s.toDF("v", "nv", "sv"), "v")
            .filter(f"100 * least(nu, nv) >= {percent} * greatest(nu, nv)"))

    def run(batches):
        for batch in batches:
            t = batch.to_pydict()
            keep = []
            for i, (a, b) in enumerate(zip(t["su"], t["sv"], strict=True)):
                # the columns are signed, the sketches' order is unsigned
                a, b = np.array(a, np.int64).view(np.uint64), np.array(b, np.int64).view(np.uint64)
                union = np.union1d(a, b)[:K]
                common = np.intersect1d(a, b, assume_unique=True)
                if np.count_nonzero(common <= union[-1]) >= LEAST_ESTIMATE * len(union):
                    keep.append(i)
            yield pa.RecordBatch.from_pydict({"u": pa.array([t["u"][i] for i in keep], pa.int64()),
                                              "v": pa.array([t["v"][i] for i in keep], pa.int64())})
        trim()

    return both.select("u", "v", "su", "sv").mapInArrow(run, "u long, v long")


def full_sets(docs: DataFrame, classes: DataFrame, needed: DataFrame, words: int) -> DataFrame:
    """(class_id, set) of the classes in ``needed``, from the text of the representative.

    The ids are written and measured: while they are small they go to the
    texts, so that only the needed texts move; beyond that both are shuffled.
    """
    def sets(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(list(shingle_sets(batch.column(1), words)))],
                                             names=["class_id", "set"])
        trim()

    wanted = join_derived(classes.select("class_id", F.col("rep").alias("doc_id"), "_h"), needed.distinct(), "class_id", "left_semi")
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64(nz()).alias("_h"), "text")
    return (join_derived(texts, wanted, ["doc_id", "_h"]).select("class_id", "text")
            .dropDuplicates(["class_id"]).mapInArrow(sets, "class_id long, set array<long>"))


def confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs with 100 * |A and B| >= percent * |A or B|, on full sets.

    Sets are made for classes that occur in a pair only, and travel to
    their pairs; a class with many partners is dealt out by pair.
    """
    pairs = save(pairs)
    full = save(full_sets(docs, classes, pairs.select(F.col("u").alias("class_id")).union(pairs.select("v")), words))

    def check(batches):
        for batch in batches:
            us, vs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            a, b = batch.column(2), batch.column(3)
            keep = []
            for i in range(len(us)):
                x, y = a[i].values.to_numpy(), b[i].values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = np.array(keep, bool)
            yield pa.RecordBatch.from_arrays([pa.array(us[keep]), pa.array(vs[keep])], names=["u", "v"])
        trim()

    out = save(pairs.join(full.toDF("u", "a"), "u").join(full.toDF("v", "b"), "v")
               .select("u", "v", "a", "b").mapInArrow(check, "u long, v long"))
    drop(pairs)
    drop(full)
    return out


def _linked_in_blocks(t: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Links that join components among the (at most two) blocks of a table of class_id, root, block, set."""
    ids, root, block = (t.column(c).to_numpy() for c in ("class_id", "root", "block"))
    order = np.argsort(block, kind="stable")
    ids, root, block = ids[order], root[order].copy(), block[order]
    column = t.column("set")
    sets = [column[int(i)].values.to_numpy().view(np.uint64) for i in order]
    size = np.array([len(x) for x in sets])
    second = int(np.searchsorted(block, block[-1])) if block[0] != block[-1] else 0
    least = [x[:K] for x in sets]
    # retained values of the second block, with their owners
    owner = np.repeat(np.arange(second, len(ids)), [len(x) for x in least[second:]])
    value = np.concatenate(least[second:])
    at = np.argsort(value, kind="stable")
    owner, value = owner[at], value[at]
    links = []
    for i in range(second if second else len(ids)):
        lo, hi = np.searchsorted(value, least[i], "left"), np.searchsorted(value, least[i], "right")
        n = hi - lo
        where = np.repeat(hi - np.cumsum(n), n) + np.arange(n.sum())
        common = np.bincount(owner[where], minlength=len(ids))
        ok = (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i])) & (root != root[i])
        ok &= common >= LEAST_ESTIMATE * np.minimum(K, np.maximum(size, size[i]))
        ok[: second if second else i + 1] = False
        for j in np.flatnonzero(ok):
            if root[i] == root[j]:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= percent * (size[i] + size[j] - both):
                links.append((int(ids[i]), int(ids[j])))
                a, b = min(root[i], root[j]), max(root[i], root[j])
                root[root == b] = a
    return links


def _across_long_lists(long: DataFrame, docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between components within the clusters that long lists form; ``long``: key, class_id, n_shingles, root."""
    hub = long.groupBy("key").agg(F.min("class_id").alias("hub"))
    clusters = components(long.join(hub, "key").select(F.col("hub").alias("u"), F.col("class_id").alias("v"))).toDF("class_id", "cluster")
    # classes linkable by size lie in the same or in neighbouring size classes
    member = save(long.select("class_id", "n_shingles", "root").distinct().join(clusters, "class_id", "left").select(
        "class_id", "root", F.coalesce("cluster", "class_id").alias("cluster"), "n_shingles",
        F.floor(F.log(F.col("n_shingles").cast("double")) / float(np.log(100 / percent))).alias("s")))
    count = member.groupBy("cluster", "s").agg(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).alias("n"))
    sized = member
    for name, step in (("same", 0), ("up", 1), ("down", -1)):
        sized = sized.join(count.select("cluster", (F.col("s") - step).alias("s"), F.col("n").alias(name)), ["cluster", "s"], "left")
    sized = sized.withColumn("h", F.pmod(F.xxhash64("class_id"), "same"))
    tasks = F.expr(
        "concat(transform(sequence(0L, same - 1), x -> struct(s AS s1, least(h, x) AS h1, s AS s2, greatest(h, x) AS h2)),"
        " if(up is null, array(), transform(sequence(0L, coalesce(up, 1L) - 1), x -> struct(s AS s1, h AS h1, s + 1 AS s2, x AS h2))),"
        " if(down is null, array(), transform(sequence(0L, coalesce(down, 1L) - 1), x -> struct(s - 1 AS s1, x AS h1, s AS s2, h AS h2))))")
    full = full_sets(docs, classes, member.select("class_id"), words)
    dealt = sized.join(full, "class_id").select(
        "cluster", F.explode(tasks).alias("t"), "class_id", "root", F.struct("s", "h").alias("own"), "set").select(
        "cluster", "t.*", "class_id", "root",
        F.when((F.col("own.s") == F.col("t.s1")) & (F.col("own.h") == F.col("t.h1")), 0).otherwise(1).alias("block"), "set")

    def compare(t: pa.Table) -> pa.Table:
        links = _linked_in_blocks(t, percent)
        return pa.table({"u": pa.array([min(x) for x in links], pa.int64()), "v": pa.array([max(x) for x in links], pa.int64())})

    return save(dealt.groupBy("cluster", "s1", "h1", "s2", "h2").applyInArrow(compare, "u long, v long"))


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    sketched = save(sketches(docs, words))
    # saved, so that a class keeps its number, and the join below has plain shuffles on both sides and a large class can be split
    classes = save(sketched.filter("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "sig_a", "sig_b")
                   .agg(F.min("doc_id").alias("rep"), F.min_by("_h", "doc_id").alias("_h"))
                   .withColumn("class_id", F.monotonically_increasing_id()))
    member = save(sketched.join(classes.drop("_h"), ["n_shingles", "sig_a", "sig_b"], "left")
                  .select("doc_id", "n_shingles", "class_id", F.expr("if(doc_id is null, null, coalesce(rep, doc_id))").alias("rep"),
                          F.expr("if(doc_id = rep, sketch, null)").alias("sketch")))
    drop(sketched)
    # rows that repeat an id and its text give the sketch again
    reps = save(member.filter("sketch is not null").select("class_id", "n_shingles", "sketch").dropDuplicates(["class_id"]))
    keyed = reps.filter("size(sketch) > 1").select("class_id", "n_shingles", F.explode(F.expr(
        "concat(transform(sequence(1, greatest(size(sketch) - 2, 1)),"
        "   i -> xxhash64(element_at(sketch, i), element_at(sketch, i + 1), try_element_at(sketch, i + 2))),"
        " if(size(sketch) <= 5, transform(sequence(1, size(sketch) - 1),"
        "   i -> xxhash64(element_at(sketch, i), element_at(sketch, i + 1))), cast(array() as array<bigint>)))")).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("class_id").alias("hub")).filter("n > 1")
    lists = save(keyed.join(shared, "key").select("key", "class_id", "n_shingles", "hub"))
    # first pass: the list's first member, and the next one in the list (dealt in blocks of classes so that no list is one task)
    star = lists.filter("class_id <> hub").select(F.col("hub").alias("u"), F.col("class_id").alias("v"))
    w = Window.partitionBy("key", F.pmod(F.xxhash64("class_id"), F.lit(64))).orderBy("class_id")
    chain = lists.select(F.lag("class_id").over(w).alias("u"), F.col("class_id").alias("v")).filter("u is not null")
    overlap = star.union(chain).groupBy("u", "v").agg(F.count("*").alias("shared"))
    # of a member's pairs, those with most shared keys first; the others wait for the second pass
    top = overlap.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy(F.desc("shared"), "u"))).filter("r <= 3")
    linked = confirmed(_estimated(top.select("u", "v"), reps, percent), docs, classes, words, percent)
    roots = save(components(linked))
    # second pass: pairs across components, from lists that still span more than one
    placed = lists.join(roots.toDF("class_id", "root"), "class_id", "left").select(
        "key", "class_id", "n_shingles", F.coalesce("root", "class_id").alias("root"))
    spans = placed.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("first"), F.max("root").alias("last")).filter("first <> last")
    spanning = save(placed.join(spans.select("key", "n"), "key"))
    short = spanning.filter(F.col("n") <= LIST_LIMIT)
    x, y = (short.select("key", F.col("class_id").alias(c), F.col("root").alias("r" + c), F.col("n_shingles").alias("n" + c)) for c in "xy")
    across = (x.join(y, "key").filter(f"x < y and rx <> ry and 100 * least(nx, ny) >= {percent} * greatest(nx, ny)")
              .select(F.col("x").alias("u"), F.col("y").alias("v")).distinct())
    more = confirmed(_estimated(across, reps, percent), docs, classes, words, percent).union(
        _across_long_lists(spanning.filter(F.col("n") > LIST_LIMIT), docs, classes, words, percent))
    drop(lists)
    drop(spanning)
    # an id on several texts is a member of several classes
    named = classes.select("class_id", "rep")
    links = linked.union(more).join(named.toDF("u", "a"), "u").join(named.toDF("v", "b"), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    edges = links.union(member.filter("doc_id <> rep").select(F.col("rep").alias("u"), F.col("doc_id").alias("v")))
    roots = save(components(edges)).toDF("doc_id", "root")
    drop(classes)
    return member.join(roots, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"),
        F.expr("coalesce(root, doc_id) <=> doc_id").alias("kept"))


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group (the smallest id), with the columns of ``docs``."""
    kept = near_groups(docs, words, percent).filter("kept").select(F.col("doc_id").alias("_id")).distinct()
    return boxed(docs, _doc=F.col("doc_id")).join(kept, F.col("_doc").eqNullSafe(F.col("_id")), "left_semi").select("_row.*")
