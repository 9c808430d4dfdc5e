"""Nearest neighbours with a hierarchical k-means tree (operator 1).

The tree is fitted on a bounded sample (SAMPLE vectors with the smallest
hash of their id): every node is split into BRANCH clusters until a leaf
holds few enough sample vectors that, carried over to all rows, it holds
about LEAF_ROWS. Every row is then sent to its leaf.

A query walks the tree best-bin-first: a priority queue of branches by
distance to their centre; the nearest branch is opened, its children are
queued, and leaves are visited in the order they come off the queue.
How many leaves: sample queries are answered exactly and by the tree,
and the number of visits is raised until the recall reaches TARGET. A query
whose leaves hold too few rows for its neighbours goes on to further leaves.

Queries and rows meet by (shard, block). A shard is a run of neighbouring
leaves with about BLOCK_ROWS rows; a leaf with more is a shard of its own,
its rows dealt to blocks by a hash. A shard's queries are dealt to blocks
likewise, and every pair of blocks is one group: a leaf that holds a third
of all rows is many bounded groups. Within a group a query is compared
with the rows of the leaves it visits. Distances are differences in double
precision on the original vectors; each group returns its ten best per
query, and a second aggregation the ten best of those.

Cases: vectors that are null, empty, zero, hold null or non-finite
numbers, or have another length than most take no part; fewer than ten
candidates give as many rows; ties go to the smaller id; rows that repeat
an id are one candidate each, and no candidate of the query with that id;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartwise.llm.common import save, ship

NEIGHBOURS = 10
SAMPLE = 20_000
BRANCH = 8
LEAF_ROWS = 256
LEAST_LEAF_SAMPLE = 8
TARGET = 0.95
PROBES = 200
BLOCK_ROWS = 8192
BLOCK_QUERIES = 512
SEED = 11


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, v array<double>): rows whose vector is complete, finite, not zero and of the usual length."""
    v = F.col(vec_col).cast("array<double>")
    ok = vectors.filter(F.col(id_col).isNotNull() & v.isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0))
    usual = ok.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).first()
    return ok.filter(F.size("v") == (usual["n"] if usual else 0))


class Tree:
    """Hierarchical k-means: centres and children per node; leaves are numbered."""

    def __init__(self, points: np.ndarray, leaf_points: int, branch: int = BRANCH):
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []  # >= 0: node, < 0: leaf -1 - number
        self.leaves = 0
        self.root = self._grow(points, leaf_points, branch, np.random.default_rng(SEED))

    def _grow(self, x, leaf_points, branch, rng) -> int:
        if len(x) <= leaf_points or not (x != x[0]).any():
            self.leaves += 1
            return -self.leaves
        centre = x[rng.choice(len(x), min(branch, len(x)), replace=False)]
        for _ in range(10):
            own = nearest(x, centre)
            filled = [k for k in range(len(centre)) if (own == k).any()]
            centre = np.stack([x[own == k].mean(axis=0) for k in filled])
        own = nearest(x, centre)
        if len(np.unique(own)) < 2:
            self.leaves += 1
            return -self.leaves
        node = len(self.centres)
        self.centres.append(centre)
        self.children.append([])
        self.children[node] = [self._grow(x[own == k], leaf_points, branch, rng) if (own == k).any() else self._empty()
                               for k in range(len(centre))]
        return node

    def _empty(self) -> int:
        self.leaves += 1
        return -self.leaves

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every row."""
        out = np.zeros(len(x), np.int64)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -1 - node
            elif len(rows):
                own = nearest(x[rows], self.centres[node])
                todo += [(c, rows[own == k]) for k, c in enumerate(self.children[node])]
        return out

    def visit(self, q: np.ndarray, leaves: int, sizes=None, least: int = 0) -> list[int]:
        """The first ``leaves`` leaves by best-bin-first, and more until they hold ``least`` rows by ``sizes``."""
        out: list[int] = []
        queue = [(0.0, 0, self.root)]
        pushed = held = 0
        while queue and (len(out) < leaves or held < least):
            _, _, node = heapq.heappop(queue)
            if node < 0:
                out.append(-1 - node)
                held += sizes[-1 - node] if sizes is not None else 0
                continue
            d = ((self.centres[node] - q) ** 2).sum(axis=1)
            for k, c in enumerate(self.children[node]):
                pushed += 1
                heapq.heappush(queue, (float(d[k]), pushed, c))
        return out


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    for a in range(0, len(x), 4096):
        p = x[a: a + 4096]
        out[a: a + 4096] = np.argmin((centres ** 2).sum(axis=1) - 2 * (p @ centres.T), axis=1)
    return out


def calibrate(tree: Tree, sample: np.ndarray, k: int, target: float) -> int:
    """Leaf visits that find ``target`` of the exact neighbours of sample queries within the sample.

    Where the sample is a part of the rows, its k-th neighbour lies farther
    out than among all rows, so recall on all rows is higher, if anything.
    """
    leaf = tree.assign(sample)
    probes = np.random.default_rng(SEED).choice(len(sample), min(PROBES, len(sample)), replace=False)
    k = min(k, len(sample) - 1)
    if k < 1:
        return tree.leaves
    paths, truth = {}, {}
    for i in probes:
        d = ((sample - sample[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        truth[i] = leaf[np.argsort(d, kind="stable")[:k]]
        paths[i] = tree.visit(sample[i], tree.leaves)
    visits = 1
    while visits < tree.leaves:
        hit = sum(np.isin(truth[i], paths[i][:visits]).sum() for i in probes)
        if hit >= target * k * len(probes):
            break
        visits = min(tree.leaves, visits + max(1, visits // 4))
    return visits


def search(vectors: DataFrame, is_query, neighbours: int = NEIGHBOURS, target: float = TARGET,
           id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score, visits): the nearest rows found for every row with ``is_query`` (on column id).

    visits is the calibrated number of leaves, the least that a query visits.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = save(usable(vectors, id_col, vec_col))
    n = rows.count()
    taken = [r[0] for r in rows.orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(SAMPLE).select("v").collect()]  # at most SAMPLE vectors
    sample = np.array(taken, dtype=np.float64)
    empty = "query_id long, rank int, vec_id long, score double, visits int"
    if n == 0:
        return spark.createDataFrame([], empty)
    leaf_points = max(LEAST_LEAF_SAMPLE, int(LEAF_ROWS * len(sample) / n))
    tree = Tree(sample, leaf_points)
    visits = calibrate(tree, sample, neighbours, target)
    held = spark.sparkContext.broadcast(tree)  # at most 2 * SAMPLE / LEAST_LEAF_SAMPLE centres

    def place(batches):
        for b in batches:
            x = np.stack(b.column(1).to_numpy(zero_copy_only=False)) if b.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(held.value.assign(x))], names=["id", "v", "leaf"])

    placed = save(rows.mapInArrow(place, "id long, v array<double>, leaf long"))
    # one number per leaf: runs of leaves become shards
    size = {r[0]: r[1] for r in placed.groupBy("leaf").count().collect()}
    sizes = [size.get(k, 0) for k in range(tree.leaves)]
    shard_of = spark.sparkContext.broadcast(_shards(sizes))
    sizes_of = spark.sparkContext.broadcast(sizes)

    def route(batches):
        for b in batches:
            out: list[list] = [[], [], [], []]
            for i, v, own in zip(b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_pylist(), strict=True):
                by_shard: dict[int, list[int]] = {}
                for leaf in held.value.visit(v, visits, sizes_of.value, neighbours + own):
                    by_shard.setdefault(int(shard_of.value[leaf]), []).append(leaf)
                for shard, leaves in by_shard.items():
                    for col, x in zip(out, (i, v, shard, leaves), strict=True):
                        col.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.float64())), pa.array(out[2], pa.int64()), pa.array(out[3], pa.list_(pa.int64()))],
                names=["id", "v", "shard", "leaves"])

    queries = rows.filter(is_query)
    own = queries.groupBy("id").agg(F.count("*").alias("own"))  # rows with the query's id, itself among them, are no candidates
    routed = save(queries.join(own, "id").select("id", "v", "own").mapInArrow(route, "id long, v array<double>, shard long, leaves array<long>"))
    number = F.split(F.lit(",".join(map(str, shard_of.value))), ",").cast("array<bigint>")
    dealt = placed.withColumn("shard", F.get(number, F.col("leaf").cast("int")))
    row_blocks = dealt.groupBy("shard").agg(F.ceil(F.count("*") / (2 * BLOCK_ROWS)).alias("rb"))
    query_blocks = routed.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK_QUERIES).alias("qb"))
    blocks = F.broadcast(row_blocks.join(query_blocks, "shard"))  # one row per shard, at most one per leaf
    first = F.lit(0).cast("long")
    x = dealt.join(blocks, "shard").select("shard", F.pmod(F.xxhash64("id"), "rb").alias("r"),
                                           F.explode(F.sequence(first, F.col("qb") - 1)).alias("q"), "leaf", "id", "v")
    y = routed.join(blocks, "shard").select("shard", F.explode(F.sequence(first, F.col("rb") - 1)).alias("r"),
                                            F.pmod(F.xxhash64("id", F.lit(5)), "qb").alias("q"), "leaves", "id", "v")

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        left = left.sort_values("leaf", kind="stable")
        leaf, ids = left["leaf"].to_numpy(), left["id"].to_numpy()
        points = np.stack(left["v"].to_numpy())
        out = []
        for q, v, leaves in zip(right["id"], right["v"], right["leaves"], strict=True):
            lo, hi = np.searchsorted(leaf, leaves, "left"), np.searchsorted(leaf, leaves, "right")
            at = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi, strict=True)])
            at = at[ids[at] != q]
            if len(at):
                score = np.sqrt(((points[at] - v) ** 2).sum(axis=1))
                best = _first(ids[at], score, neighbours)
                out.append(pd.DataFrame({"query_id": q, "vec_id": ids[at][best], "score": score[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    found = x.groupBy("shard", "r", "q").cogroup(y.groupBy("shard", "r", "q")).applyInPandas(
        compare, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, neighbours).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("rank", "b")).select(
        "query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"),
        F.lit(visits).alias("visits"))


def _first(ids, score, k):
    """Places of the k smallest (score, id)."""
    edge = np.partition(score, k - 1)[k - 1] if len(score) > k else np.inf
    at = np.flatnonzero(score <= edge)
    return at[np.lexsort((ids[at], score[at]))[:k]]


def _shards(sizes: list[int]) -> list[int]:
    """Shard number of every leaf: runs of leaves with up to BLOCK_ROWS rows."""
    out, shard, held = [], 0, 0
    for n in sizes:
        if held and held + n > BLOCK_ROWS:
            shard, held = shard + 1, 0
        out.append(shard)
        held += n
    return out
