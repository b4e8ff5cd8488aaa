"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on at most SAMPLE distinct vectors, chosen by hash; it is a few hundred centres, whatever
the table's size. Every row is then sent down to its leaf and the leaves are stored as blocks of
at most BLOCK_ROWS rows (a large leaf is dealt out to as many blocks as it needs). A query walks the tree
best bin first: a priority queue holds the nodes that were passed by, by distance of their centres, and the
nearest is opened next, so leaves come in order of promise. How many leaves to visit is calibrated:
for CALIBRATION hashed vectors the true neighbours are found by comparing them with all rows, and the visits are
widened until they would find the target share of them. Queries meet the blocks of their leaves in a join of
blocks; a task compares whole blocks and keeps the k nearest.

Equal vectors are one class: of its rows only the k + 1 least ids can be among any row's k
nearest, so only these are stored, and queries with one vector are searched once. This is exact, and
a group of copies of any size neither fills a leaf nor repeats a search.

Defined results: vectors that are null, empty, zero, or hold null or non-finite entries take no part, nor
do vectors of another length than the most frequent one (the least of several); rows of one id are rows of
their own (a query leaves out one row with its id and vector, itself); a null id is never a query and comes last in
ties; with fewer rows than k all are returned; an empty table gives no rows; other columns are
ignored, whatever their names. Distances that overflow a double are infinite.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written
from .vectors import dimension, matrix, valid

#: Distinct vectors that the tree is fitted on at most (expected number; chosen by hash), and that visits are calibrated on.
SAMPLE, CALIBRATION = 16_384, 256
BRANCHING, LEAF_SAMPLE, ROUNDS = 12, 256, 12
#: Share of true neighbours that the calibration asks for; the step by which visits are widened.
TARGET, WIDEN = 0.95, 1.1
BLOCK_ROWS, BLOCK_QUERIES = 4096, 512
NEIGHBOURS = 10


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows, by their differences."""
    with np.errstate(over="ignore"):
        d = q - x
        return np.sqrt((d * d).sum(-1))


def squared(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances of all pairs by a matrix product, and how far rounding can put them off."""
    a, b = (q * q).sum(1), (x * x).sum(1)
    most = float(max(a.max(initial=0), b.max(initial=0)))
    return a[:, None] + b[None, :] - 2 * (q @ x.T), most * 1e-15 * (q.shape[1] + 8) * 4


def nearest(q: np.ndarray, x: np.ndarray, rank: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of each query's k nearest rows; of equal distances the least rank first."""
    out = []
    with np.errstate(over="ignore", invalid="ignore"):
        near, slack = squared(q, x)
    for i in range(len(q)):
        row = near[i]
        if len(x) > k and np.isfinite(row).all():
            at = np.flatnonzero(row <= np.partition(row, k - 1)[k - 1] + 2 * slack)
        else:
            at = np.arange(len(x))
        d = distances(q[i], x[at])
        order = np.lexsort((rank[at], d))[:k]
        out.append((np.full(len(order), i), at[order], d[order]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


@dataclass
class Tree:
    """Nodes in one list; children of node i are first[i]:first[i] + count[i]; leaf[i] is a leaf's number or -1."""

    centre: list = field(default_factory=list)
    first: list = field(default_factory=list)
    count: list = field(default_factory=list)
    leaf: list = field(default_factory=list)
    leaves: int = 0

    @classmethod
    def fit(cls, x: np.ndarray, branching: int = BRANCHING, leaf_sample: int = LEAF_SAMPLE) -> Tree:
        tree, rng = cls(), np.random.default_rng(7)
        root = x.mean(0) if len(x) else np.zeros(x.shape[1])
        for name, v in (("centre", root), ("first", -1), ("count", 0), ("leaf", -1)):
            getattr(tree, name).append(v)
        todo = [(0, x)]
        while todo:
            node, own = todo.pop(0)
            centres, label = kmeans(own, branching, rng) if len(own) > leaf_sample else (None, None)
            if centres is None:
                tree.leaf[node], tree.leaves = tree.leaves, tree.leaves + 1
                continue
            tree.first[node], tree.count[node] = len(tree.centre), len(centres)
            for c, centre in enumerate(centres):
                for name, v in (("centre", centre), ("first", -1), ("count", 0), ("leaf", -1)):
                    getattr(tree, name).append(v)
                todo.append((tree.first[node] + c, own[label == c]))
        for name in ("centre", "first", "count", "leaf"):
            setattr(tree, name, np.array(getattr(tree, name)))
        return tree

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Each row's leaf: at every node on to the child with the nearest centre."""
        at = np.zeros(len(x), int)
        while (inner := np.unique(at[self.leaf[at] < 0])).size:
            for node in inner:
                rows = np.flatnonzero(at == node)
                child = self.centre[self.first[node] : self.first[node] + self.count[node]]
                at[rows] = self.first[node] + np.argmin(squared(x[rows], child)[0], axis=1)
        return self.leaf[at]

    def visits(self, q: np.ndarray, most: int) -> list[list[int]]:
        """For each query its first ``most`` leaves, best bin first."""
        if not len(q):
            return []
        near = squared(q, self.centre)[0]
        first, count, leaf = self.first.tolist(), self.count.tolist(), self.leaf.tolist()
        out = []
        for row in near.tolist():
            heap, got = [(0.0, 0)], []
            while heap and len(got) < most:
                _, node = heapq.heappop(heap)
                while leaf[node] < 0:  # down to a leaf; what is passed by waits in the queue
                    kids = range(first[node], first[node] + count[node])
                    best = min(kids, key=row.__getitem__)
                    for kid in kids:
                        if kid != best:
                            heapq.heappush(heap, (row[kid], kid))
                    node = best
                got.append(leaf[node])
            out.append(got)
        return out


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | tuple[None, None]:
    """(centres, labels) with no empty cluster; (None, None) where the rows cannot be told apart."""
    centres = x[[int(rng.integers(len(x)))]]
    gap = squared(x, centres)[0].min(1).clip(0)
    for _ in range(k - 1):  # spread out: the next centre by squared distance from those before
        if not gap.sum() > 0 or not np.isfinite(gap.sum()):
            break
        centres = np.vstack([centres, x[int(rng.choice(len(x), p=gap / gap.sum()))]])
        gap = np.minimum(gap, squared(x, centres[-1:])[0][:, 0].clip(0))
    for _ in range(ROUNDS):
        label = squared(x, centres)[0].argmin(1)
        there, label = np.unique(label, return_inverse=True)
        centres = np.stack([x[label == c].mean(0) for c in range(len(there))])
    label = squared(x, centres)[0].argmin(1)
    there, label = np.unique(label, return_inverse=True)
    return (centres[there], label) if len(there) > 1 else (None, None)


def _order(*first: str) -> list[Column]:
    return [*[F.col(c) for c in first], F.col("id").isNull(), F.col("id")]


@dataclass
class Index:
    """All rows by leaf (as a table), the tree, and the number of leaves that a query visits."""

    rows: DataFrame
    tree: Tree
    dim: int
    k: int
    visits: int = 1
    recall: float = 1.0


def build(vectors: DataFrame, k: int = NEIGHBOURS, id_col: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, calibration: int = CALIBRATION, target: float = TARGET) -> Index:
    """The calibrated index of all rows of ``vectors``."""
    own = valid(vectors, id_col, vector, zero=False)
    dim = dimension(own)
    own = own.filter(F.size("v") == dim).withColumns({"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit(1), "v")})
    # of equal vectors the k + 1 least ids; the limit works before rows are shuffled too
    w = Window.partitionBy("k1", "k2").orderBy(*_order())
    kept = written(own.withColumn("copy", F.row_number().over(w)).filter(F.col("copy") <= k + 1), "vectors")
    classes = kept.filter("copy = 1").count()
    tree = Tree.fit(_hashed(kept, classes, sample, "k1", dim)) if classes else Tree.fit(np.zeros((0, max(dim, 1))))
    spread = kept.sparkSession.sparkContext.broadcast(tree)

    def down(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            yield b.append_column("leaf", pa.array(spread.value.assign(matrix(b.column("v"), dim)), pa.int32()))

    kind = kept.schema["id"].dataType.simpleString()
    leaves = written(kept.mapInArrow(down, f"id {kind}, v array<double>, k1 long, k2 long, copy int, leaf int"), "leaves")
    spread.destroy()
    index = Index(leaves, tree, dim, k)
    if classes:
        index.visits, index.recall = calibrate(index, _hashed(kept, classes, calibration, "k2", dim), target)
    return index


def _hashed(kept: DataFrame, classes: int, most: int, key: str, dim: int) -> np.ndarray:
    """About ``most`` distinct vectors, those with the least hashes (never more than twice as many), in order of their hashes."""
    share = min(1.0, most / classes)
    limit = 2**62 if share == 1 else int(share * 2**62)
    part = kept.filter("copy = 1").filter(F.shiftrightunsigned(key, 2) <= F.lit(limit)).select("k1", "k2", "v")
    got = part.limit(2 * most).toArrow()
    order = np.lexsort((got["k2"].to_numpy(), got["k1"].to_numpy()))
    return matrix(got["v"].combine_chunks(), dim)[order] if len(got) else np.zeros((0, dim))


def calibrate(index: Index, q: np.ndarray, target: float) -> tuple[int, float]:
    """(visits, share found): the least widening at which the queries ``q``, rows of the table, find the
    target share of their true neighbours. All rows are compared with them; each task sends k + 1 of a query."""
    state, k, dim = index.rows.sparkSession.sparkContext.broadcast(q), index.k, index.dim

    def compare(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for b in frames:
            x, leaf = matrix(b.column("v"), dim), b.column("leaf").to_numpy()
            i, at, d = nearest(state.value, x, np.arange(len(x)), k + 1)
            new = np.column_stack([i, d, leaf[at]])
            best = new if best is None else np.concatenate([best, new])
            best = best[np.lexsort((best[:, 1], best[:, 0]))]
            place = np.arange(len(best)) - np.searchsorted(best[:, 0], best[:, 0])
            best = best[place <= k]
        if best is not None and len(best):
            yield pa.RecordBatch.from_arrays([pa.array(best[:, 0].astype(np.int32)), pa.array(best[:, 1]), pa.array(best[:, 2].astype(np.int32))], ["q", "d", "leaf"])

    w = Window.partitionBy("q").orderBy("d", "leaf")
    got = index.rows.select("v", "leaf").mapInArrow(compare, "q int, d double, leaf int").withColumn("r", F.row_number().over(w)).filter(F.col("r").between(2, k + 1)).select("q", "leaf").toPandas()
    state.destroy()
    order = [{leaf: n for n, leaf in enumerate(v)} for v in index.tree.visits(q, index.tree.leaves)]
    at = np.array([order[i][leaf] for i, leaf in zip(got["q"], got["leaf"], strict=True)], int)
    visits = 1
    while len(at) and visits < index.tree.leaves and (at < visits).mean() < target:
        visits = min(index.tree.leaves, max(visits + 1, int(visits * WIDEN)))
    return visits, float((at < visits).mean()) if len(at) else 1.0


def _blocks(rows: DataFrame, limit: int, columns: list[str]) -> DataFrame:
    """(leaf, ...): the rows of each leaf in blocks of about ``limit``, their columns as arrays. No block
    depends on how many rows its leaf has."""
    size = rows.groupBy("leaf").agg(F.ceil(F.count("*") / F.lit(limit)).alias("blocks"))
    dealt = rows.join(F.broadcast(size), "leaf").withColumn("block", F.pmod(F.xxhash64("k1", "k2", "copy"), F.col("blocks")))
    return dealt.groupBy("leaf", "block").agg(*[F.collect_list(c).alias(c) for c in columns])


def search(index: Index, queries: DataFrame) -> DataFrame:
    """(q1, q2, found): for each distinct vector of ``queries`` (k1, k2, v) the k + 1 nearest rows that
    its visits find, as an array of (score, none, id, k1, k2) in order."""
    tree = index.rows.sparkSession.sparkContext.broadcast(index.tree)
    visits, k, dim = index.visits, index.k, index.dim

    def walk(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            got = tree.value.visits(matrix(b.column("v"), dim), visits)
            at, leaf = np.repeat(np.arange(len(got)), [len(g) for g in got]), np.array([n for g in got for n in g], np.int32)
            for i in range(0, len(at), 4096):
                yield b.take(pa.array(at[i : i + 4096])).append_column("leaf", pa.array(leaf[i : i + 4096]))

    own = queries.select("k1", "k2", "v").dropDuplicates(["k1", "k2"])
    asked = own.mapInArrow(walk, "k1 long, k2 long, v array<double>, leaf int").withColumn("copy", F.lit(1))
    asked = _blocks(asked, BLOCK_QUERIES, ["k1", "k2", "v"]).select("leaf", F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("v").alias("q"))
    rows = index.rows.withColumn("row", F.struct("id", "k1", "k2"))
    held = _blocks(rows, BLOCK_ROWS, ["row", "v"])
    kind = index.rows.schema["id"].dataType.simpleString()

    def compare(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            for i in range(len(b)):
                q1, q2, q, row, v = (b.column(c)[i].values for c in ("q1", "q2", "q", "row", "v"))
                ids = row.field("id")
                rank = np.empty(len(ids), int)
                rank[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
                x = matrix(v, dim)
                a, at, d = nearest(matrix(q, dim), x, rank, k + 1)
                a, at = pa.array(a), pa.array(at)
                yield pa.RecordBatch.from_arrays([q1.take(a), q2.take(a), pa.array(d), ids.take(at), row.field("k1").take(at), row.field("k2").take(at)], ["q1", "q2", "score", "id", "k1", "k2"])

    # vectors never go through the driver: without the hint a side is broadcast when it is small as compressed
    pairs = asked.join(held.hint("merge"), "leaf").select("q1", "q2", "q", "row", "v").mapInArrow(compare, f"q1 long, q2 long, score double, id {kind}, k1 long, k2 long")
    w = Window.partitionBy("q1", "q2").orderBy(*_order("score"), "k1", "k2")
    best = pairs.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k + 1)
    return best.groupBy("q1", "q2").agg(F.array_sort(F.collect_list(F.struct("score", F.col("id").isNull().alias("none"), "id", "k1", "k2"))).alias("found"))


def neighbours(index: Index, queries: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows of each row of ``queries``, itself part of the table."""
    own = valid(queries, id_col, vector, zero=False).filter((F.size("v") == index.dim) & F.col("id").isNotNull())
    own = own.withColumns({"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit(1), "v")})
    found = search(index, own)
    ask = own.select(F.col("id").alias("query_id"), F.col("k1").alias("q1"), F.col("k2").alias("q2"))
    # itself: one row of its class with its id; if it isn't among them, k of the k + 1 are enough
    me = F.expr("array_position(transform(found, f -> f.id = query_id and f.k1 = q1 and f.k2 = q2), true)").cast("int")
    rest = F.when(F.col("me") > 0, F.concat(F.slice("found", 1, F.greatest(F.col("me") - 1, F.lit(0))), F.slice("found", F.col("me") + 1, F.lit(index.k + 1)))).otherwise(F.col("found"))
    d = ask.join(found.hint("merge"), ["q1", "q2"]).withColumn("me", me).select("query_id", F.posexplode(F.slice(rest, 1, index.k)).alias("place", "f"))
    return d.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("f.id").alias("vec_id"), F.col("f.score").alias("score"))


def op12_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours(build(vectors), vectors.filter("vec_id % 100 = 0"))
