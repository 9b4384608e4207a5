"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first.

The tree is fitted on the driver to a bounded sample and broadcast; its size does not depend on the input. Every row
is put into the leaf whose centres are nearest on the way down. A query walks the tree with a priority queue of
branches, nearest centre first, and visits as many leaves as calibration found necessary: for queries from outside the
sample the true neighbours are found by a scan of all rows, and visits widen until their leaves cover the wanted recall.
Leaves, and the queries that visit one, are dealt in blocks of bounded size, so a leaf full of copies of one vector, or
one that very many queries visit, is searched by many tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize

SAMPLE_ROWS = 16_384
CALIBRATION_QUERIES = 128
BRANCHES = 8
#: Rows of the sample that a leaf should have; rows of one block of a leaf; and queries that one task meets with a block.
LEAF_SAMPLE = 64
BLOCK_ROWS = 4096
BLOCK_QUERIES = 4096


class Tree:
    """Nodes as arrays: centres, and for each node its children's range (empty for leaves) and its leaf number."""

    def fit(self, x: np.ndarray, seed: int = 7) -> Tree:
        draw = np.random.default_rng(seed)
        self.centres, self.children, self.leaf, self.leaves = [x.mean(0)], [(0, 0)], [-1], 0
        todo = [(0, x)]
        while todo:
            node, rows = todo.pop()
            parts = self._split(rows, draw) if len(rows) > LEAF_SAMPLE else []
            if len(parts) < 2:
                self.leaf[node] = self.leaves
                self.leaves += 1
                continue
            first = len(self.centres)
            self.children[node] = (first, first + len(parts))
            for k, part in enumerate(parts):
                self.centres.append(part.mean(0))
                self.children.append((0, 0))
                self.leaf.append(-1)
                todo.append((first + k, part))
        self.centres, self.leaf = np.array(self.centres), np.array(self.leaf)
        return self

    @staticmethod
    def _split(rows: np.ndarray, draw: np.random.Generator) -> list[np.ndarray]:
        distinct = np.unique(rows, axis=0)
        centres = distinct[draw.choice(len(distinct), min(BRANCHES, len(distinct)), replace=False)]
        for _ in range(8):
            near = Tree._nearest(rows, centres)
            centres = np.array([rows[near == k].mean(0) if (near == k).any() else centres[k] for k in range(len(centres))])
        near = Tree._nearest(rows, centres)
        return [rows[near == k] for k in range(len(centres)) if (near == k).any()]

    @staticmethod
    def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return ((centres**2).sum(1) - 2 * (x @ centres.T)).argmin(1)

    def assign(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        open_rows = np.arange(len(x))
        while len(open_rows):
            for parent in np.unique(node[open_rows]):
                first, last = self.children[parent]
                if first < last:
                    mine = open_rows[node[open_rows] == parent]
                    node[mine] = first + self._nearest(x[mine], self.centres[first:last])
            open_rows = open_rows[self.leaf[node[open_rows]] < 0]
        return self.leaf[node]

    def best_bins(self, q: np.ndarray, visits: int) -> list[int]:
        """The first ``visits`` leaves from a queue of branches by distance to their centres."""
        queue, found = [(0.0, 0)], []
        while queue and len(found) < visits:
            _, node = heapq.heappop(queue)
            first, last = self.children[node]
            if first == last:
                found.append(int(self.leaf[node]))
                continue
            d = ((self.centres[first:last] - q) ** 2).sum(1)
            for k in range(last - first):
                heapq.heappush(queue, (float(d[k]), first + k))
        return found


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    return vectors.select(F.col(id_col).alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _best(ids: np.ndarray, x: np.ndarray, q_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k rows nearest to q but the one with its id, ties to the smaller id."""
    d = x - q
    distance = np.sqrt(np.einsum("ij,ij->i", d, d))
    distance[ids == q_id] = np.inf
    if len(ids) > 4 * k:
        some = np.flatnonzero(distance <= np.partition(distance, k)[k])
        order = some[np.lexsort((ids[some], distance[some]))][:k]
    else:
        order = np.lexsort((ids, distance))[:k]
    order = order[ids[order] != q_id]
    return ids[order], distance[order]


def _calibrate(rows: DataFrame, tree: Tree, queries: list[tuple[int, np.ndarray]], k: int, recall: float) -> int:
    """Leaf visits at which the true neighbours of the sampled queries, found by scanning all rows, are reached."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple] = {}
        for batch in batches:
            ids, x = batch.column("id").to_numpy(zero_copy_only=False), _matrix(batch.column("v"))
            leaf = tree.assign(x)
            for n, (q_id, q) in enumerate(queries):
                found, distance = _best(ids, x, q_id, q, k)
                leaves = leaf[np.array([np.flatnonzero(ids == f)[0] for f in found], int)] if len(found) else np.zeros(0, int)
                if n in kept:
                    found, distance, leaves = (np.concatenate(p) for p in zip(kept[n], (found, distance, leaves), strict=True))
                order = np.lexsort((found, distance))[:k]
                kept[n] = (found[order], distance[order], leaves[order])
        for n, (found, distance, leaves) in kept.items():
            m = len(found)
            yield pa.RecordBatch.from_arrays([pa.array([n] * m, pa.int32()), pa.array(found, pa.int64()), pa.array(distance, pa.float64()), pa.array(leaves, pa.int64())], ["n", "id", "distance", "leaf"])

    near = rows.mapInArrow(scan, "n int, id long, distance double, leaf long")
    ranked = near.groupBy("n").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "id", "leaf"))), 1, k).alias("best")).collect()
    needed = []
    for r in ranked:
        place = {leaf: i for i, leaf in enumerate(tree.best_bins(queries[r["n"]][1], tree.leaves))}
        needed += [place[b["leaf"]] + 1 for b in r["best"]]
    if not needed:
        return tree.leaves
    return int(np.sort(needed)[min(len(needed) - 1, int(np.ceil(recall * len(needed))))])


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = 0.97, sample_rows: int = SAMPLE_ROWS,
    block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """``query_id, rank, <id_col>, score``: for each query row the nearest rows of ``vectors`` that the search found.

    The score is the Euclidean distance in double precision on the given vectors; ties go to the smaller id, and a
    query is never its own neighbour. Vectors that are null, all zero, of another length than the first sampled one,
    or that hold null or non-finite components take no part, nor do rows without an id. Rows repeated in full are
    candidates once each. With fewer than k candidates all are returned; an empty table gives an empty result.
    The index is fitted to about ``sample_rows`` rows chosen by a hash of the id; every row is indexed.
    """
    spark = vectors.sparkSession
    rows = materialize(_usable(vectors, id_col, vector_col), "vectors")
    empty = spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    total = rows.count()
    if not total:
        return empty
    limit = int(min(1.0, sample_rows / total) * (1 << 30))
    slot = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    sample = rows.where(slot < limit).orderBy("id").collect() if total > 1 else rows.collect()
    if not sample:
        sample = rows.limit(1).collect()
    width = len(sample[0]["v"])
    rows = rows.where(F.size("v") == width)
    sample = [r for r in sample if len(r["v"]) == width]
    x = np.array([r["v"] for r in sample])
    tree = Tree().fit(x)
    # rows that the tree was not fitted to, and rows of the sample where there are too few others
    asking = rows.where(slot >= limit).orderBy(slot, "id").limit(CALIBRATION_QUERIES).collect()
    if len(asking) < CALIBRATION_QUERIES:
        asking += sample[:: max(1, len(sample) // (CALIBRATION_QUERIES - len(asking)))]
    visits = _calibrate(rows, tree, [(r["id"], np.array(r["v"])) for r in asking], k, recall)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tree.assign(_matrix(batch.column("v"))), pa.int64())], ["id", "v", "leaf"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = [tree.best_bins(q, visits) for q in _matrix(batch.column("v"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves, pa.list_(pa.int64()))], ["id", "v", "leaves"])

    indexed = materialize(rows.mapInArrow(index, "id long, v array<double>, leaf long"), "index")
    blocks = indexed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("blocks"))
    asked = _usable(queries, id_col, vector_col).where(F.size("v") == width).mapInArrow(walk, "id long, v array<double>, leaves array<long>")
    asked = asked.select("id", "v", F.explode("leaves").alias("leaf"))
    sides = asked.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / block_queries).alias("sides"))
    shape = materialize(blocks.join(sides, "leaf"), "leaf-blocks")  # a leaf that no query visits is not searched
    dealt_to = lambda name, count: F.pmod(F.xxhash64("id", F.lit(name)), F.col(count))
    each = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
    dealt = indexed.join(shape, "leaf").select("leaf", dealt_to("block", "blocks").alias("block"), each("sides").alias("side"), "id", "v")
    parts = asked.join(shape, "leaf").select("leaf", each("blocks").alias("block"), dealt_to("side", "sides").alias("side"), "id", "v")

    def search(key: tuple, candidates: pa.Table, wanted: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if candidates.num_rows and wanted.num_rows:
            ids, found = candidates.column("id").to_numpy(), _matrix(candidates.column("v").combine_chunks())
            for q_id, q in zip(wanted.column("id").to_pylist(), _matrix(wanted.column("v").combine_chunks()), strict=True):
                best, distance = _best(ids, found, q_id, q, k)
                out += [(q_id, int(b), float(d)) for b, d in zip(best, distance, strict=True)]
        return pa.table(dict(zip(("query_id", "id", "score"), (pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ([], [], []), (pa.int64(), pa.int64(), pa.float64()), strict=True)), strict=True)))

    near = dealt.groupBy("leaf", "block", "side").cogroup(parts.groupBy("leaf", "block", "side")).applyInArrow(search, "query_id long, id long, score double")
    best = near.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "id"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.id").alias(id_col), F.col("b.score").alias("score"))
