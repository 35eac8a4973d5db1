"""Exact top-k by inner product with a KD-tree for each shard.

Trees split at the median of the widest dimension and keep tight bounding boxes. A query visits the nodes best first by the largest inner product
that a box can hold, until no box reaches the kth score. The kth score is propagated: each query first searches the shard of its own row, and
the other shards start from that bound.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_table
from .vectors import BLOCK_ROWS, SHARD_ROWS, in_blocks, prepared, ranked, stack

K = 5
EVERY = 50
LEAF = 128
#: The range of a long.
LEAST, MOST = -(2**63), 2**63 - 1
SCHEMA = "query_id long, vec_id long, score long"


class KDTree:
    """Nodes in arrays: bounding boxes (low, high), children (-1 for a leaf), and a leaf's rows [start, stop) in the tree's order."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF) -> None:
        self.order, boxes, self.children, self.span = np.arange(len(x)), [], [], []

        def build(start: int, stop: int) -> int:
            rows = x[self.order[start:stop]]
            node, low, high = len(boxes), rows.min(0), rows.max(0)
            boxes.append((low, high))
            self.children.append((-1, -1))
            self.span.append((start, stop))
            widest = int(np.argmax(high - low))
            if stop - start > leaf and high[widest] > low[widest]:
                middle = (stop - start) // 2
                self.order[start:stop] = self.order[start:stop][np.argpartition(rows[:, widest], middle)]
                self.children[node] = build(start, start + middle), build(start + middle, stop)
            return node

        build(0, len(x))
        self.low, self.high = (np.array(b) for b in zip(*boxes))
        self.points = x[self.order]

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """For each query and node the largest inner product with a point of the node's box."""
        return np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T


def loose_bounds(tree: KDTree, q: np.ndarray) -> np.ndarray:
    """Bounds that rounding cannot make too small, for components of any size."""
    with np.errstate(over="ignore", invalid="ignore"):
        products = np.where(q > 0, q * tree.high, np.where(q < 0, q * tree.low, 0.0))
        bound = products.sum(1) + np.abs(products).sum(1) * 1e-9 + 1
    return np.where(np.isnan(bound), np.inf, bound)


def best_first(tree: KDTree, ids: np.ndarray, q: np.ndarray, bound: np.ndarray, own: int, k: int, kth: float, exact: list[list[int]] | None = None) -> list[tuple[float, int]]:
    """The k best (score, id) with a score of at least kth, ties to the smaller id; ids are in the tree's order. exact: the points as whole numbers."""
    whole = [int(v) for v in q.tolist()] if exact is not None else []
    best: list[tuple[float, int]] = []  # a heap of (score, -id): its first is the kth
    heap = [(-bound[0], 0)]
    while heap and -heap[0][0] >= kth:  # nothing beyond the bound can be among the best
        _, node = heapq.heappop(heap)
        a, b = tree.children[node]
        if a >= 0:
            for c in (a, b):
                if bound[c] >= kth:
                    heapq.heappush(heap, (-bound[c], c))
            continue
        start, stop = tree.span[node]
        if exact is None:
            score = tree.points[start:stop] @ q
            near = np.flatnonzero(score >= kth).tolist()
        else:
            score = [max(LEAST, min(MOST, sum(map(int.__mul__, p, whole)))) for p in exact[start:stop]]
            near = [i for i, v in enumerate(score) if v >= kth]
        for i in near:
            item = (float(score[i]) if exact is None else score[i], -int(ids[start + i]))
            if -item[1] == own:
                continue
            if len(best) < k:
                heapq.heappush(best, item)
            elif item > best[0]:
                heapq.heapreplace(best, item)
            if len(best) == k:
                kth = max(kth, best[0][0])
    return [(s, -i) for s, i in best]


def search(table: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = K, every: int = EVERY, scale: float = 256.0, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, leaf: int = LEAF) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of floor(scale * x) for each row whose id is divisible by `every`.

    Vectors that are null or hold null or non-finite components take no part, nor do rows without an id; zero and empty vectors do. Rows that repeat an
    id count once, with the greatest vector; shorter vectors are padded with zeros. Very large components are exact as well: where a score could pass
    2**53 the boxes are bounded with a margin for rounding and the points are scored with whole numbers; a score beyond a long counts as
    the nearest long. Ties go to the smaller id. Extra columns, also of the result's names, are ignored; an empty table gives an empty result.
    """
    index, queries, shards, blocks, dim = prepared(table, id_col, vector, every, True, shard_rows, block_rows)

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        ids, qids, out = rows["id"].to_numpy(), asked["id"].to_numpy(), []
        if len(ids) and len(qids):
            x, q = np.floor(scale * stack(rows["v"], dim)), np.floor(scale * stack(asked["v"], dim))
            tree = KDTree(x, leaf)
            ids = ids[tree.order]
            # plain doubles are exact where no sum of products can pass 2**53
            with np.errstate(over="ignore", invalid="ignore"):
                sure = np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * max(1, dim) < 2.0**53
            exact = None if sure else [[int(v) for v in row] for row in tree.points.tolist()]
            bounds = tree.bounds(q) if sure else None
            for j, kth in enumerate(asked["kth"].to_pylist()):
                if sure:
                    best = best_first(tree, ids, q[j], bounds[j], int(qids[j]), k, -np.inf if kth is None else kth)
                else:
                    best = best_first(tree, ids, q[j], loose_bounds(tree, q[j]), int(qids[j]), k, -np.inf if kth is None else kth, exact)
                out += [(int(qids[j]), i, int(s)) for s, i in best]
        cols = list(zip(*out)) or [[], [], []]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), cols)})

    own = F.pmod(F.xxhash64(F.lit(1), F.col("id")), F.lit(shards)).cast("int")
    first = in_blocks(index, queries.withColumn("kth", F.lit(None).cast("long")).withColumn("to", F.array(own)), shards, blocks, run, SCHEMA)
    if shards == 1:
        return ranked(first, k)
    first = write_table(first, "first")
    kth = write_table(ranked(first, k).where(F.col("rank") == k).select(F.col("query_id").alias("kq"), F.col("score").alias("kth")), "kth")
    others = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != own)
    rest = queries.join(kth, F.col("id") == F.col("kq"), "left").drop("kq").withColumn("to", others)
    return ranked(first.unionByName(in_blocks(index, rest.select("id", "v", "block", "kth", "to"), shards, blocks, run, SCHEMA)), k)
