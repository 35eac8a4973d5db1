"""Approximate nearest neighbours by a permutation index.

A vector is represented by the ordered list of its nearest pivots, a prefix of its permutation. Each shard posts its vectors in one inverted file a
pivot, as (row, rank) in the order of the rank. A query opens only the files of its own nearest pivots: rows that stand near the front of one of them
are candidates, and what the files hold of a row gives its footrule distance, where a pivot that is in one of the two lists only counts as if it stood
right behind the other list. The nearest candidates by footrule are reranked by the exact measure on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_table
from .vectors import BLOCK_ROWS, SHARD_ROWS, in_blocks, prepared, ranked, stack

K = 20
EVERY = 20
#: The pivots: this many vectors, the first by a hash of the id (all, if fewer). The only part of the index fitted on a sample.
PIVOTS = 1024
#: Nearest pivots that represent a vector, and ranks up to which a row of a query's file is a candidate.
PREFIX, FRONT = 64, 16
#: Of each shard the share of rows that is reranked.
SHARE = 0.15


def prefixes(x: np.ndarray, pivots: np.ndarray, m: int) -> np.ndarray:
    """The numbers of each vector's m nearest pivots (largest inner product) in order, ties to the earlier pivot."""
    m = min(m, len(pivots))
    out = np.empty((len(x), m), np.int16)
    for at in range(0, len(x), 1024):
        out[at : at + 1024] = np.argsort(-(x[at : at + 1024] @ pivots.T), axis=1, kind="stable")[:, :m]
    return out


class Files:
    """The inverted files of a shard: for each pivot its rows and their ranks, nearest first."""

    def __init__(self, lists: np.ndarray, pivots: int) -> None:
        self.n, self.m = lists.shape
        order = np.lexsort((np.tile(np.arange(self.m), self.n), lists.ravel()))  # by pivot, then rank
        self.rows, self.ranks = (order // self.m).astype(np.int64), (order % self.m).astype(np.int64)
        self.starts = np.searchsorted(lists.ravel()[order], np.arange(pivots + 1))

    def near(self, query: np.ndarray, front: int) -> tuple[np.ndarray, np.ndarray]:
        """(candidates, their footrule distances to the query's list)."""
        spans = [np.arange(self.starts[p], self.starts[p + 1]) for p in query.tolist()]
        at = np.concatenate(spans)
        own = np.repeat(np.arange(len(query)), [len(s) for s in spans])
        rows, ranks = self.rows[at], self.ranks[at]
        # a pivot at i and r adds |i - r|; one in a single list at i adds m - i: against no shared pivot, sharing saves 2 * (m - max(i, r))
        saved = np.bincount(rows, 2.0 * (self.m - np.maximum(own, ranks)), self.n)
        hit = np.zeros(self.n, bool)
        hit[rows[ranks < front]] = True
        found = np.flatnonzero(hit)
        return found, self.m * (self.m + 1) - saved[found]


def search(table: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = K, every: int = EVERY, pivots: int = PIVOTS, prefix: int = PREFIX, front: int = FRONT, share: float = SHARE, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row whose id is divisible by `every`, by inner product in double precision.

    A query gets fewer than k rows where its files hold fewer candidates in the shards. Vectors that are null, empty, zero or hold null or non-finite
    components take no part, nor do rows without an id; rows that repeat an id count once, with the greatest vector; shorter vectors are padded with
    zeros. Equal vectors have equal lists; ties go to the smaller id, also at the end of the share. Extra columns, also of the result's names, are
    ignored; an empty table gives an empty result.
    """
    if not 0 < pivots < 1 << 15:
        raise ValueError("pivots must be from 1 to 32767")
    index, queries, shards, blocks, dim = prepared(table, id_col, vector, every, False, shard_rows, block_rows)
    sample = index.orderBy(F.xxhash64(F.lit(3), "id"), "id").limit(pivots).select("v").collect()
    piv = np.zeros((len(sample), dim))
    for i, r in enumerate(sample):
        piv[i, : len(r.v)] = r.v
    piv /= np.maximum(np.linalg.norm(piv, axis=1, keepdims=True), 1e-300)
    m = min(prefix, len(piv))

    def represent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = prefixes(stack(pa.chunked_array([b.column(1)]), dim), piv, m)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([row.tobytes() for row in lists], pa.binary())], names=["id", "v", "list"])

    posted = write_table(index.select("id", "v").mapInArrow(represent, f"id long, v {dict(index.dtypes)['v']}, list binary"), "posted")
    again = table.sparkSession.read.schema(posted.schema).parquet(posted._cartulary_path)  # columns of its own
    lists = lambda column: np.frombuffer(b"".join(column.to_pylist()), np.int16).reshape(-1, m)

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        ids, qids = rows["id"].to_numpy(), asked["id"].to_numpy()
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(ids) and len(qids):
            by_id = np.argsort(ids)
            ids, x, q = ids[by_id], stack(rows["v"], dim)[by_id], stack(asked["v"], dim)
            files, own = Files(lists(rows["list"])[by_id], len(piv)), lists(asked["list"])
            take = int(np.ceil(share * len(ids))) + 1
            for j in range(len(qids)):
                near, far = files.near(own[j], front)
                if take < len(near):
                    key = far.astype(np.int64) * len(ids) + near  # ties to the smaller id
                    near = np.sort(near[np.argpartition(key, take - 1)[:take]])
                near = near[ids[near] != qids[j]]
                score = np.einsum("ij,j->i", x[near], q[j])
                best = np.lexsort((ids[near], -score))[:k]
                found.append((np.full(len(best), qids[j]), ids[near][best], score[best]))
        cols = [np.concatenate(c) for c in zip(*found)] if found else [[], [], []]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("query_id", "vec_id", "score"), cols, (pa.int64(), pa.int64(), pa.float64()))})

    dealt = posted.withColumn("shard", F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(shards)).cast("int"))
    to = F.sequence(F.lit(0), F.lit(shards - 1))
    asked = again.where(F.pmod(F.col("id"), F.lit(every)) == 0).withColumn("block", F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(blocks)).cast("int")).withColumn("to", to)
    return ranked(in_blocks(dealt, asked, shards, blocks, run, "query_id long, vec_id long, score double"), k)
