"""Lexical and vector ranking for a batch of queries, and their fusion; every ranking has a total order."""

from __future__ import annotations

import math
from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold, tokens
from ..streaming.collect import written

K1, B, RRF_K, CANDIDATES = 1.5, 0.75, 60, 60
BLOCK_ROWS = 4096


def plain_tokens(text: Column) -> Column:
    """The tokens of the plain full-text index: folded words that keep their hyphens and slashes."""
    return F.regexp_extract_all(fold(text), F.lit("[a-z0-9/-]+"), F.lit(0))


def postings(chunks: DataFrame, text: str = "text", tokenize: Callable[[Column], Column] = tokens) -> DataFrame:
    """(token, i, tf) of chunks (i, text)."""
    return chunks.select("i", F.explode(tokenize(F.col(text))).alias("token")).groupBy("token", "i").agg(F.count(F.lit(1)).alias("tf"))


def tokenized(chunks: DataFrame, tokenize: Callable[[Column], Column] = tokens) -> DataFrame:
    """(i, t, len) of chunks (i, text), written to the shared folder: each text is tokenized once, however many statistics are taken from it."""
    return written(chunks.select("i", tokenize(F.col("text")).alias("t")).withColumn("len", F.size("t")), "tokens")


def bm25(chunks: DataFrame, queries: DataFrame, allowed: DataFrame | None = None, k1: float = K1, b: float = B, tokenize: Callable[[Column], Column] = tokens) -> DataFrame:
    """(q, i, score) for queries (q, text). idf and the average length are those of all chunks, also where `allowed` (i) restricts the result; a repeated query token counts each time.

    chunks are (i, text), or (i, t, len) as tokenized() gives them. Only postings of tokens that a query has leave their task.
    """
    toks = chunks if "t" in chunks.columns else tokenized(chunks, tokenize)
    stats = toks.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg")).first()
    n, avg = F.lit(stats.n), F.lit(float(stats.avg or 0))
    wanted = queries.select("q", F.explode(tokenize(F.col("text"))).alias("token")).groupBy("q", "token").agg(F.count(F.lit(1)).alias("qtf"))
    post = toks.select("i", "len", F.explode("t").alias("token")).join(wanted.select("token").distinct(), "token", "left_semi")
    post = post.groupBy("token", "i", "len").agg(F.count(F.lit(1)).alias("tf"))
    df = post.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    hits = wanted.join(df, "token").join(post, "token")
    if allowed is not None:
        hits = hits.join(allowed.select("i").distinct(), "i", "left_semi")
    idf = F.log(1 + (n - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / avg))
    return hits.groupBy("q", "i").agg(F.round(F.sum(F.col("qtf") * part), 6).alias("score"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine(vectors: DataFrame, queries: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(q, i, score) of given pairs (q, i) of queries (q, v) and vectors (i, v), each pair once; without pairs of all of them, in blocks."""
    if pairs is None:
        return _blocks(vectors, queries, None)
    unit = lambda v: F.greatest(F.sqrt(dot(v, v)), F.lit(1e-9))
    a = vectors.select("i", "v", unit(F.col("v")).alias("nv"))
    b = queries.select("q", F.col("v").alias("w"), unit(F.col("v")).alias("nw"))
    met = pairs.select("q", "i").distinct().join(b, "q").join(a, "i")
    return met.select("q", "i", F.round(dot(F.col("v"), F.col("w")) / (F.col("nv") * F.col("nw")), 6).alias("score"))


def top(scores: DataFrame, k: int) -> DataFrame:
    """(q, i, score, rank): the k best of each query, ties to the smaller i."""
    best = Window.partitionBy("q").orderBy(F.desc("score"), "i")
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A list column of one length as a matrix; other lists raise an error."""
    flat = pa.concat_arrays([c.flatten() for c in column.chunks])
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _nearest(k: int | None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def search(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: dict[str, list] = {"q": [], "i": [], "score": []}
        if not rows.num_rows or not asked.num_rows:
            return pa.table(out, SCORES)
        v, w, ids = _matrix(rows["v"]), _matrix(asked["v"]), rows["i"].to_numpy()
        total = lambda x: np.add.accumulate(x, axis=1)[:, -1]  # in the order of dot()
        nv, nw = (np.maximum(np.sqrt(total(x * x)), 1e-9) for x in (v, w))
        for j, q in enumerate(asked["q"].to_pylist()):
            near = v @ w[j] / (nv * nw[j])
            # scores that round to the kth or better; 2e-6 is more than a rounding step
            c = np.flatnonzero(near >= np.partition(near, -k)[-k] - 2e-6) if k and len(near) > k else np.arange(len(near))
            kinds, at = np.unique(total(v[c] * w[j]) / (nv[c] * nw[j]), return_inverse=True)
            score = np.array([float(Decimal(repr(x)).quantize(Decimal("1e-6"), ROUND_HALF_UP)) for x in kinds.tolist()])[at]
            best = np.lexsort((ids[c], -score))[:k]
            out["q"] += [q] * len(best)
            out["i"] += ids[c][best].tolist()
            out["score"] += score[best].tolist()
        return pa.table(out, SCORES)

    return search


SCORES = pa.schema([("q", pa.int64()), ("i", pa.int64()), ("score", pa.float64())])


def _blocks(vectors: DataFrame, queries: DataFrame, k: int | None, rows: int = BLOCK_ROWS) -> DataFrame:
    parts = lambda df: max(1, math.ceil(df.count() / rows))
    shards, blocks = parts(vectors), parts(queries)
    deal = lambda c, n, seed: F.pmod(F.xxhash64(F.lit(seed), F.col(c)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = vectors.select(F.col("i").cast("long").alias("i"), "v", deal("i", shards, 1).alias("shard")).withColumn("block", each(blocks))
    b = queries.select(F.col("q").cast("long").alias("q"), F.col("v").alias("v"), deal("q", blocks, 2).alias("block")).withColumn("shard", each(shards))
    return a.groupBy("shard", "block").cogroup(b.groupBy("shard", "block")).applyInArrow(_nearest(k), "q long, i long, score double")


def knn(vectors: DataFrame, queries: DataFrame, k: int, rows: int = BLOCK_ROWS) -> DataFrame:
    """top(cosine(vectors, queries), k) for any number of queries: a task holds one block of vectors and one of queries, and returns k rows a query at most."""
    return top(_blocks(vectors, queries, k, rows), k)


def fuse(dense: DataFrame, lexical: DataFrame, k: int, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (q, i, rank); ties: dense rank, then lexical rank, then i."""
    a, b = dense.select("q", "i", F.col("rank").alias("rank_dense")), lexical.select("q", "i", F.col("rank").alias("rank_lex"))
    both = a.join(b, ["q", "i"], "full_outer")
    term = lambda c: F.coalesce(F.lit(1.0) / (rrf_k + F.col(c)), F.lit(0.0))
    both = both.withColumn("total", F.round(term("rank_dense") + term("rank_lex"), 9))
    order = Window.partitionBy("q").orderBy(F.desc("total"), F.coalesce("rank_dense", F.lit(10**6)), F.coalesce("rank_lex", F.lit(10**6)), "i")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ir_metrics(first_rank: DataFrame, by: list[str]) -> DataFrame:
    """n, R@1/5/8, MRR@10, nDCG@10 and not found of rows with a nullable `rank` of the one relevant result."""
    r = F.col("rank")
    recall = lambda k: F.round(F.avg(F.when(r <= k, 1.0).otherwise(0.0)), 6).alias(f"r{k}")
    ten = lambda x: F.round(F.avg(F.when(r <= 10, x).otherwise(0.0)), 6)
    return first_rank.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), recall(1), recall(5), recall(8), ten(1 / r).alias("mrr10"), ten(1 / F.log2(1 + r)).alias("ndcg10"), F.count_if(r.isNull()).alias("not_found"))
