"""An approximate vector index on disk: k-means cells, of which a search opens some.

The cells' centres are fitted on a bounded sample; every vector is put into the cell of its nearest centre. Files are parted by the cell's number, and
sorted by it, so a search reads what it opens. With as many cells as the root of the rows, and a twentieth of them opened, the work of a query grows
with the root of the table; how many cells a recall asks for depends on how far the vectors form clusters.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .retrieval import BLOCK_ROWS, _matrix, _nearest, top

#: Vectors that the centres are fitted on, the first by a hash of the id.
SAMPLE_ROWS, ROUNDS = 32_768, 12
PARTS = 64


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def centres(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 1) -> np.ndarray:
    """Spherical k-means; an empty cell takes the vector that is farthest from its centre."""
    x = _unit(x)
    c = x[np.sort(np.random.default_rng(seed).permutation(len(x))[:k])]
    for _ in range(rounds):
        near = x @ c.T
        of = near.argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, of, x)
        empty = np.flatnonzero(np.bincount(of, minlength=len(c)) == 0)
        sums[empty] = x[np.argsort(near.max(1), kind="stable")[: len(empty)]]
        c = _unit(sums)
    return c


def build(vectors: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE_ROWS) -> int:
    """Writes the index of (i, v); the number of its cells, by default the root of the rows. Null vectors are left out."""
    spark, v = vectors.sparkSession, vectors.where("v is not null").select(F.col("i").cast("long").alias("i"), "v")
    cells = cells or max(1, round(math.sqrt(v.count())))
    rows = v.orderBy(F.xxhash64(F.lit(5), "i"), "i").limit(sample).select("v").toArrow()
    c = centres(_matrix(rows["v"]), cells) if rows.num_rows else np.zeros((0, 0))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                of = (_unit(_matrix(pa.chunked_array([b.column(1)]))) @ c.T).argmax(1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(of, pa.int32())], names=["i", "v", "cell"])

    put = v.mapInArrow(assign, f"i long, v {dict(v.dtypes)['v']}, cell int").withColumn("part", F.col("cell") % PARTS)
    put.sortWithinPartitions("part", "cell", "i").write.partitionBy("part").parquet(f"{path}/rows")
    spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(c)], "cell int, centre array<double>").write.parquet(f"{path}/centres")  # as many as cells
    return len(c)


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int | None = None, rows: int = BLOCK_ROWS) -> DataFrame:
    """(q, i, score, rank): the k best by cosine in the `probes` nearest cells of each query (q, v), by default a twentieth of the cells.

    Large cells, and cells that many queries open, are dealt in blocks; no task holds a whole cell.
    """
    held = sorted(spark.read.parquet(f"{path}/centres").collect())  # the root of the rows
    c = np.array([r.centre for r in held]).reshape(len(held), -1)
    probes = min(len(c), probes or max(1, len(c) // 20))

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and probes:
                near = np.argsort(-(_unit(_matrix(pa.chunked_array([b.column(1)]))) @ c.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1, dtype=np.int32) * probes), pa.array(near.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns, lists], names=["q", "v", "cells"])

    asked = queries.select(F.col("q").cast("long").alias("q"), F.col("v").alias("v"))
    asked = asked.mapInArrow(opened, f"q long, v {dict(asked.dtypes)['v']}, cells array<int>")
    index = spark.read.parquet(f"{path}/rows")
    split = lambda n: F.ceil(F.col(n) / F.lit(rows)).cast("int")
    sizes = index.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).join(asked.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("m")), "cell")
    sizes = sizes.select("cell", split("n").alias("chunks"), split("m").alias("blocks"))
    deal = lambda col, n, seed: F.pmod(F.xxhash64(F.lit(seed), F.col(col)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = index.select("i", "v", "cell").join(F.broadcast(sizes), "cell").select("i", "v", "cell", deal("i", "chunks", 1).alias("chunk"), each("blocks").alias("block"))  # one row a cell
    b = asked.select("q", "v", F.explode("cells").alias("cell")).join(F.broadcast(sizes), "cell").select("q", "v", "cell", deal("q", "blocks", 2).alias("block"), each("chunks").alias("chunk"))
    by = ["cell", "chunk", "block"]
    return top(a.groupBy(*by).cogroup(b.groupBy(*by)).applyInArrow(_nearest(k), "q long, i long, score double"), k)
