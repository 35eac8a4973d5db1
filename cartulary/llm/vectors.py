"""What the vector searches share: valid vectors, and queries against all rows in blocks.

Rows are dealt into shards by a hash, queries into blocks; a task holds one shard and one block, so its memory is bounded whatever the table. Each
pair returns k rows a query at most, which are merged by query.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import write_table

SHARD_ROWS, BLOCK_ROWS = 8192, 4096


def finite(vector: str) -> Column:
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True))


def vectors(table: DataFrame, id_col: str, vector: str, zeros: bool) -> DataFrame:
    """(id, v): one row for each non-null id that has a vector without null or non-finite components (and, but for `zeros`, not all zero); of several rows of an id, the greatest vector."""
    ok = finite(vector)
    if not zeros:
        ok = ok & F.exists(vector, lambda x: x != 0)
    return table.where(ok & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(vector).alias("v"))


def shards_of(n: int, rows: int) -> int:
    return max(1, math.ceil(n / rows))


def part_of(id_col: str, parts: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(parts)).cast("int")


def stack(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """A matrix of a list column; shorter vectors are padded with zeros."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    n, values = np.asarray(lists.value_lengths()), lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(n), dim), np.float64)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)] = values
    return out


def in_blocks(index: DataFrame, queries: DataFrame, shards: int, blocks: int, search: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """search(rows of a shard, queries of a block) for each pair; index has `shard`, queries have `block` and the array `to` of shards to search."""
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.withColumn("shard", F.explode("to")).drop("to")
    right = right.toDF(*right.columns)
    return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(search, schema)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of (query_id, vec_id, score) for each query: highest score first, ties to the smaller vec_id."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def prepared(table: DataFrame, id_col: str, vector: str, every: int, zeros: bool, shard_rows: int, block_rows: int) -> tuple[DataFrame, DataFrame, int, int, int]:
    """(index, queries, shards, blocks, dim), the rows written as tables."""
    all_rows = write_table(vectors(table, id_col, vector, zeros), "vectors")
    n, dim = all_rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    asked = F.pmod(F.col("id"), F.lit(every)) == 0
    shards, blocks = shards_of(n, shard_rows), shards_of(math.ceil(n / every), block_rows)
    index = all_rows.withColumn("shard", part_of("id", shards, 1))
    again = table.sparkSession.read.schema(all_rows.schema).parquet(all_rows._cartulary_path)  # columns of its own
    queries = again.where(asked).withColumn("block", part_of("id", blocks, 2))
    return index, queries, shards, blocks, dim or 0
