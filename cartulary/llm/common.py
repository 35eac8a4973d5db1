"""What the operators of this subpackage share: intermediate tables in the shared folder, and graph components."""

from __future__ import annotations

import atexit
import itertools
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch; texts are long, so Spark's default of 10,000 rows would make batches of many MB.
ARROW_ROWS = 1000

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In local mode only, where it is unset, a temporary folder; elsewhere an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), "cartulary")
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/cartulary/{uuid.uuid4().hex}/{tag}"
    _made.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Deletes on leaving the tables written inside, but those put into the list it gives. Results that are still to be computed must not need the others."""
    first, kept = len(_made), []
    try:
        yield kept
    finally:
        keep = {t._cartulary_path for t in kept}
        gone = [x for x in _made[first:] if x[1] not in keep]
        _made[first:] = [x for x in _made[first:] if x[1] in keep]
        for spark, path in gone:
            drop_path(spark, path)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            drop_path(spark, path)
        except Exception:  # the session has ended; the folder is the cluster's to clean
            return


def write_table(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Writes df as Parquet into the shared folder and returns a reader of it: cuts the lineage, survives lost executors, and gives the planner a true size."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cartulary_path = path
    return out


def drop_table(df: DataFrame) -> None:
    drop_path(df.sparkSession, df._cartulary_path)


#: A key is hot when it has more than one in HOT_KEYS of all rows, so there are fewer hot keys than that; and not below HOT_ROWS rows.
HOT_KEYS, HOT_ROWS = 10_000, 10_000


def join_hot(rows: DataFrame, lookup: DataFrame, on: list[tuple[str, str]], weight: str, total: int, how: str = "inner", hint: str | None = "merge") -> DataFrame:
    """rows joined with lookup (one row a key, `weight` rows of `rows` each) on equal non-null columns, without a hot key in one task.

    The rows of hot keys meet their lookup rows, fewer than HOT_KEYS by definition, by broadcast and are not shuffled; all others are joined by
    a merge join, or without a hint as the planner chooses by size. rows is read twice.
    """
    floor = max(HOT_ROWS, total // HOT_KEYS)
    hot, cold = lookup.where(F.col(weight) > floor), lookup.where(F.col(weight) <= floor)
    meets = lambda t: [rows[a] == t[b] for a, b in on]
    few = rows.join(F.broadcast(hot), meets(hot))
    keys = hot.select(*[F.col(b).alias(f"__hot{i}") for i, (_, b) in enumerate(on)])
    others = rows.join(F.broadcast(keys), [rows[a] == keys[f"__hot{i}"] for i, (a, _) in enumerate(on)], "left_anti")
    cold = cold.hint(hint) if hint else cold
    many = others.join(cold, [others[a] == cold[b] for a, b in on], how)
    return few.unionByName(many)


def arrow_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of texts small, unless the session has chosen a size below ARROW_ROWS itself. The session keeps that size, as plans read it when they run."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b): a row (node, comp) for each node of an edge; comp is the component's smallest node.

    Alternates the large-star and small-star contractions; the stars' minima are written as tables, so the joins with a node of very many
    neighbours stay splittable. The number of rounds grows with the logarithm of a component's size.
    """
    now = write_table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges0")
    seen = None
    for k in itertools.count():  # each round joins what is near, so it ends
        sign = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (sign.n, sign.s) == seen or not sign.n:
            return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(now.select("b", "b").distinct()) if sign.n else now.select(F.col("a").alias("node"), F.col("b").alias("comp"))
        seen = (sign.n, sign.s)
        # large star: every larger neighbour of u moves to the smallest neighbour of u (or u)
        both = now.union(now.select("b", "a"))
        least = write_table(both.groupBy(F.col("a").alias("u")).agg(F.min(F.least("a", "b")).alias("m")), f"least{k}")
        large = write_table(both.where("b > a").join(least, both.a == least.u).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), f"large{k}")
        # small star: every smaller neighbour of u, and u, move to the smallest of them
        least2 = write_table(large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), f"leasts{k}")
        joined = large.join(least2, large.a == least2.u)
        small = joined.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).where("a <> b").union(least2.select("u", "m"))
        new = write_table(small.distinct(), f"edges{k + 1}")
        for t in (now, least, large, least2):
            drop_table(t)
        now = new
