"""Incremental collection with Structured Streaming: file sources read once for what is new, merged into versioned tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_made: list[tuple[SparkSession, str]] = []


def work_dir(spark: SparkSession, tag: str) -> str:
    """A new folder in the one that driver and executors share, spark.checkpoint.dir, deleted when the process ends. In local mode only, where that is
    unset, a temporary folder; elsewhere an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), "cartulary")
    path = f"{base.rstrip('/')}/streams/{uuid.uuid4().hex}"
    _made.append((spark, path))
    return f"{path}/{tag}"


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended; the folder is the cluster's to clean
            return


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: what several parts of a plan need is computed once, and a lost executor costs no more than a read."""
    path = work_dir(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of the Parquet files at path; the last character of the name is a pattern, so a single file is accepted too."""
    schema = spark.read.parquet(path).schema
    stem, dot, kind = path.rpartition(".")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{stem[:-1]}[{stem[-1]}]{dot}{kind}")


def _last_version(spark: SparkSession, target: str) -> str | None:
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(target)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    done = [n for n in names if n.startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{target}/{n}/_SUCCESS"))]
    return max(done, key=lambda n: int(n[1:]), default=None)


def collect_earliest(stream: DataFrame, keys: list[str], order: str, target: str) -> DataFrame:
    """Runs the stream over all that is there and returns the earliest row (keys, order) of each key, merged with what earlier runs collected."""
    return collect_latest(stream.select(*keys, order), keys, order, target, F.min_by)


def collect_latest(stream: DataFrame, keys: list[str], order: Column | str, target: str, pick: Callable = F.max_by) -> DataFrame:
    """Runs the stream over all that is there and returns the newest row of each key, merged with what earlier runs collected.

    Each micro-batch writes version v<batch> of the table from the version before it, so a batch that runs again after a failure writes the same
    rows. The latest of a key is taken by a partial aggregate before the shuffle; a hot key costs no more than any other.
    """
    spark, columns = stream.sparkSession, stream.columns

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch.select(*columns)
        if number:
            rows = rows.unionByName(batch.sparkSession.read.parquet(f"{target}/v{number - 1}").select(*columns))
        best = rows.groupBy(*keys).agg(pick(F.struct(*columns), order).alias("row"))
        best.select("row.*").write.mode("overwrite").parquet(f"{target}/v{number}")

    q = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{target}/_log").trigger(availableNow=True).start()
    q.awaitTermination()
    last = _last_version(spark, target)
    return spark.read.parquet(f"{target}/{last}") if last else spark.createDataFrame([], stream.schema)


def window_counts(stream: DataFrame, ts: str, by: list[str], target: str, every: str = "1 day") -> DataFrame:
    """(start, *by, n) for tumbling windows of `every`, each micro-batch writing the whole small result as a version."""
    counted = stream.withColumn("__ts", F.col(ts).cast("timestamp")).groupBy(F.window("__ts", every).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))

    def put(batch: DataFrame, number: int) -> None:
        batch.select(F.col("w.start").alias("start"), *by, "n").write.mode("overwrite").parquet(f"{target}/v{number}")

    spark = stream.sparkSession
    q = counted.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{target}/_log").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{target}/{_last_version(spark, target)}")
