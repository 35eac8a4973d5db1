"""File sources and sinks: JSON lines, catalogues in CSV, documents with front matter, vectors, versioned tables, postings, reports.

Sinks write folders of part files by all tasks, never one file by the driver. A reader takes what a writer of the same name has left.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOM = "\ufeff"
BUCKETS = 256
#: Values keep their spaces, and a quote within quotes is doubled.
CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


# --- JSON lines


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of JSON lines under a stated schema, so the files are read once; blank lines are no rows."""
    return spark.read.schema(schema).json(path)


def read_log(spark: SparkSession, path: str, schema: str, state: str = "estado", good: str = "ok") -> DataFrame:
    """The good rows of a log; lines that are no JSON are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where(F.col(state) == good)


# --- CSV


def read_catalogue(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A CSV catalogue with a header, all columns strings; a byte order mark goes, and so do rows without a key."""
    df = spark.read.options(**CSV).csv(path)
    df = df.toDF(*[c.removeprefix(BOM) for c in df.columns])
    return df.where(F.coalesce(F.trim(key), F.lit("")) != "")


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).options(**CSV).csv(path)


def append_csv(df: DataFrame, path: str) -> None:
    """Adds rows under the header that the files have: columns it lacks go, columns that df lacks stay empty, the order is the header's."""
    header = df.sparkSession.read.options(**CSV).csv(path).columns
    have = set(df.columns)
    write_csv(df.select(*[F.col(c).cast("string").alias(c) if c in have else F.lit(None).cast("string").alias(c) for c in header]), path, "append")


# --- folders


def inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, name, length) of all files below a folder; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length")


def bucket_of(name: Column, buckets: int = BUCKETS) -> Column:
    """The folder of a name, two hexadecimal digits: a polynomial hash of its UTF-8 bytes with base 131 in 32 bits (fixed values), modulo the number of buckets."""
    pairs = F.regexp_extract_all(F.hex(name.cast("binary")), F.lit(".."), F.lit(0))
    h = F.aggregate(pairs, F.lit(0).cast("long"), lambda s, x: (s * 131 + F.conv(x, 16, 10).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.lpad(F.lower(F.hex(F.pmod(h, F.lit(buckets)))), 2, "0")


def write_bucketed(df: DataFrame, name: str, path: str) -> None:
    """Parquet in up to 256 folders by the hash of a name; rows of a folder come from one task of each folder, so files stay few."""
    rows = df.withColumn("bucket", bucket_of(F.col(name)))
    rows.repartition("bucket").write.partitionBy("bucket").parquet(path)


# --- documents with front matter


def write_canonical(df: DataFrame, path: str, key: str, fields: list[str], body: str) -> None:
    """One file a document in up to 256 folders by the hash of its key: a front matter of `field: value` lines between rules, the key first, and the body below; line ends in values become spaces."""
    line = lambda c, name: F.concat(F.lit(f"{name}: "), F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\r\n]+", " "))
    text = F.concat(F.lit("---\n"), F.concat_ws("\n", line(key, "document"), *[line(c, c) for c in fields]), F.lit("\n---\n"), F.coalesce(F.col(body), F.lit("")))
    rows = df.select(text.alias("value"), bucket_of(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("bucket"))
    rows.repartition("bucket").write.partitionBy("bucket").option("maxRecordsPerFile", 1).text(path)


def read_canonical(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """(file, document, *fields, body, readable) of all front-matter files below a folder; a file without a front matter is not readable and has nulls."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).withColumn("file", F.col("_metadata.file_path"))
    part = lambda k: F.regexp_extract("value", r"(?s)\A---\n(.*?)\n---\n(.*?)\n?\z", k)
    ok = F.col("value").rlike(r"(?s)\A---\n.*?\n---\n")
    value = lambda c: F.regexp_extract(part(1), rf"(?m)^{c}: ?(.*)$", 1)
    return files.select("file", *[F.when(ok, value(c)).alias(c) for c in ("document", *fields)], F.when(ok, part(2)).alias("body"), ok.alias("readable"))


# --- vectors


def write_vectors(df: DataFrame, path: str, **run: object) -> None:
    """Vectors as Parquet, and a descriptor of the run beside them."""
    df.write.parquet(f"{path}/data")
    about = {"columns": df.columns, **run}
    df.sparkSession.createDataFrame([(json.dumps(about, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/run")


def read_vectors(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/data"), json.loads(spark.read.text(f"{path}/run").first()[0])


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, v): the rows of all .npy matrices below a folder. A matrix is one file for one task, so its writer bounds its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        import numpy as np

        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                m = np.load(io.BytesIO(content), allow_pickle=False).astype(np.float32)
                for at in range(0, len(m), 4096):
                    x = m[at : at + 4096]
                    v = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * m.shape[1]), pa.array(x.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(x)), pa.array(np.arange(at, at + len(x))), v], names=["file", "row", "v"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npy").load(path)
    return files.select("path", "content").mapInArrow(run, "file string, row long, v array<float>")


def unit(v: str) -> Column:
    """A vector over its length, which counts as 1e-9 at least."""
    norm = F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x)), F.lit(1e-9))
    return F.transform(v, lambda x: x / norm)


# --- versions


def publish(df: DataFrame, root: str) -> int:
    """Writes df as the next version of a table and points readers at it when it is complete; earlier versions stay as they are."""
    spark = df.sparkSession
    fs, P = _fs(spark, root)
    taken = [int(s.getPath().getName()[1:]) for s in fs.listStatus(P(root)) if s.getPath().getName()[1:].isdigit()] if fs.exists(P(root)) else []
    n = max(taken, default=0) + 1
    df.write.parquet(f"{root}/v{n}")
    # a reader takes the greatest complete marker, so the switch is the creation of one empty file
    fs.create(P(f"{root}/_current_{n:09d}"), True).close()
    return n


def current(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The version that readers are pointed at, or another one that was."""
    fs, P = _fs(spark, root)
    done = [int(s.getPath().getName()[9:]) for s in fs.listStatus(P(root)) if s.getPath().getName().startswith("_current_")]
    n = max(done) if version is None else version
    if n not in done:
        raise ValueError(f"{root} has no version {n}")
    return spark.read.parquet(f"{root}/v{n}")


def replace_keeping_first(df: DataFrame, path: str) -> bool:
    """Replaces the table at path by df, after a copy of it to `path`.bak; a copy that is there is never written over. Whether it was made now.

    The new rows are complete beside the old ones before these go, so a failure leaves one of the two.
    """
    fs, P = _fs(df.sparkSession, path)
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    copy = fs.exists(P(path)) and not fs.exists(P(f"{path}.bak"))
    if copy:
        jvm.org.apache.hadoop.fs.FileUtil.copy(fs, P(path), fs, P(f"{path}.bak.part"), False, conf)
        fs.rename(P(f"{path}.bak.part"), P(f"{path}.bak"))
    df.write.mode("overwrite").parquet(f"{path}.new")
    fs.delete(P(path), True)
    fs.rename(P(f"{path}.new"), P(path))
    return copy


# --- postings and reports


def write_postings(postings: DataFrame, path: str, buckets: int = 64) -> None:
    """(token, i, tf) in files by a hash of the token, sorted in each, so a few tokens are found by bucket and row group statistics."""
    rows = postings.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int"))
    rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "token", "i").write.partitionBy("bucket").parquet(path)


def read_postings(spark: SparkSession, path: str, tokens: list[str], buckets: int = 64) -> DataFrame:
    """The postings of some tokens; only their buckets are read."""
    near = spark.createDataFrame([(t,) for t in tokens], "t string").select(F.pmod(F.xxhash64("t"), F.lit(buckets)).cast("int")).distinct().collect()  # as many as tokens
    rows = spark.read.parquet(path).where(F.col("bucket").isin([r[0] for r in near]) & F.col("token").isin(tokens))
    return rows.select("token", "i", "tf")


def table_lines(df: DataFrame, order: list[str]) -> DataFrame:
    """(n, line): a report's rows as a Markdown table, for tables of report size: they are numbered in one task."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, df.columns)), F.lit(" |"))
    body = df.select((F.row_number().over(Window.orderBy(*order)) + 2).alias("n"), row.alias("line"))
    head = df.sparkSession.createDataFrame([(1, f"| {' | '.join(df.columns)} |"), (2, f"|{'---|' * len(df.columns)}")], "n int, line string")
    return head.unionByName(body)


def latex_lines(df: DataFrame, order: list[str]) -> DataFrame:
    """(n, line): the rows of a LaTeX table."""
    cell = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"([&%$#_{}])", r"\\$1")
    return df.select(F.row_number().over(Window.orderBy(*order)).alias("n"), F.concat(F.concat_ws(" & ", *map(cell, df.columns)), F.lit(" \\\\")).alias("line"))
