"""Queries that write tables to files and read them back. Each is declared with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relational as R
from ..operators import retrieval as I
from ..sources import files
from ..sources import tables as S
from ..streaming.collect import work_dir
from .oracles import ACTS, tokens

Query = Callable[[SparkSession, str], DataFrame]
_all: dict[str, Query] = {}
_sql: dict[str, str] = {}

A = f"WITH {ACTS}\n"


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _all[f.__name__], _sql[f.__name__] = f, sql
        return f

    return add


@query(A + "SELECT i, code, number, title, url FROM acts")
def src01_json_lines(spark, d):
    a = S.acts(spark, d).select("i", "code", "number", "title", "url")
    path = work_dir(spark, "jsonl")
    files.write_jsonl(a, path)
    return files.read_jsonl(spark, path, a.schema)


FLAT = r"regexp_replace(title, '\s+', ' ', 'g')"


@query(A + f"SELECT id_archivo, code, {FLAT} AS title FROM acts WHERE i % 9 <> 0")
def src02_catalogue(spark, d):
    """A catalogue with a byte order mark, and rows without a key."""
    a = S.acts(spark, d).select(F.when(F.col("i") % 9 != 0, F.col("id_archivo")).alias(files.BOM + "id_archivo"), "code", F.regexp_replace("title", r"\s+", " ").alias("title"))
    path = work_dir(spark, "csv")
    files.write_csv(a, path)
    return files.read_catalogue(spark, path, "id_archivo").select("id_archivo", "code", F.coalesce("title", F.lit("")).alias("title"))


@query(A + f"SELECT i, code, number, coalesce(url, '') AS url, {FLAT} AS body FROM acts")
def src03_front_matter(spark, d):
    """Documents with a front matter, written and read (also the sink of canonical documents)."""
    path = work_dir(spark, "canonical")
    files.write_canonical(S.acts(spark, d).withColumn("body", F.regexp_replace("title", r"\s+", " ")), path, "i", ["code", "number", "url"], "body")
    return files.read_canonical(spark, path, ["code", "number", "url"]).where("readable").select(F.col("document").cast("long").alias("i"), "code", "number", "url", "body")


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)), 4) > 0 AS ok, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / greatest(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))), 1e-9), 6) AS total FROM embeddings")
def src04_unit_vectors(spark, d):
    """Vectors written with their run's descriptor, and read as unit vectors."""
    path = work_dir(spark, "vectors")
    files.write_vectors(S.read(spark, d, "embeddings").select("vec_id", "embedding"), path, dim=64)
    v, run = files.read_vectors(spark, path)
    total = F.aggregate(files.unit("embedding"), F.lit(0.0), lambda s, x: s + x)
    return v.select("vec_id", F.lit(run["dim"] == 64).alias("ok"), F.round(total, 6).alias("total"))


@query("SELECT event_id, event_type FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0")
def src06_log(spark, d):
    """A log with broken lines and failed entries."""
    e = S.read(spark, d, "events").select("event_id", "event_type")
    good = F.to_json(F.struct("event_id", "event_type", F.when(F.col("event_id") % 7 != 0, "ok").otherwise("error").alias("estado")))
    path = work_dir(spark, "log")
    e.select(F.when(F.col("event_id") % 5 != 0, good).otherwise(F.substring(good, 1, 12)).alias("value")).write.text(path)
    return files.read_log(spark, path, "event_id long, event_type string, estado string").select("event_id", "event_type")


@query("SELECT DISTINCT source FROM documents")
def src07_inventory(spark, d):
    """The folders that hold files, from their names alone."""
    path = work_dir(spark, "tree")
    S.read(spark, d, "documents").select("source", "doc_id").write.partitionBy("source").parquet(path)
    return files.inventory(spark, path, "*.parquet").select(F.regexp_extract("path", r"/source=([^/]+)/", 1).alias("source")).distinct()


@query(A + "SELECT i, CASE WHEN i % 4 = 0 THEN number || ' bis' ELSE number END AS number, version FROM acts, (SELECT unnest([1, 2]) AS version) WHERE version = 2 UNION ALL SELECT i, number, 1 FROM acts WHERE i % 4 = 0")
def snk03_versions(spark, d):
    """A table published twice: readers see the second version, and the first is still there."""
    a = S.acts(spark, d).select("i", "number")
    root = work_dir(spark, "published")
    first = files.publish(a, root)
    new = F.when(F.col("i") % 4 == 0, F.concat("number", F.lit(" bis"))).otherwise(F.col("number"))
    files.publish(files.current(spark, root).select("i", new.alias("number")), root)
    old = files.current(spark, root, first).where("i % 4 = 0").withColumn("version", F.lit(1))
    return files.current(spark, root).withColumn("version", F.lit(2)).unionByName(old)


@query(f"SELECT token, i, count(*) AS tf FROM (SELECT doc_id AS i, unnest({tokens('text')}) AS token FROM documents) WHERE token IN ('the', 'that', 'with') GROUP BY ALL")
def snk04_postings(spark, d):
    """Postings in buckets, read for three tokens."""
    path = work_dir(spark, "postings")
    files.write_postings(I.postings(S.read(spark, d, "documents").select(F.col("doc_id").alias("i"), "text")), path)
    return files.read_postings(spark, path, ["the", "that", "with"])


@query(A + "SELECT id_archivo, number, url FROM acts WHERE i % 2 = 0 UNION ALL SELECT id_archivo, number, NULL FROM acts WHERE i % 2 = 1")
def snk06_append_csv(spark, d):
    """Rows added under the header that is there."""
    a, path = S.acts(spark, d), work_dir(spark, "append")
    files.write_csv(a.where("i % 2 = 0").select("id_archivo", "number", "url"), path)
    files.append_csv(a.where("i % 2 = 1").select("section", "number", "id_archivo"), path)
    return files.read_catalogue(spark, path, "id_archivo")


@query("SELECT bucket, count(*) AS n FROM (SELECT printf('%02x', list_reduce([0::BIGINT] || list_transform(string_split('doc-' || doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT), lambda h, c: (h * 131 + c) & 4294967295) % 256) AS bucket FROM documents) GROUP BY bucket")
def snk08_hash_folders(spark, d):
    path = work_dir(spark, "folders")
    files.write_bucketed(S.read(spark, d, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name")), "name", path)
    rows = spark.read.schema("name string, bucket string").parquet(path)
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT lang, count(*) AS n, count(DISTINCT source) AS sources FROM documents GROUP BY lang)
  SELECT 1 AS n, '| lang | n | sources |' AS line UNION ALL SELECT 2, '|---|---|---|' UNION ALL SELECT (row_number() OVER (ORDER BY lang NULLS FIRST) + 2)::INT, '| ' || coalesce(lang, '') || ' | ' || n || ' | ' || sources || ' |' FROM c""")
def snk10_report(spark, d):
    r = S.read(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources"))
    return files.table_lines(r, ["lang"])


@query(r"""SELECT (row_number() OVER (ORDER BY source))::INT AS n, 'a\_' || source || ' & ' || count(*) || ' \\' AS line FROM documents GROUP BY source""")
def snk10_report_latex(spark, d):
    r = S.read(spark, d, "documents").groupBy(F.concat(F.lit("a_"), "source").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return files.latex_lines(r, ["s"])


@query(A + "SELECT i, code, number, i AS was, vec_id IS NOT NULL AS has FROM acts LEFT JOIN embeddings ON i = vec_id WHERE i % 2 = 0 UNION ALL SELECT i + (SELECT max(i) + 1 FROM acts WHERE i % 2 = 0), code, number, i, vec_id IS NOT NULL FROM acts LEFT JOIN embeddings ON i = vec_id WHERE i % 2 = 1")
def dml06_index_merge(spark, d):
    """Two indexes become one where rows and vectors agree in number and dimension and no document is in both; the second is numbered after the first."""
    a = S.acts(spark, d).select("i", "code", "number", F.col("i").alias("was"))
    v = S.read(spark, d, "embeddings").select(F.col("vec_id").alias("k"), "embedding")
    a = a.join(v, F.col("i") == F.col("k"), "left").select("i", "code", "number", "was", "embedding")
    merged = R.merged_index(a.where("i % 2 = 0"), a.where("i % 2 = 1"), "i", "was", "embedding")
    return merged.select("i", "code", "number", "was", F.col("embedding").isNotNull().alias("has"))


def queries() -> dict[str, Query]:
    return dict(_all)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
