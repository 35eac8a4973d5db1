"""Queries over indexes, sinks of their own and runs: ranked lists, cells on disk, backups, late runs, the registry of runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cells, runs
from ..operators import relational as R
from ..operators import retrieval as I
from ..sources import files
from ..sources import tables as S
from ..streaming import collect
from ..streaming.collect import work_dir
from .oracles import ACTS, COS, bm25

Query = Callable[[SparkSession, str], DataFrame]
_all: dict[str, Query] = {}
_sql: dict[str, str] = {}

A = f"WITH {ACTS}\n"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _all[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def _texts(spark, d):
    return S.spread(S.read(spark, d, "documents").select(F.col("doc_id").alias("i"), "text"))


def _asked(spark, d):
    return S.read(spark, d, "benchmark").select(F.col("item_id").alias("q"), "text")


def _vectors(spark, d):
    return S.read(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").alias("v"))


# --- ranked lists


@query(f"WITH {bm25(60)} SELECT q, i, rank FROM lex")
def top02_lexical_top(spark, d):
    """The 60 lexically best rows of each query."""
    return I.top(I.bm25(_texts(spark, d), _asked(spark, d)), I.CANDIDATES).select("q", "i", "rank")


@query(f"""WITH {bm25(20)}, den AS (SELECT item_id AS q, i, row_number() OVER (PARTITION BY item_id ORDER BY -i)::INT AS rank FROM benchmark JOIN (SELECT DISTINCT i FROM lex) ON i % 5 = item_id % 5 QUALIFY rank <= 20)
SELECT * FROM (SELECT coalesce(d.q, l.q) AS q, coalesce(d.i, l.i) AS i, d.rank AS rank_dense, l.rank AS rank_lex, row_number() OVER (PARTITION BY coalesce(d.q, l.q) ORDER BY round(coalesce(1::DOUBLE / (60 + d.rank), 0) + coalesce(1::DOUBLE / (60 + l.rank), 0), 9) DESC, coalesce(d.rank, 1000000), coalesce(l.rank, 1000000), coalesce(d.i, l.i))::INT AS rank
FROM den d FULL JOIN lex l ON d.q = l.q AND d.i = l.i) WHERE rank <= 12""")
def top03_fused_top(spark, d):
    """Two ranked lists as one; many totals are equal, and go by the first list, then by the second."""
    lex = collect.written(I.top(I.bm25(_texts(spark, d), _asked(spark, d)), 20).select("q", "i", "rank"), "lex")
    met = _asked(spark, d).select("q", (F.col("q") % 5).alias("m")).join(lex.select("i", (F.col("i") % 5).alias("m")).distinct(), "m")
    dense = I.top(met.select("q", "i", F.col("i").alias("score")), 20).select("q", "i", "rank")
    return I.fuse(dense, lex, 12).select("q", "i", "rank_dense", "rank_lex", "rank")


# --- cells on disk


@query(f"SELECT a.vec_id AS q, b.vec_id AS i, {COS} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {COS} DESC, b.vec_id)::INT AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 QUALIFY rank <= 10")
def snk05_cell_index(spark, d):
    """The index of cells written and read whole: with all cells opened it gives the exact neighbours."""
    path, v = work_dir(spark, "cells"), _vectors(spark, d)
    n = cells.build(v, path)
    return cells.search(spark, path, v.where("pmod(i, 100) = 0").select(F.col("i").alias("q"), "v"), 10, probes=n)


@query()
def ret05_cells(spark, d):
    """The ten nearest of every hundredth vector in the three quarters of the cells that lie nearest to it, as the vectors form no clusters. Its recall is measured in the tests."""
    path, v = work_dir(spark, "cells"), _vectors(spark, d)
    n = cells.build(v, path)
    return cells.search(spark, path, v.where("pmod(i, 100) = 0").select(F.col("i").alias("q"), "v"), 10, probes=-(-3 * n // 4))


# --- scans and sinks


@query(A + "SELECT i, number FROM acts")
def src05_ordered_scan(spark, d):
    """A table's rows in the order of their ids: a range partition and a sort of each."""
    return S.acts(spark, d).orderBy("i").select("i", "number")


@query(A + "SELECT i, code, number, url FROM acts")
def snk01_append_lines(spark, d):
    """Fragments as JSON lines, appended batch by batch; nulls are written."""
    a, path = S.acts(spark, d).select("i", "code", "number", "url"), work_dir(spark, "lines")
    for k in range(3):
        files.write_jsonl(a.where(F.pmod("i", F.lit(3)) == k), path, "append")
    return files.read_jsonl(spark, path, a.schema)


@query("SELECT vec_id, len(embedding)::INT AS dim, round(list_sum(list_transform(embedding, lambda x: x::FLOAT::DOUBLE)), 4) AS total, (SELECT count(*) FROM embeddings) AS rows, 'test' AS model FROM embeddings")
def snk02_vectors(spark, d):
    """Vectors in single precision, and a descriptor of the run that readers check."""
    v, path = S.read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<float>").alias("embedding")), work_dir(spark, "run")
    files.write_vectors(v, path, rows=v.count(), model="test")
    back, run = files.read_vectors(spark, path)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return back.select("vec_id", F.size("embedding").alias("dim"), F.round(total, 4).alias("total"), F.lit(run["rows"]).cast("long").alias("rows"), F.lit(run["model"]).alias("model"))


@query(A + "SELECT i % 10 <> 0 AS readable, count(*) AS n FROM acts GROUP BY 1")
def snk07_canonical(spark, d):
    """Documents with a front matter, some of them broken: each is read or not by itself."""
    path, a = work_dir(spark, "canonical"), S.acts(spark, d)
    files.write_canonical(a.where("i % 10 <> 0").withColumn("body", F.regexp_replace("title", r"\s+", " ")), f"{path}/good", "i", ["code", "number"], "body")
    broken = a.where("i % 10 = 0").select(F.concat(F.lit("---\ncode: "), "code", F.lit("\nno end of the front matter")).alias("value"), F.col("i").cast("string").alias("doc"))
    broken.write.partitionBy("doc").text(f"{path}/bad")
    return files.read_canonical(spark, path, ["code", "number"]).groupBy("readable").agg(F.count(F.lit(1)).alias("n"))


@query(A + "SELECT 'now' AS copy, i, number || ' c' AS number FROM acts UNION ALL SELECT 'first', i, number FROM acts")
def snk09_first_copy(spark, d):
    """A table replaced twice: the copy from before the first time is kept."""
    a, path = S.acts(spark, d).select("i", "number"), f"{work_dir(spark, 'backup')}/table"
    a.write.parquet(path)
    for mark in (" b", " c"):
        files.replace_keeping_first(a.withColumn("number", F.concat("number", F.lit(mark))), path)
    now, first = (spark.read.schema(a.schema).parquet(p) for p in (path, f"{path}.bak"))
    return now.select(F.lit("now").alias("copy"), "*").unionByName(first.select(F.lit("first").alias("copy"), "*"))


@query("""WITH c AS (SELECT source, lang || '|' || count(DISTINCT text) AS kinds, count(*) AS n FROM documents GROUP BY source, lang)
  SELECT 1 AS n, '| source | kinds | n |' AS line UNION ALL SELECT 2, '|---|---|---|' UNION ALL SELECT (row_number() OVER (ORDER BY source, kinds) + 2)::INT, '| ' || source || ' | ' || replace(kinds, '|', '\\|') || ' | ' || n || ' |' FROM c""")
def str25_pipe_table(spark, d):
    """A small result as a pipe table; pipes in cells are escaped."""
    g = S.read(spark, d, "documents").groupBy("source", "lang").agg(F.count_distinct("text").alias("k"), F.count(F.lit(1)).alias("n"))
    return files.table_lines(g.select("source", F.concat_ws("|", "lang", F.col("k").cast("string")).alias("kinds"), "n"), ["source", "kinds"])


# --- runs


@query("""WITH e AS (SELECT user_id, event_id, ts, ts::DATE AS day, (user_id % 24)::INT AS hour FROM events),
  p AS (SELECT *, CASE WHEN day + to_hours(hour) <= ts THEN day + to_hours(hour) ELSE day - 1 + to_hours(hour) END AS occurrence FROM e)
  SELECT user_id, occurrence, min(ts) AS started FROM p WHERE ts - occurrence <= INTERVAL 12 HOUR GROUP BY ALL""")
def stm03_late_runs(spark, d):
    """A stream of moments at which a service is up: the daily run missed before one of them starts then, if it is twelve hours late at most, and once."""
    s = collect.read_stream(spark, f"{d}/events.parquet").select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    at = lambda k: (F.date_add(F.to_date("ts"), k).cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("user_id") % 24).cast("int"))).cast("timestamp_ntz")
    s = s.withColumn("occurrence", F.when(at(0) <= F.col("ts"), at(0)).otherwise(at(-1))).where(F.col("ts") - F.col("occurrence") <= F.expr("interval '12' hour"))
    first = collect.collect_earliest(s, ["user_id", "occurrence"], "ts", work_dir(spark, "late"))
    return first.select("user_id", "occurrence", F.col("ts").alias("started"))


@query("SELECT * FROM (VALUES (1::BIGINT, 'collect', 'ok', 0), (2, 'index', 'error', 1), (3, 'index', 'cancelled', NULL), (4, 'rebuild', 'interrupted', NULL), (5, 'collect', 'running', NULL)) t(id, operation, state, code)")
def dml10_run_registry(spark, d):
    """Runs one at a time, with the ends that a run can have; after a restart those without a living owner were interrupted."""
    root = work_dir(spark, "runs")
    r = runs.Registry(spark, root)
    r.finish(r.start("collect", "ana"), 0)
    r.finish(r.start("index", "ana"), 1)
    r.cancel(r.start("index", "luis"))
    r.start("rebuild", "luis", owner="gone")
    r = runs.Registry(spark, root)
    r.adopt(lambda owner: owner != "gone")
    r.start("collect", "timer", owner="here")
    runs.Registry(spark, root).adopt(lambda owner: owner != "gone")
    return files.current(spark, root).select("id", "operation", "state", "code")


@query(A + "SELECT i, number, CASE WHEN i % 5 <> 0 THEN 'known' ELSE 'new' END AS batch FROM acts WHERE i % 5 <> 0 OR url IS NOT NULL")
def dml11_incremental(spark, d):
    """What is not yet in the index is collected and prepared, then put in by the last step, in a run of the registry."""
    root, a = work_dir(spark, "index"), S.acts(spark, d).select("i", "number", "url")
    files.publish(a.where("i % 5 <> 0").select("i", "number", F.lit("known").alias("batch")), f"{root}/index")
    registry, made = runs.Registry(spark, f"{root}/runs"), {}

    def pending():
        made["todo"] = a.join(files.current(spark, f"{root}/index"), "i", "left_anti").where("url is not null").select("i", "number")

    def prepare():
        made["todo"].withColumn("batch", F.lit("new")).write.parquet(f"{root}/batch")

    def put():
        files.publish(files.current(spark, f"{root}/index").unionByName(spark.read.parquet(f"{root}/batch")), f"{root}/index")

    runs.orchestrate(registry, "update", [("put", True, put), ("pending", False, pending), ("prepare", False, prepare)], "timer")
    return files.current(spark, f"{root}/index")


@query(A + """, f AS (SELECT i, 'd' || (i // 3)::VARCHAR AS doc, url, confidence, 'disposición ' || number AS act FROM acts),
p AS (SELECT act, doc, arg_min(coalesce(url, '') <> '', i) AS u, arg_min(confidence = 'alta', i) AS c, count(*) AS m FROM f GROUP BY act, doc),
w AS (SELECT act, doc FROM p QUALIFY row_number() OVER (PARTITION BY act ORDER BY u DESC, c DESC, m DESC, doc DESC) = 1) SELECT i, doc FROM f JOIN w USING (act, doc)""")
def dml12_rebuild(spark, d):
    """The whole index anew, always deduplicated, as a version beside the old one."""
    root, i = work_dir(spark, "rebuilt"), F.col("i")
    a = S.acts(spark, d)
    frag = a.select("i", F.concat(F.lit("d"), F.floor(i / 3).cast("string")).alias("doc"), "id_archivo", "section", "url", "confidence", F.concat(F.lit("Disposición "), "number").alias("cita"))
    meta = a.select("id_archivo", F.lit("disposición").alias("type"), "code", F.lit("").alias("nro"), F.lit("").alias("anio"))
    runs.rebuild(frag, meta, root, lambda f, m: R.deduplicated(R.mended(f, m)))
    return files.current(spark, root).select("i", "doc")


def queries() -> dict[str, Query]:
    return dict(_all)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
