"""Queries that keep tables up to date, follow dialogues and streams, and check answers. Each is declared with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import tables as S
from ..streaming import collect
from .oracles import ACTS, CATALOG, LINES, MESSAGES, fold

Query = Callable[[SparkSession, str], DataFrame]
_all: dict[str, Query] = {}
_sql: dict[str, str] = {}

A, LN, M, C = f"WITH {ACTS}\n", f"WITH {LINES}\n", f"WITH {MESSAGES}\n", f"WITH {CATALOG}\n"


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _all[f.__name__], _sql[f.__name__] = f, sql
        return f

    return add


# --- filters and projections


@query(A + "SELECT i, code, number, year, fecha_acto, section, url, confidence, title FROM acts")
def flt04_whitelist(spark, d):
    return S.acts(spark, d).select("i", "code", "number", "year", "fecha_acto", "section", "url", "confidence", "title")


@query(A + "SELECT i, number, title FROM acts WHERE i = 17")
def flt05_point_lookup(spark, d):
    return S.acts(spark, d).where("i = 17").select("i", "number", "title")


@query(f"SELECT doc_id FROM (SELECT doc_id, {fold('text')} AS t FROM documents) WHERE contains(t, 'the') AND contains(t, 'that')")
def flt09_anchor_then_verify(spark, d):
    """The longest piece as an anchor, then the others; both sides are folded."""
    t = S.read(spark, d, "documents").select("doc_id", T.fold(F.col("text")).alias("t"))
    return t.where(F.contains("t", F.lit("that"))).where(F.contains("t", F.lit("the"))).select("doc_id")


@query(A + "SELECT i FROM acts WHERE i % 5 <> 0 AND act_date > DATE '2025-03-31'")
def flt18_date_window(spark, d):
    """Strictly after the cut; dates that cannot be read go."""
    a = S.acts(spark, d)
    date = F.when(a.i % 5 != 0, a.fecha_acto).otherwise("sin fecha")
    return a.where(F.try_to_date(date, "dd/MM/yyyy") > F.lit("2025-03-31").cast("date")).select("i")


@query(A + "SELECT i FROM acts WHERE contains(lower(title), 'the')")
def flt19_title_search(spark, d):
    return S.acts(spark, d).where(F.contains(F.lower("title"), F.lit("the"))).select("i")


# --- scalar functions


@query(A + "SELECT i, CASE WHEN i % 6 = 0 THEN '' ELSE code || '|' || split_part(number, '/', 1) || '|' || year || ',' || substring(code, 6) || '|' || split_part(number, '/', 1) || '|' || year END AS keys FROM acts")
def str11_act_keys(spark, d):
    """Keys with and without the type prefix; spaces go, two digits of a year mean 20yy, a missing part gives none."""
    a = S.acts(spark, d).withColumn("n", F.when(F.col("i") % 6 != 0, F.concat(F.lit(" "), F.split_part("number", F.lit("/"), F.lit(1)), F.lit(" "))))
    code = F.upper(F.regexp_replace(F.lower("code"), r"\s", ""))
    year = F.regexp_replace(F.when(F.col("i") % 2 == 0, F.substring(F.col("year").cast("string"), 3, 2)).otherwise(F.col("year").cast("string")), r"^(\d\d)$", "20$1")
    keys = F.array_distinct(F.array(*[F.concat_ws("|", c, F.regexp_replace("n", r"\D", ""), year) for c in (code, F.regexp_replace(code, "^DISP-", ""))]))
    return a.select("i", F.when(F.col("n").isNull(), "").otherwise(F.array_join(keys, ",")).alias("keys"))


@query(LN + "SELECT doc_id, ord, 'Anexo I' AS name FROM lines WHERE heading = 'ANEXO I'")
def str17_annex_name(spark, d):
    title = F.regexp_extract(F.lower("heading"), r"^anexo\s+([ivxlc]+|\d+)", 1)
    return S.lines(spark, d).where(title != "").select("doc_id", "ord", F.concat(F.lit("Anexo "), F.upper(title)).alias("name"))


@query("SELECT doc_id, regexp_replace(text, '(^|\\n)[ \\t]*[·●•][ \\t]*', '\\1- ', 'g') AS body FROM documents")
def str28_bullets(spark, d):
    return S.read(spark, d, "documents").select("doc_id", F.regexp_replace("text", r"(^|\n)[ \t]*[·●•][ \t]*", "$1- ").alias("body"))


@query(M + "SELECT id, turn > 0 AND NOT regexp_matches(text, '\\d+/\\d{2,4}') AS needs_context FROM messages WHERE role = 'user'")
def str36_needs_context(spark, d):
    return S.messages(spark, d).where("role = 'user'").select("id", ((F.col("turn") > 0) & ~F.col("text").rlike(r"\d+/\d{2,4}")).alias("needs_context"))


@query("SELECT event_id, ts::DATE AS day FROM events")
def dat07_epoch_day(spark, d):
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    return S.read(spark, d, "events").select("event_id", F.to_date(F.timestamp_seconds(seconds)).alias("day"))


@query(M + "SELECT id, CASE WHEN coalesce(sources, '') IN ('', '[]') THEN 0 ELSE 2 END::INT AS n, coalesce(json_extract_string(sources, '$[0].cita'), '') AS first FROM messages")
def jsn01_sources(spark, d):
    """A JSON list column; null, empty and invalid values are the empty list."""
    got = F.coalesce(F.from_json("sources", "array<struct<cita:string>>"), F.array().cast("array<struct<cita:string>>"))
    return S.messages(spark, d).select("id", F.size(got).alias("n"), F.coalesce(F.try_element_at(got, F.lit(1)).cita, F.lit("")).alias("first"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, 8 AS top FROM events")
def map01_settings(spark, d):
    """Stored settings over defaults: only known keys survive, stored values win."""
    defaults = F.create_map(F.lit("k"), F.lit("0"), F.lit("top"), F.lit("8"))
    stored = F.from_json("props", "map<string,string>")
    value = lambda x: F.coalesce(F.try_element_at(stored, F.lit(x)), F.element_at(defaults, x))
    return S.read(spark, d, "events").select("event_id", value("k").cast("long").alias("k"), value("top").cast("int").alias("top"))


# --- retrieval state and checks


@query(C + "SELECT section, count(*) FILTER (coalesce(confidence, '') NOT IN ('alta', 'media')) AS low FROM catalog GROUP BY section")
def ret15_low_confidence(spark, d):
    return S.catalog(spark, d).groupBy("section").agg(F.count_if(~F.coalesce("confidence", F.lit("")).isin("alta", "media")).alias("low"))


# --- data changes


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'known' ELSE sha256(text) END AS digest FROM documents")
def dml03_backfill(spark, d):
    old = F.when(F.col("doc_id") % 3 == 0, "known").when(F.col("doc_id") % 3 == 1, "")
    return S.read(spark, d, "documents").select("doc_id", F.coalesce(F.nullif(old, F.lit("")), F.sha2("text", 256)).alias("digest"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS value FROM events GROUP BY user_id")
def dml04_latest_setting(spark, d):
    return S.read(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("value"))


@query("SELECT doc_id, CASE WHEN v.vec_id IS NULL THEN 'no vector' WHEN d.doc_id IS NULL THEN 'no text' END AS fault FROM documents d FULL JOIN embeddings v ON doc_id = vec_id WHERE v.vec_id IS NULL OR d.doc_id IS NULL")
def dml09_alignment(spark, d):
    v = S.read(spark, d, "embeddings").select("vec_id")
    j = S.read(spark, d, "documents").select("doc_id").join(v, F.col("doc_id") == F.col("vec_id"), "full_outer")
    return j.select("doc_id", F.when(F.col("vec_id").isNull(), "no vector").when(F.col("doc_id").isNull(), "no text").alias("fault")).where("fault is not null")


# --- streams


@query("SELECT user_id, max(struct_pack(a := ts, b := event_id)).b AS event_id FROM events GROUP BY user_id")
def stm02_incremental_collection(spark, d):
    """The newest event of each user, collected by a stream of the table's files."""
    s = collect.read_stream(spark, f"{d}/events.parquet").select("user_id", "event_id", "ts")
    return collect.collect_latest(s, ["user_id"], F.struct("ts", "event_id"), collect.work_dir(spark, "latest")).select("user_id", "event_id")


@query("SELECT strftime(ts::DATE, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stm06_daily_windows(spark, d):
    """Tumbling windows over the stream, an extra."""
    w = collect.window_counts(collect.read_stream(spark, f"{d}/events.parquet"), "ts", ["event_type"], collect.work_dir(spark, "windows"))
    return w.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query(M + """, o AS (SELECT conv_id, id, role, (id % 5)::VARCHAR AS act, max(id) OVER (PARTITION BY conv_id) AS last FROM messages)
  SELECT conv_id, coalesce(string_agg(DISTINCT act, ',' ORDER BY act) FILTER (role = 'user' OR (id = last AND role = 'assistant')), '') AS acts FROM o GROUP BY conv_id""")
def stm04_dialogue_state(spark, d):
    """Acts named by the user stay, those named by the system last one turn."""
    turns = F.array_sort(F.collect_list(F.struct("id", "role", (F.col("id") % 5).cast("string").alias("act"))))
    empty = F.array().cast("array<string>")
    zero = F.struct(empty.alias("own"), empty.alias("brief"))
    step = lambda s, t: F.struct(F.when(t.role == "user", F.array_union(s.own, F.array(t.act))).otherwise(s.own).alias("own"), F.when(t.role == "assistant", F.array(t.act)).otherwise(empty).alias("brief"))
    state = S.messages(spark, d).groupBy("conv_id").agg(F.aggregate(turns, zero, step).alias("s"))
    return state.select("conv_id", F.array_join(F.array_sort(F.array_union("s.own", "s.brief")), ",").alias("acts"))


def queries() -> dict[str, Query]:
    return dict(_all)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
