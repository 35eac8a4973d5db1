"""Queries over scalar functions, schedules and checks of texts. Each is declared with its DuckDB SQL; inputs are made by rule from ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieval as I
from ..sources import tables as S
from .oracles import ACTS, LINES, bm25, fold, tokens

Query = Callable[[SparkSession, str], DataFrame]
_all: dict[str, Query] = {}
_sql: dict[str, str] = {}

A, LN = f"WITH {ACTS}\n", f"WITH {LINES}\n"


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _all[f.__name__], _sql[f.__name__] = f, sql
        return f

    return add


# --- filters


@query(LN + f"SELECT doc_id, ord FROM lines WHERE regexp_matches(trim(CASE WHEN ord % 5 = 0 THEN 'Página ' || ord ELSE line END), '{T.NOISE}')")
def flt12_noise_titles(spark, d):
    title = F.when(F.col("ord") % 5 == 0, F.concat(F.lit("Página "), F.col("ord").cast("string"))).otherwise(F.col("line"))
    return S.lines(spark, d).where(T.noise(title)).select("doc_id", "ord")


@query(r"SELECT doc_id, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) < 60 AS scan FROM documents")
def flt17_scan(spark, d):
    """A text too short to be one: white space collapsed, under 60 characters."""
    flat = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    return S.read(spark, d, "documents").select("doc_id", (F.length(flat) < 60).alias("scan"))


# --- texts


@query(A + "SELECT i, translate(lower(title), 'áéíóúñ', 'aeioun') AS plain FROM acts")
def str03_fold_six(spark, d):
    """The narrow folding of six letters."""
    return S.acts(spark, d).select("i", F.translate(F.lower("title"), "áéíóúñ", "aeioun").alias("plain"))


@query(A + "SELECT i, title AS repaired FROM acts")
def str29_mojibake(spark, d):
    """UTF-8 that was read as Latin-1 is read again; texts without its marks stay."""
    broken = F.decode(F.encode("title", "UTF-8"), "ISO-8859-1")
    again = F.decode(F.encode(broken, "ISO-8859-1"), "UTF-8")
    return S.acts(spark, d).select("i", F.when(broken.rlike("[ÃÂ]"), again).otherwise(broken).alias("repaired"))


@query(A + f"SELECT i, CASE WHEN len(p) = 0 THEN false ELSE len(list_filter(p, lambda y: contains({fold('text')}, y))) >= least(2, len(p)) END AS named FROM (SELECT i, text, list_filter({tokens('title')}, lambda t: length(t) >= 4) AS p FROM acts)")
def str37_names_entity(spark, d):
    pieces = F.filter(T.tokens(F.col("title")), lambda t: F.length(t) >= 4)
    a = S.acts(spark, d).select("i", "text", pieces.alias("p"))
    return a.select("i", ((F.size("p") > 0) & T.mentions_loose(T.fold(F.col("text")), F.col("p"))).alias("named"))


# --- dates and schedules


@query("""WITH e AS (SELECT event_id, ts, ts::DATE AS day, (event_id % 24)::INT AS hour FROM events),
  p AS (SELECT *, CASE WHEN day + to_hours(hour) <= ts THEN day + to_hours(hour) ELSE day - 1 + to_hours(hour) END AS previous FROM e)
  SELECT event_id, previous, previous + INTERVAL 1 DAY AS next, ts - previous <= INTERVAL 12 HOUR AND event_id % 5 <> 0 AS due FROM p""")
def dat06_occurrences(spark, d):
    """The last and the next time of a daily schedule; it is due when not yet run and at most twelve hours late."""
    ts = F.col("ts").cast("timestamp_ntz")
    at = lambda k: (F.date_add(F.to_date(ts), k).cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("event_id") % 24).cast("int"))).cast("timestamp_ntz")
    times = F.array(at(-1), at(0), at(1))
    e = S.read(spark, d, "events").select("event_id", ts.alias("ts"), F.array_max(F.filter(times, lambda t: t <= ts)).alias("previous"), F.array_min(F.filter(times, lambda t: t > ts)).alias("next"))
    ran = F.when(F.col("event_id") % 5 == 0, F.col("previous"))
    late = F.col("ts") - F.col("previous") <= F.expr("interval '12' hour")
    return e.select("event_id", "previous", "next", (late & (ran.isNull() | (ran < F.col("previous")))).alias("due"))


# --- numbers, lists, nested rows


@query(f"SELECT token, round(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) AS idf FROM (SELECT token, count(DISTINCT i) AS df FROM (SELECT doc_id AS i, unnest({tokens('text')}) AS token FROM documents) GROUP BY token), (SELECT count(*) AS n FROM documents)")
def mth02_idf(spark, d):
    chunks = S.read(spark, d, "documents").select(F.col("doc_id").alias("i"), "text")
    n = F.lit(chunks.count())
    df = I.postings(S.spread(chunks)).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return df.select("token", F.round(F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6).alias("idf"))


@query("SELECT item_id, round(1 / (60 + item_id % 60 + 1)::DOUBLE, 9) AS term, round(1 / log2(2 + item_id % 10)::DOUBLE, 9) AS discount FROM benchmark")
def mth03_terms(spark, d):
    r = F.col("item_id")
    return S.read(spark, d, "benchmark").select("item_id", F.round(1.0 / (61 + r % 60), 9).alias("term"), F.round(1.0 / F.log2(2 + r % 10), 9).alias("discount"))


@query(f"SELECT item_id, len(list_distinct(t))::INT AS kinds, list_contains(t, 'the') AS has, len(list_intersect(list_distinct(t), ['the', 'that', 'with']))::INT AS shared FROM (SELECT item_id, {tokens('text')} AS t FROM benchmark)")
def arr02_sets(spark, d):
    t = S.read(spark, d, "benchmark").select("item_id", T.tokens(F.col("text")).alias("t"))
    return t.select("item_id", F.size(F.array_distinct("t")).alias("kinds"), F.array_contains("t", "the").alias("has"), F.size(F.array_intersect("t", F.array(*map(F.lit, ("the", "that", "with"))))).alias("shared"))


# --- ordered rows and summaries


@query(f"""WITH {ACTS}, {bm25(60, "SELECT DISTINCT number AS q, number AS text FROM acts")},
ids AS (SELECT DISTINCT i, code || ' ' || number AS citing, act_date AS date, z AS q FROM (SELECT *, unnest(list_filter({tokens("text")}, lambda z: regexp_full_match(z, '\\d{{1,6}}/\\d{{4}}'))) AS z FROM acts)),
firsts AS (
  SELECT k, number, citing, min(struct_pack(r := rank, d := date)) AS f
  FROM (SELECT i AS k, number, code || ' ' || number AS own FROM acts) a JOIN (SELECT ids.*, lex.rank FROM ids JOIN lex USING (q, i)) n ON n.q = a.number AND n.citing <> a.own GROUP BY ALL)
SELECT k, number, citing, f.d AS date, row_number() OVER (PARTITION BY k ORDER BY f.r)::INT AS place FROM firsts QUALIFY place <= 10""")
def join21_cited_by(spark, d):
    """Acts and the ten best other acts that name their number, from the 60 lexically best rows of the number."""
    a = S.acts(spark, d).select("i", "number", "code", "act_date", "text")
    ids = a.where(F.col("text").rlike(r"\d\s*/\s*\d{4}")).select("i", F.concat_ws(" ", "code", "number").alias("citing"), F.col("act_date").alias("date"), F.explode(F.array_distinct(T.act_ids(F.col("text")))).alias("q"))
    texts = S.spread(a.select("i", "text"))
    numbers = a.select(F.col("number").alias("q"), F.col("number").alias("text")).distinct()
    naming = ids.join(I.top(I.bm25(texts, numbers), 60), ["q", "i"]).select("q", "citing", "date", "rank")
    acts = S.acts(spark, d).select(F.col("i").alias("k"), "number", F.concat_ws(" ", "code", "number").alias("own"))
    pairs = acts.join(naming, (F.col("number") == F.col("q")) & (F.col("own") != F.col("citing")))
    first = pairs.groupBy("k", "number", "citing").agg(F.min(F.struct("rank", "date")).alias("f"))
    order = Window.partitionBy("k").orderBy("f.rank")
    return first.withColumn("place", F.row_number().over(order)).where("place <= 10").select("k", "number", "citing", F.col("f.date").alias("date"), "place")


@query("WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS kind FROM events GROUP BY user_id) SELECT kind, count(*) AS n, count(*) = 1 AS single FROM l GROUP BY kind")
def agg25_error_log(spark, d):
    """Errors by kind, the last entry of each document counts."""
    last = S.read(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("kind"))
    return last.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select("kind", "n", (F.col("n") == 1).alias("single"))


@query(f"SELECT count(*) AS n, round(avg(len), 6) AS avg_len, sum(len)::BIGINT AS total FROM (SELECT len({tokens('text')}) AS len FROM documents)")
def agg34_corpus_stats(spark, d):
    lengths = S.spread(S.read(spark, d, "documents").select("text")).select(F.size(T.tokens(F.col("text"))).alias("size"))
    size = F.col("size")
    return lengths.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(size), 6).alias("avg_len"), F.sum(size).alias("total"))


def _packed(spark, d, most: int = 1800):
    """(doc_id, part, size): size with a separator of two characters; a longer paragraph is a part of its own."""
    texts = F.split("text", "\n")
    zero = F.array().cast("array<struct<size: int>>")

    def step(acc, p):
        last, n = F.try_element_at(acc, F.lit(-1)), F.length(p)
        fits = F.coalesce(last.size + n + 2 <= most, F.lit(False))
        grown = F.struct((last.size + n + 2).cast("int").alias("size"))
        new = F.struct(n.cast("int").alias("size"))
        return F.when(fits, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(new)))

    parts = F.aggregate(texts, zero, step)
    return S.read(spark, d, "documents").select("doc_id", F.posexplode(parts).alias("part", "p")).select("doc_id", "part", F.col("p.size").alias("size"))


@query("""WITH RECURSIVE s AS (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents),
  r AS (SELECT doc_id, t, 1 AS k, 0 AS part, length(t[1]) AS size FROM s
  UNION ALL SELECT doc_id, t, k + 1, CASE WHEN size + length(t[k + 1]) + 2 <= 1800 THEN part ELSE part + 1 END, CASE WHEN size + length(t[k + 1]) + 2 <= 1800 THEN size + length(t[k + 1]) + 2 ELSE length(t[k + 1]) END FROM r WHERE k < len(t))
  SELECT doc_id, part::INT AS part, max(size)::INT AS size FROM r GROUP BY doc_id, part""")
def win08_parts(spark, d):
    """Paragraphs of a document in parts of at most 1,800 characters, in order."""
    return _packed(spark, d)


COSINE_ONE = "SELECT a.vec_id AS i, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS score FROM embeddings a, embeddings b WHERE b.vec_id = 3 ORDER BY score DESC, i LIMIT 20"


@query(COSINE_ONE)
def top01_vector_top(spark, d):
    """The nearest vectors of one, by a top-k that no full sort precedes."""
    v = S.read(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").alias("v"))
    one = v.where("i = 3").select(F.col("v").alias("w"))  # one row
    return v.crossJoin(one).select("i", F.round(I.dot(F.col("v"), F.col("w")), 5).alias("score")).orderBy(F.desc("score"), "i").limit(20)


@query("SELECT min(o_orderkey) FILTER (o_totalprice <= 50000) AS first FROM orders")
def top07_frontier(spark, d):
    """The first position at or under a floor, as an aggregate."""
    return S.read(spark, d, "orders").agg(F.min(F.when(F.col("o_totalprice") <= 50000, F.col("o_orderkey"))).alias("first"))


@query("SELECT coalesce(doc_id, vec_id) AS k, CASE WHEN vec_id IS NULL THEN 'left' ELSE 'right' END AS side FROM documents FULL JOIN embeddings ON doc_id = vec_id WHERE doc_id IS NULL OR vec_id IS NULL")
def set05_symmetric_difference(spark, d):
    a, b = S.read(spark, d, "documents").select("doc_id"), S.read(spark, d, "embeddings").select("vec_id")
    j = a.join(b, F.col("doc_id") == F.col("vec_id"), "full_outer").where("doc_id is null or vec_id is null")
    return j.select(F.coalesce("doc_id", "vec_id").alias("k"), F.when(F.col("vec_id").isNull(), "left").otherwise("right").alias("side"))


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS tail FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3) GROUP BY conv_id")
def stm05_tail(spark, d):
    """The last lines of each log."""
    last = S.read(spark, d, "conversations").withColumn("rn", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where("rn <= 3")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda r: r.text)
    return last.groupBy("conv_id").agg(F.array_join(rows, "\n").alias("tail"))


def queries() -> dict[str, Query]:
    return dict(_all)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
