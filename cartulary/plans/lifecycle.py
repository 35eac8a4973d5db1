"""Queries over the catalogue's life: collection, identities, audits, numbering, messages. Each is declared with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieval as I
from ..sources import tables as S
from .oracles import ACTS, CATALOG, LINES, MESSAGES, METRICS, fold, kind

Query = Callable[[SparkSession, str], DataFrame]
_all: dict[str, Query] = {}
_sql: dict[str, str] = {}

A, LN, M, C = f"WITH {ACTS}\n", f"WITH {LINES}\n", f"WITH {MESSAGES}\n", f"WITH {CATALOG}\n"


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _all[f.__name__], _sql[f.__name__] = f, sql
        return f

    return add


# --- joins


@query(A + """SELECT i, CASE WHEN p IS NULL AND c IS NULL THEN 'sin_metadata' WHEN p = c THEN 'alta' WHEN p IS NULL THEN 'media(codigo)' WHEN c IS NULL THEN 'media(posicional)' ELSE 'media(codigo_sobre_posicional)' END AS confidence, coalesce(c, p) AS identity
  FROM (SELECT i, CASE WHEN i % 4 <> 0 THEN number END AS p, CASE WHEN i % 3 = 0 THEN NULL WHEN i % 5 = 0 THEN number || 'b' ELSE number END AS c FROM acts)""")
def join05_two_paths(spark, d):
    """An act's identity by its position and by its printed code; where they differ the code wins."""
    a = S.acts(spark, d)
    by_place = a.where("i % 4 <> 0").select("i", F.col("number").alias("p"))
    by_code = a.where("i % 3 <> 0").select("i", F.when(F.col("i") % 5 == 0, F.concat("number", F.lit("b"))).otherwise(F.col("number")).alias("c"))
    j = a.select("i").join(by_place, "i", "left").join(by_code, "i", "left")
    both = F.when(F.col("p") == F.col("c"), "alta").when(F.col("p").isNotNull() & F.col("c").isNotNull(), "media(codigo_sobre_posicional)")
    return j.select("i", both.when(F.col("c").isNotNull(), "media(codigo)").when(F.col("p").isNotNull(), "media(posicional)").otherwise("sin_metadata").alias("confidence"), F.coalesce("c", "p").alias("identity"))


@query("SELECT 'act_' || doc_id || '.pdf' AS file FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def join09_resume(spark, d):
    """Files without an output of the same base name."""
    base = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    files = S.read(spark, d, "documents").select(F.format_string("act_%d.pdf", "doc_id").alias("file"))
    done = S.read(spark, d, "labels").select(F.format_string("act_%d.json", "doc_id").alias("out"))
    return files.join(done, base("file") == base("out"), "left_anti")


@query(A + "SELECT DISTINCT code, number FROM acts WHERE i % 2 = 0 AND (code, number) IN (SELECT (code, number) FROM acts WHERE i % 3 = 0)")
def join11_overlap(spark, d):
    a = S.acts(spark, d)
    return a.where("i % 2 = 0").join(a.where("i % 3 = 0"), ["code", "number"], "left_semi").select("code", "number").distinct()


@query(M + "SELECT m.id, m.useful, c_name AS name FROM messages m JOIN (SELECT DISTINCT conv_id FROM conversations) v USING (conv_id) LEFT JOIN customer ON c_custkey = m.user_id WHERE useful IS NOT NULL")
def join13_ratings(spark, d):
    talks = S.read(spark, d, "conversations").select("conv_id").distinct()
    users = S.read(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return S.messages(spark, d).where("useful is not null").join(talks, "conv_id").join(users, "user_id", "left").select("id", "useful", "name")


@query(M + "SELECT c_name AS name, conv_id, turn, role, text FROM messages JOIN customer ON c_custkey = user_id")
def join15_transcript(spark, d):
    users = S.read(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return S.messages(spark, d).join(users, "user_id").select("name", "conv_id", "turn", "role", "text")


@query(A + "SELECT i, number, CASE WHEN i % 4 = 0 THEN 'kept' ELSE 'new' END AS origin FROM acts")
def join17_reinsert(spark, d):
    """Rows set aside come back where the new collection has no row of their id."""
    a = S.acts(spark, d).select("i", "number")
    new = a.where("i % 4 <> 0").withColumn("origin", F.lit("new"))
    return new.unionByName(a.withColumn("origin", F.lit("kept")).join(new, "i", "left_anti"))


@query("""WITH h AS (SELECT source, count(*) AS have FROM documents GROUP BY source), t AS (SELECT source, have + CASE WHEN source = (SELECT min(source) FROM h) THEN 9 ELSE 2 END AS total FROM h)
  SELECT source, have, total, have >= total - 3 AS complete FROM h JOIN t USING (source)""")
def join20_declared_totals(spark, d):
    """A folder is complete within three documents of its declared total; where that is unknown the remembered one holds."""
    have = S.read(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("have"))
    first = F.min("source").over(Window.partitionBy())
    told = have.withColumn("first", first).select("source", F.when(F.col("source") == F.col("first"), F.col("have") + 9).alias("told"), (F.col("have") + 2).alias("known"))
    return have.join(told, "source", "left").withColumn("total", F.coalesce("told", "known")).select("source", "have", "total", (F.col("have") >= F.col("total") - 3).alias("complete"))


@query(A + "SELECT i FROM acts WHERE (title, number, fecha_acto) NOT IN (SELECT (title, number, fecha_acto) FROM acts WHERE i % 3 = 1)")
def join22_already_collected(spark, d):
    a = S.acts(spark, d)
    return a.join(a.where("i % 3 = 1"), ["title", "number", "fecha_acto"], "left_anti").select("i")


# --- aggregations


FRAGMENTS = "f AS (SELECT doc_id, count(*) AS n FROM lines WHERE length(line) >= 80 GROUP BY doc_id)"


def _fragments(spark, d):
    parts = S.lines(spark, d).where(F.length("line") >= 80).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    c = S.catalog(spark, d).select("i", "indexed")
    return c.join(parts, F.col("i") == F.col("doc_id"), "left").select("i", "indexed", F.when(F.col("indexed"), F.coalesce("n", F.lit(0))).alias("fragments"))


@query(f"WITH {CATALOG}, {LINES}, {FRAGMENTS} SELECT i, indexed, CASE WHEN indexed THEN coalesce(n, 0) END AS fragments FROM catalog LEFT JOIN f ON doc_id = i")
def agg11_fragments_per_act(spark, d):
    return _fragments(spark, d)


@query(f"WITH {CATALOG}, {LINES}, {FRAGMENTS} SELECT i FROM catalog WHERE indexed AND i NOT IN (SELECT doc_id FROM f)")
def agg12_without_fragments(spark, d):
    return _fragments(spark, d).where("fragments = 0").select("i")


@query(LN + f"SELECT {kind('heading')} AS kind, count(*) AS n FROM lines WHERE length(line) >= 80 GROUP BY 1")
def agg13_by_section_type(spark, d):
    return S.lines(spark, d).where(F.length("line") >= 80).groupBy(T.section_type(F.col("heading"), F.lit(False)).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(A + "SELECT i, number, year + i % 2 AS year FROM acts WHERE i % 2 = 1")
def agg18_year_incoherence(spark, d):
    """Acts whose number names another year than their metadata; two digits mean 20yy."""
    a = S.acts(spark, d).withColumn("year", F.col("year") + F.col("i") % 2)
    y = F.regexp_extract(F.when(F.col("i") % 3 == 0, F.regexp_replace("number", "/20", "/")).otherwise(F.col("number")), r"/(\d{2,4})$", 1)
    return a.where(F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y).cast("long") != F.col("year")).select("i", "number", "year")


@query(A + "SELECT count(*) FILTER (i % 6 = 0) AS missing, count(*) FILTER (i % 6 = 1) AS not_iso FROM acts")
def agg21_date_format(spark, d):
    a = S.acts(spark, d)
    date = F.when(a.i % 6 == 1, a.fecha_acto).when(a.i % 6 != 0, T.iso_date(a.act_date))
    return a.select(date.alias("d")).agg(F.count_if(F.coalesce("d", F.lit("")) == "").alias("missing"), F.count_if((F.col("d") != "") & ~F.col("d").rlike(r"^\d{4}-\d{2}-\d{2}$")).alias("not_iso"))


@query("SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) <> count(DISTINCT role)")
def agg22_repeated_signers(spark, d):
    a = S.read(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list("role").alias("signers"))
    return a.where(F.size("signers") != F.size(F.array_distinct("signers"))).select("conv_id")


@query("SELECT event_type AS status, count(*) AS n, round(count(*) / sum(value), 6) AS per_second FROM events GROUP BY event_type")
def agg24_throughput(spark, d):
    return S.read(spark, d, "events").groupBy(F.col("event_type").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.round(F.count(F.lit(1)) / F.sum("value"), 6).alias("per_second"))


@query("SELECT count(DISTINCT coalesce(nullif(regexp_extract(p_name, '\\d+'), ''), p_name)) AS n FROM part")
def agg26_digit_run(spark, d):
    key = F.coalesce(F.nullif(F.regexp_extract("p_name", r"\d+", 0), F.lit("")), F.col("p_name"))
    return S.read(spark, d, "part").agg(F.count_distinct(key).alias("n"))


@query(f"SELECT source, {METRICS} FROM (SELECT source, CASE WHEN doc_id % 12 <> 0 THEN doc_id % 12 END AS rank FROM documents) GROUP BY source")
def agg27_ir_metrics(spark, d):
    r = S.read(spark, d, "documents").select("source", F.when(F.col("doc_id") % 12 != 0, F.col("doc_id") % 12).alias("rank"))
    return I.ir_metrics(r, ["source"])


@query(A + "SELECT section, max(split_part(number, '/', 1)::BIGINT) AS high FROM acts WHERE year = (SELECT max(year) FROM acts) GROUP BY section")
def agg31_watermark(spark, d):
    a = S.acts(spark, d)
    year = a.agg(F.max("year").alias("y"))  # one row
    return a.join(year, a.year == year.y, "left_semi").groupBy("section").agg(F.max(F.split_part("number", F.lit("/"), F.lit(1)).cast("long")).alias("high"))


@query(C + "SELECT count(*) AS acts, count(*) FILTER (indexed) AS matched, count(*) FILTER (NOT indexed) AS unmatched, count(*) FILTER (indexed AND url IS NOT NULL) AS with_url FROM catalog")
def agg32_match_census(spark, d):
    on = F.col("indexed")
    return S.catalog(spark, d).agg(F.count(F.lit(1)).alias("acts"), F.count_if(on).alias("matched"), F.count_if(~on).alias("unmatched"), F.count_if(on & F.col("url").isNotNull()).alias("with_url"))


@query(A + "SELECT number, string_agg(i::VARCHAR, ',' ORDER BY i) AS ids, count(*) AS n FROM acts GROUP BY number")
def agg33_group_results(spark, d):
    g = S.acts(spark, d).groupBy("number").agg(F.array_sort(F.collect_list("i")).alias("ids"))
    return g.select("number", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"), F.size("ids").cast("long").alias("n"))


@query(M + "SELECT count(DISTINCT user_id) AS users, count(DISTINCT conv_id) AS conversations, count(*) AS messages FROM messages")
def agg35_totals(spark, d):
    return S.messages(spark, d).agg(F.count_distinct("user_id").alias("users"), F.count_distinct("conv_id").alias("conversations"), F.count(F.lit(1)).alias("messages"))


@query("SELECT lower(p_name) AS name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def agg36_target_collisions(spark, d):
    return S.read(spark, d, "part").groupBy(F.lower("p_name").alias("name")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("SELECT coalesce(max(nullif(regexp_extract(c_name, '(\\d+)$', 1), '')::BIGINT), 0) + 1 AS n FROM customer WHERE c_nationkey = 3")
def agg37_next_sequence(spark, d):
    n = F.nullif(F.regexp_extract("c_name", r"(\d+)$", 1), F.lit("")).cast("long")
    return S.read(spark, d, "customer").where("c_nationkey = 3").agg((F.coalesce(F.max(n), F.lit(0)) + 1).alias("n"))


# --- windows, top-k, sets


@query("SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id)::INT AS rank FROM documents")
def win01_rank(spark, d):
    return S.read(spark, d, "documents").select("doc_id", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")).alias("rank"))


@query(LN + ", s AS (SELECT *, sum(CASE WHEN ord % 8 IN (0, 4) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord)::BIGINT AS section FROM lines) SELECT doc_id, section, string_agg(line, chr(10) ORDER BY ord) AS body FROM s GROUP BY doc_id, section")
def win07_sections(spark, d):
    """Lines gathered under the last header before them."""
    head = F.col("heading").isin("Visto", "Artículo n")
    s = S.lines(spark, d).withColumn("section", F.sum(head.cast("long")).over(Window.partitionBy("doc_id").orderBy("ord")))
    body = F.array_sort(F.collect_list(F.struct("ord", "line")))
    return s.groupBy("doc_id", "section").agg(F.array_join(F.transform(body, lambda x: x.line), "\n").alias("body"))


@query(LN + ", k AS (SELECT *, ord - row_number() OVER (PARTITION BY doc_id, heading IN ('Visto', 'Considerando', 'Que sigue') ORDER BY ord) AS island FROM lines) SELECT doc_id, heading IN ('Visto', 'Considerando', 'Que sigue') AS intro, min(ord) AS first, max(ord) AS last, count(*) AS n FROM k GROUP BY doc_id, intro, island")
def win09_siblings(spark, d):
    """Runs of neighbours of one section."""
    k = S.lines(spark, d).withColumn("intro", F.col("heading").isin("Visto", "Considerando", "Que sigue"))
    k = k.withColumn("island", F.col("ord") - F.row_number().over(Window.partitionBy("doc_id", "intro").orderBy("ord")))
    return k.groupBy("doc_id", "intro", "island").agg(F.min("ord").alias("first"), F.max("ord").alias("last"), F.count(F.lit(1)).alias("n")).drop("island")


@query(A + "SELECT section, count(*) FILTER (n > p) AS violations FROM (SELECT section, i * 7 % 50 AS n, lag(i * 7 % 50) OVER (PARTITION BY section ORDER BY i) AS p FROM acts) GROUP BY section")
def win10_monotone(spark, d):
    n = F.col("i") * 7 % 50
    a = S.acts(spark, d).select("section", n.alias("n"), F.lag(n).over(Window.partitionBy("section").orderBy("i")).alias("p"))
    return a.groupBy("section").agg(F.count_if(F.col("n") > F.col("p")).alias("violations"))


@query(A + ", m AS (SELECT section, count(*) AS high FROM acts WHERE i % 2 = 0 GROUP BY section) SELECT i, section, coalesce(high, 0) + row_number() OVER (PARTITION BY section ORDER BY i) AS ordinal FROM acts LEFT JOIN m USING (section) WHERE i % 2 = 1")
def win11_next_ordinal(spark, d):
    a = S.acts(spark, d)
    high = a.where("i % 2 = 0").groupBy("section").agg(F.count(F.lit(1)).alias("high"))
    n = F.row_number().over(Window.partitionBy("section").orderBy("i")).cast("long")
    return a.where("i % 2 = 1").join(high, "section", "left").select("i", "section", (F.coalesce("high", F.lit(0)) + n).alias("ordinal"))


@query(A + ", r AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY act_date DESC, i) AS rank FROM acts) SELECT section, min(CASE WHEN i % 17 = 5 OR number = '7/2025' THEN rank END) AS first FROM r GROUP BY section")
def win13_first_relevant(spark, d):
    r = S.acts(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("section").orderBy(F.desc("act_date"), "i")).cast("long"))
    return r.groupBy("section").agg(F.min(F.when((F.col("i") % 17 == 5) | (F.col("number") == "7/2025"), F.col("rank"))).alias("first"))


@query(M + "SELECT conv_id, arg_max(text, id) AS text FROM messages WHERE role = 'assistant' GROUP BY conv_id")
def win14_latest_answer(spark, d):
    return S.messages(spark, d).where("role = 'assistant'").groupBy("conv_id").agg(F.max_by("text", "id").alias("text"))


@query("""WITH n AS (SELECT source, doc_id, greatest(0, n_chars - 600) AS need, 3000 AS spare FROM documents), c AS (SELECT *, coalesce(sum(need) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM n)
  SELECT doc_id, greatest(0, least(need, spare - before))::BIGINT AS extra FROM c""")
def win16_leftover(spark, d):
    """What a group has left goes to the texts over their share, in order."""
    n = S.read(spark, d, "documents").select("source", "doc_id", F.greatest(F.lit(0), F.col("n_chars") - 600).alias("need"))
    before = F.coalesce(F.sum("need").over(Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return n.select("doc_id", F.greatest(F.lit(0), F.least(F.col("need"), F.lit(3000) - before)).cast("long").alias("extra"))


@query(A + "SELECT i, row_number() OVER (PARTITION BY code ORDER BY act_date, upper(title), i)::INT AS n FROM acts")
def win17_renumber(spark, d):
    """The sequence of acts in a code by date, title in capitals and id, missing ones last."""
    order = [c.asc_nulls_last() for c in (F.col("act_date"), T.upper(F.col("title")), F.col("i"))]
    return S.acts(spark, d).select("i", F.row_number().over(Window.partitionBy("code").orderBy(*order)).alias("n"))


@query(M + "SELECT id, user_id FROM messages ORDER BY id DESC LIMIT 20")
def top04_latest(spark, d):
    return S.messages(spark, d).select("id", "user_id").orderBy(F.desc("id")).limit(20)


@query("SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL ORDER BY n DESC, event_type, user_id LIMIT 10")
def top05_most_common(spark, d):
    return S.read(spark, d, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "event_type", "user_id").limit(10)


@query(A + "SELECT i, act_date::VARCHAR AS day FROM acts ORDER BY act_date DESC, i OFFSET 5 LIMIT 1")
def top06_sixth(spark, d):
    return S.acts(spark, d).select("i", F.col("act_date").cast("string").alias("day"), "act_date").orderBy(F.desc("act_date"), "i").offset(5).limit(1).drop("act_date")


@query("SELECT o_orderpriority AS folder, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS newest FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1")
def top09_most_recent(spark, d):
    o = S.read(spark, d, "orders").where("o_orderstatus <> 'F'")
    return o.groupBy(F.col("o_orderpriority").alias("folder")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("newest"))


@query("SELECT doc_id, source FROM documents ORDER BY source, doc_id OFFSET 40 LIMIT 20")
def top10_page(spark, d):
    return S.read(spark, d, "documents").select("doc_id", "source").orderBy("source", "doc_id").offset(40).limit(20)


@query("SELECT doc_id AS id, text, 'document' AS origin, NULL::VARCHAR AS url FROM documents UNION ALL SELECT page_id, html, 'page', url FROM pages")
def set01_append(spark, d):
    docs = S.read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.lit("document").alias("origin"))
    return docs.unionByName(S.read(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text"), F.lit("page").alias("origin"), "url"), allowMissingColumns=True)


@query(A + "SELECT i FROM acts WHERE section = 'en' AND (i % 5 = 2 OR NOT EXISTS (SELECT 1 FROM acts WHERE section = 'en' AND i % 5 = 2))")
def set03_intersection_or_first(spark, d):
    """The rows that two filters allow, or those of the first where none meets both."""
    a = S.acts(spark, d).where("section = 'en'").select("i")
    both = a.intersect(S.acts(spark, d).where("i % 5 = 2").select("i"))
    some = both.agg((F.count(F.lit(1)) > 0).alias("some"))  # one row
    allowed = a.join(some, ~F.col("some"), "left_semi")
    return both.unionAll(allowed)


# --- scalar functions


def _shape(c):
    return F.regexp_replace(F.trim(c), r"\s+", " ")


@query(A + r"SELECT i, CASE WHEN length(t) <= 60 THEN t ELSE regexp_extract(substring(t, 1, 60), '^(.*)\s', 1) || '…' END AS short FROM (SELECT i, regexp_replace(trim(text, ' '), '\s+', ' ', 'g') AS t FROM acts)")
def str16_shorten(spark, d):
    t = F.col("t")
    a = S.acts(spark, d).select("i", _shape(F.col("text")).alias("t"))
    return a.select("i", F.when(F.length(t) <= 60, t).otherwise(F.concat(F.regexp_extract(F.substring(t, 1, 60), r"^(.*)\s", 1), F.lit("…"))).alias("short"))


@query(A + "SELECT i, section || ' | ' || number || chr(10) || chr(10) || text AS indexed_text FROM acts")
def str20_embedding_header(spark, d):
    return S.acts(spark, d).select("i", F.concat_ws("\n\n", F.concat_ws(" | ", "section", "number"), "text").alias("indexed_text"))


@query(A + f"SELECT i, upper(trim(regexp_replace({fold('title')}, '[^a-z0-9]+', '_', 'g'), '_')) AS name FROM acts")
def str21_clean_name(spark, d):
    return S.acts(spark, d).select("i", F.upper(F.btrim(F.regexp_replace(T.fold(F.col("title")), "[^a-z0-9]+", "_"), F.lit("_"))).alias("name"))


@query(r"SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: length(x) - length(replace(x, '|', '')) >= 2 AND NOT regexp_full_match(x, '[\s|:-]+')))::INT AS table_rows FROM documents")
def str24_table_rows(spark, d):
    rows = F.filter(F.split("text", "\n"), lambda x: (T.pipes(x) >= 2) & ~x.rlike(r"^[\s|:-]+$"))
    return S.read(spark, d, "documents").select("doc_id", F.size(rows).alias("table_rows"))


@query("SELECT p_partkey, arg_min(b, (levenshtein(p_brand || '7', b), b)) AS nearest FROM part, (SELECT unnest(['Brand#11', 'Brand#25', 'Brand#37', 'Brand#52']) AS b) GROUP BY p_partkey")
def str26_nearest_of_list(spark, d):
    """The nearest of a fixed list by edit distance; ties to the first by code point."""
    names = F.array(*map(F.lit, ("Brand#11", "Brand#25", "Brand#37", "Brand#52")))
    best = F.array_min(F.transform(names, lambda b: F.struct(F.levenshtein(F.concat("p_brand", F.lit("7")), b).alias("k"), b.alias("b"))))
    return S.read(spark, d, "part").select("p_partkey", best.b.alias("nearest"))


@query(A + "SELECT i, 'https://portal.example/docs/' || i || '/file?id=' || i AS link FROM acts")
def str39_link(spark, d):
    return S.acts(spark, d).select("i", F.format_string("https://portal.example/docs/%d/file?id=%d", "i", "i").alias("link"))


@query("SELECT event_id, strftime(ts - INTERVAL 3 HOUR, '%d/%m/%Y') AS day FROM events")
def dat02_local_day(spark, d):
    # instants are shifted by the fixed offset, whatever the session's zone
    return S.read(spark, d, "events").select("event_id", F.date_format(F.col("ts") - F.expr("interval 3 hours"), "dd/MM/yyyy").alias("day"))


@query(A + "SELECT i, make_date(year(act_date), month(act_date), least(31, day(last_day(act_date)))) AS due FROM acts")
def dat05_month_end(spark, d):
    day = F.least(F.lit(31), F.dayofmonth(F.last_day("act_date")))
    return S.acts(spark, d).select("i", F.make_date(F.year("act_date"), F.month("act_date"), day).alias("due"))


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def mth01_norm(spark, d):
    e = F.col("embedding")
    return S.read(spark, d, "embeddings").select("vec_id", F.round(F.sqrt(I.dot(e, e)), 6).alias("norm"))


@query("SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: substring(trim(x, ' '), 1, 120)), lambda x: x <> '')[1:8], '|') AS kept FROM documents")
def arr03_clamp(spark, d):
    parts = F.filter(F.transform(F.split("text", "\n"), lambda x: F.substring(F.trim(x), 1, 120)), lambda x: x != "")
    return S.read(spark, d, "documents").select("doc_id", F.array_join(F.slice(parts, 1, 8), "|").alias("kept"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, event_id % 1000 AS pid FROM events")
def jsn02_set_path(spark, d):
    """A path set in a JSON column, null taken as an empty object, and read back."""
    now = F.coalesce(F.from_json("props", "map<string,string>"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(now, lambda k, _: k != "pid")
    out = F.to_json(F.map_concat(kept, F.create_map(F.lit("pid"), (F.col("event_id") % 1000).cast("string"))))
    return S.read(spark, d, "events").select("event_id", F.get_json_object(out, "$.k").cast("long").alias("k"), F.get_json_object(out, "$.pid").cast("long").alias("pid"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def hsh01_sha256(spark, d):
    return S.read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


def queries() -> dict[str, Query]:
    return dict(_all)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
