"""All queries of the library; the keys follow the inventory of operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import relational as R
from ..operators import retrieval as I
from ..sources import tables as S
from . import citations, indexes, lifecycle, oracles, phrases, recall, records, titles, transfer, upkeep

Query = Callable[[SparkSession, str], DataFrame]
_all: dict[str, Query] = {}


def query(f: Query) -> Query:
    _all[f.__name__] = f
    return f


def _docs(spark, d):
    return S.read(spark, d, "documents")


# --- scans, filters, projections


@query
def src12_html_paragraphs(spark, d):
    """HTML to paragraphs by tag rules alone: br is a line end, /p a paragraph end, other tags go."""
    h = F.regexp_replace(F.regexp_replace("html", r"(?i)<br\s*/?>", "\n"), r"(?i)</p>", "\n\n")
    h = F.replace(F.regexp_replace(h, r"<[^>]+>", ""), F.lit("&nbsp;"), F.lit(" "))
    h = F.replace(F.replace(F.replace(h, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    parts = F.filter(F.transform(F.split(h, r"\n\n+"), lambda x: F.trim(x)), lambda x: x != "")
    return S.read(spark, d, "pages").select("page_id", F.posexplode(parts).alias("ord", "paragraph"))


@query
def flt01_equal_filters(spark, d):
    return S.acts(spark, d).where((F.coalesce("section", F.lit("")) == "en") & (F.coalesce("confidence", F.lit("")) == "alta")).select("i", "section", "confidence")


@query
def flt02_since(spark, d):
    return S.acts(spark, d).where(F.try_to_date("fecha_acto", "dd/MM/yyyy") >= F.lit("2025-06-01").cast("date")).select("i", "fecha_acto")


@query
def flt03_articles_only(spark, d):
    return S.lines(spark, d).where(T.section_type(F.col("heading"), F.lit(False)) == "articulo").select("doc_id", "ord")


@query
def flt06_multi_get(spark, d):
    """Requested positions in the requested order, missing ones with nulls."""
    asked = spark.range(1).select(F.posexplode(F.array(*[F.lit(x).cast("long") for x in (7, 3, 999_999_999, 11)])).alias("pos", "want"))
    return asked.join(S.acts(spark, d), F.col("want") == F.col("i"), "left").select("pos", "want", "number", "code")


@query
def flt07_fragments_of(spark, d):
    return S.lines(spark, d).where("doc_id = 5").select("ord", "line")


@query
def flt08_url_of(spark, d):
    return S.acts(spark, d).groupBy("number").agg(F.min_by("url", F.when(F.col("url").isNotNull(), F.col("i"))).alias("url"))


PIECES = ("the", "that", "with")


@query
def flt10_mentions_strict(spark, d):
    t, p = T.fold(F.col("text")), F.array(*map(F.lit, PIECES))
    return _docs(spark, d).select("doc_id", T.mentions_strict(t, p).alias("strict"))


@query
def flt11_mentions_loose(spark, d):
    return _docs(spark, d).select("doc_id", T.mentions_loose(T.fold(F.col("text")), F.array(*map(F.lit, PIECES))).alias("loose"))


@query
def flt13_min_length(spark, d):
    return S.lines(spark, d).where(F.length("line") >= 80).groupBy("doc_id").agg(F.count(F.lit(1)).alias("parts"))


@query
def flt14_tables(spark, d):
    return _docs(spark, d).where(T.looks_like_table(F.col("text"))).select("doc_id")


@query
def flt15_incomplete(spark, d):
    low = lambda c: F.coalesce(F.trim(F.lower(c)), F.lit("")).isin("", "unknown")
    return S.acts(spark, d).select("i", low("url").alias("no_url"), low("code").alias("no_code"))


# --- joins


@query
def join01_on_disk(spark, d):
    files = S.read(spark, d, "labels").select(F.col("doc_id").cast("string").alias("id_archivo"))
    return S.acts(spark, d).join(files, "id_archivo", "left_semi").select("id_archivo", "code", "number")


@query
def join02_override(spark, d):
    meta = S.acts(spark, d).where("confidence in ('alta', 'media')").select(F.col("i").alias("k"), "url", "section")
    j = _docs(spark, d).join(meta, F.col("doc_id") == F.col("k"), "left")
    return j.select("doc_id", F.coalesce(F.nullif("url", F.lit("")), "source").alias("origin"), F.coalesce(F.nullif("section", F.lit("")), F.lit("none")).alias("section"))


@query
def join03_first_key(spark, d):
    """Two candidate keys an act, the first that hits wins; of equal build keys the first row."""
    build = R.first_by(S.acts(spark, d).select(F.concat_ws(":", "code", "number").alias("key"), F.col("i").alias("b")), ["key"], "b")
    keys = F.array(F.concat_ws(":", F.regexp_replace("code", "^DISP-", ""), "number"), F.concat_ws(":", "code", "number"))
    probe = S.acts(spark, d).select("i", F.posexplode(keys).alias("pos", "key"))
    return probe.join(build, "key").groupBy("i").agg(F.min_by("b", "pos").alias("b"), F.min("pos").alias("tier"))


@query
def join04_unique_candidate(spark, d):
    """An act takes the id of the one act with its section and title, whatever their letters' case and white space; a missing section or title is a value like any other."""
    t = T.upper(T.trim(F.regexp_replace("title", T.WHITE + "+", " ")))
    a = S.acts(spark, d).select("i", "id_archivo", F.struct("section", t).alias("key"))  # in a struct null equals null
    return a.select("i", "key").join(R.unique_candidates(a, ["key"], "id_archivo"), "key").select("i", "id_archivo")


@query
def join06_pending_download(spark, d):
    return S.catalog(spark, d).where("not downloaded").select("i", "id_archivo")


@query
def join07_pending_index(spark, d):
    return S.catalog(spark, d).where("downloaded and not indexed").select("i")


@query
def join08_not_indexed(spark, d):
    return _docs(spark, d).join(S.read(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query
def join10_two_tier(spark, d):
    a = S.acts(spark, d).select("i", "number")
    first = a.where("i % 3 = 0").select("i", F.lit("id").alias("via"))
    second = a.where("i % 4 = 1").groupBy("number").agg(F.lit("number").alias("via"))
    return R.two_tier(a, first, second, "i", "number", "via").select("i", "via")


@query
def join12_messages(spark, d):
    m = S.messages(spark, d)
    c = m.select(F.col("conv_id").alias("c"), "user_id").distinct()
    return m.drop("user_id").join(c, F.col("conv_id") == F.col("c")).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("conv_id").alias("convs"))


@query
def join14_previous_user_turn(spark, d):
    w = Window.partitionBy("conv_id").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    m = S.messages(spark, d).withColumn("question", F.last(F.when(F.col("role") == "user", F.col("text")), True).over(w))
    return m.where("role = 'assistant'").select("id", "question")


@query
def join16_inventory_diff(spark, d):
    p = S.read(spark, d, "part")
    a = p.where("p_partkey % 11 <> 0").select(F.col("p_name").alias("na"), F.col("p_size").alias("sa"), F.col("p_partkey").alias("ka"))
    b = p.where("p_partkey % 7 <> 0").select(F.col("p_name").alias("nb"), (F.col("p_size") + (F.col("p_partkey") % 13 == 0).cast("int")).alias("sb"), F.col("p_partkey").alias("kb"))
    j = a.join(b, (F.col("ka") == F.col("kb")) & (F.col("na") == F.col("nb")) & (F.col("sa") == F.col("sb")), "full_outer").where("ka is null or kb is null")
    return j.select(F.coalesce("ka", "kb").alias("part"), F.coalesce("sa", "sb").alias("size"), F.when(F.col("kb").isNull(), "local").otherwise("remote").alias("side"))


@query
def join19_uncovered(spark, d):
    k = _docs(spark, d).select(F.col("doc_id").alias("k"), F.lit("md").alias("kind")).union(S.read(spark, d, "labels").select("doc_id", F.lit("json"))).union(S.read(spark, d, "embeddings").select("vec_id", F.lit("yaml")))
    return k.groupBy("k").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds")).where("kinds <> 'json,md,yaml'")


# --- aggregations


@query
def agg01_size(spark, d):
    return _docs(spark, d).agg(F.countDistinct("doc_id").alias("documents"), F.countDistinct("text").alias("texts"))


@query
def agg02_coverage_date(spark, d):
    return R.coverage_date(S.acts(spark, d), "i", "act_date")


@query
def agg03_by_section(spark, d):
    """Documents once, by the section of their first line, and all lines."""
    ln = S.lines(spark, d).withColumn("kind", T.section_type(F.col("heading"), F.lit(False)))
    first = ln.groupBy("doc_id").agg(F.min_by("kind", "ord").alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("documents"))
    return ln.groupBy("kind").agg(F.count(F.lit(1)).alias("fragments")).join(first, "kind", "left").select("kind", "fragments", F.coalesce("documents", F.lit(0)).alias("documents"))


@query
def agg04_by_type(spark, d):
    return S.acts(spark, d).groupBy(F.coalesce(F.nullif(F.upper(F.trim("code")), F.lit("")), F.lit("(sin identificar)")).alias("code")).agg(F.count(F.lit(1)).alias("documents"))


@query
def agg05_ratings(spark, d):
    return S.messages(spark, d).where("role = 'assistant'").agg(F.count(F.lit(1)).alias("answers"), F.count_if(F.col("useful") == 1).alias("useful"), F.count_if(F.col("useful") == 0).alias("useless"))


@query
def agg06_usage(spark, d):
    e = S.read(spark, d, "events")
    last = e.agg(F.max("ts").alias("t"))
    return e.crossJoin(last).where(F.col("ts") > F.col("t") - F.expr("interval 7 days")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


@query
def agg07_no_sources(spark, d):
    return S.messages(spark, d).where("role = 'assistant'").agg(F.count_if(F.coalesce("sources", F.lit("")).isin("", "[]")).alias("n"))


@query
def agg08_daily_series(spark, d):
    return R.daily_series(S.read(spark, d, "events"), "ts", F.count(F.lit(1)), "n")


@query
def agg09_most_cited(spark, d):
    m = S.messages(spark, d).where("role = 'assistant'").orderBy(F.desc("id")).limit(500)
    cited = m.select(F.explode(F.from_json("sources", "array<struct<cita: string>>")).alias("s")).select(T.identity(F.col("s.cita")).alias("act"))
    return cited.groupBy("act").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "act").limit(10)


@query
def agg10_catalog_state(spark, d):
    c = S.catalog(spark, d)
    return c.agg(F.count(F.lit(1)).alias("total"), F.count_if("downloaded").alias("downloaded"), F.count_if("indexed").alias("indexed"), F.count_if(~F.col("downloaded")).alias("pending"), F.count_if(F.col("downloaded") & ~F.col("indexed")).alias("to_index"), F.count_if(F.col("url").isNull()).alias("no_url"))


@query
def agg17_collisions(spark, d):
    return S.acts(spark, d).groupBy("code", "number").count().where("count > 1").select("code", "number", F.col("count").alias("n"))


@query
def agg19_missing(spark, d):
    a = S.acts(spark, d)
    long = a.select(F.explode(F.create_map(*[x for c in ("url", "code", "section", "title") for x in (F.lit(c), F.col(c))])).alias("field", "value"))
    return long.groupBy("field").agg(F.count_if(F.col("value").isNull()).alias("absent"), F.count_if(F.col("value") == "").alias("empty"))


@query
def agg20_vocabulary(spark, d):
    return _docs(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumn("known", F.col("lang").isin("es", "en"))


@query
def agg28_metrics_by_group(spark, d):
    r = _docs(spark, d).select(F.col("lang"), F.col("source"), F.when(F.col("doc_id") % 12 != 0, (F.col("doc_id") % 12).cast("int")).alias("rank"))
    both = r.withColumn("type", F.lit("all")).unionByName(r.withColumn("type", F.col("source")))
    return I.ir_metrics(both, ["lang", "type"])


@query
def agg30_mean_sd(spark, d):
    long = S.read(spark, d, "part").select(F.explode(F.create_map(F.lit("size"), F.col("p_size").cast("double"), F.lit("price"), F.col("p_retailprice"))).alias("dimension", "x"))
    return long.groupBy("dimension").agg(F.round(F.avg("x"), 4).alias("mean"), F.round(F.stddev_samp("x"), 4).alias("sd"))


# --- windows, top-k, sets


@query
def win02_survivors(spark, d):
    a = S.acts(spark, d).withColumn("ok", F.col("confidence").isin("catalogo", "alta"))
    return R.first_by(a, ["code", "number"], F.col("url").isNull(), F.desc("ok"), F.desc("i")).select("code", "number", "i")


@query
def win03_cap(spark, d):
    return R.first_by(S.acts(spark, d), ["number"], "i", n=3).select("number", "i")


@query
def win04_islands(spark, d):
    a = S.acts(spark, d).withColumn("c", (F.col("i") * 7 % 50).cast("int"))
    return R.islands(a, ["section"], ["i"], "c").select("i", "section", "segment")


@query
def win05_after_signatures(spark, d):
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    ln = S.lines(spark, d).withColumn("sig", F.lower("heading").isin("firmas", "hoja de firmas"))
    ln = ln.withColumn("after", F.coalesce(F.max("sig").over(w), F.lit(False)))
    return ln.select("doc_id", "ord", T.section_type(F.col("heading"), F.col("after")).alias("kind"))


@query
def win06_current_annex(spark, d):
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    ln = S.lines(spark, d)
    return ln.select("doc_id", "ord", F.last(F.when(F.lower("heading").startswith("anexo"), F.col("ord")), True).over(w).alias("annex"))


@query
def win12_round_robin(spark, d):
    h = F.md5(F.concat(F.lit("2026:"), F.col("i").cast("string")).cast("binary"))
    cell = Window.partitionBy("section", "code").orderBy(h, "i")
    a = S.acts(spark, d).withColumn("round", F.row_number().over(cell))
    return a.orderBy("round", "section", "code").limit(100).select("i", "round")


@query
def win15_last_turns(spark, d):
    return R.first_by(S.messages(spark, d), ["conv_id"], F.desc("id"), n=6).select("conv_id", "id", F.substring("text", 1, 100).alias("text"))


@query
def win18_share_of_max(spark, d):
    g = _docs(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return g.select("source", F.round(F.col("n") / F.greatest(F.lit(1), F.max("n").over(Window.partitionBy())), 6).alias("share"))


@query
def top08_modulo_shard(spark, d):
    a = R.numbered(_docs(spark, d).select("source", "doc_id"), ["source", "doc_id"], "k")
    return a.where(F.pmod("k", F.lit(4)) == 1).select("doc_id", F.col("k").cast("int").alias("k"))


@query
def set02_difference(spark, d):
    return _docs(spark, d).select("doc_id").exceptAll(S.read(spark, d, "labels").select("doc_id"))


@query
def set04_ordered_distinct(spark, d):
    return R.first_by(_docs(spark, d), ["text"], "doc_id").select("doc_id")


# --- text functions


@query
def str01_tokenize(spark, d):
    t = T.tokens(F.col("text"))
    return S.read(spark, d, "benchmark").select("item_id", F.size(t).alias("n"), F.array_join(t, " ").alias("tokens"))


@query
def str02_fold(spark, d):
    return S.acts(spark, d).select("i", T.fold(F.col("title")).alias("folded"))


@query
def str04_act_ids(spark, d):
    a = S.acts(spark, d).withColumn("t", F.concat_ws(" ", F.lit("según"), F.col("code"), F.lit(":"), F.col("number"), F.lit("y 17 / 2008")))
    return a.select("i", F.array_join(T.act_ids(F.col("t")), ",").alias("ids"))


@query
def str10_identity(spark, d):
    return S.acts(spark, d).select("i", T.identity(F.concat(F.lit(" Disposición "), F.col("number"), F.lit(" — Artículo 1"))).alias("identity"))


@query
def str14_section_type(spark, d):
    return S.lines(spark, d).groupBy(T.section_type(F.col("heading"), F.lit(False)).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query
def str23_truncate(spark, d):
    return _docs(spark, d).select("doc_id", T.truncate_on_word(F.col("text"), 120).alias("short"))


@query
def dat01_iso(spark, d):
    return S.acts(spark, d).select("i", T.iso_date(F.col("fecha_acto")).alias("iso"))


# --- retrieval and lifecycle


def _chunks(spark, d):
    return S.spread(_docs(spark, d).select(F.col("doc_id").alias("i"), "text"))


def _queries(spark, d):
    return S.read(spark, d, "benchmark").select(F.col("item_id").alias("q"), "text")


@query
def ret01_index(spark, d):
    return I.postings(_chunks(spark, d)).groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query
def ret02_bm25(spark, d):
    return I.top(I.bm25(_chunks(spark, d), _queries(spark, d)), 10)


@query
def ret04_knn(spark, d):
    v = S.read(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").alias("v"))
    return I.knn(v, S.read(spark, d, "embeddings").where("pmod(vec_id, 100) = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v")), 10)


@query
def ret08_fusion(spark, d):
    v = S.read(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").alias("v"))
    q = _queries(spark, d)
    dense = I.knn(v, q.join(v, F.col("q") == F.col("i")).select("q", "v"), I.CANDIDATES)
    lexical = I.top(I.bm25(_chunks(spark, d), q), I.CANDIDATES)
    return I.fuse(dense, lexical, 8).select("q", "i", "total", "rank")


@query
def dml01_upsert(spark, d):
    a = S.acts(spark, d).select("i", "number", "url")
    new = a.where("i % 3 = 0").select("i", F.concat("number", F.lit("-v2")).alias("number")).union(a.where("i % 100 = 1").select(F.col("i") + 10_000_000, "number"))
    return R.upsert(a, new, "i", ["number"])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval for all benchmark queries."""
    return ret08_fusion(spark, sf_dir)


def queries() -> dict[str, Query]:
    return _all | lifecycle.queries() | upkeep.queries() | recall.queries() | transfer.queries() | phrases.queries() | citations.queries() | indexes.queries() | titles.queries() | records.queries()


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracles.oracle_sql().items() if k in _all} | lifecycle.oracle_sql() | upkeep.oracle_sql() | recall.oracle_sql() | transfer.oracle_sql() | phrases.oracle_sql() | citations.oracle_sql() | indexes.oracle_sql() | titles.oracle_sql() | records.oracle_sql()
