"""Queries over hybrid search, contexts and dialogue. Each is declared with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieval as I
from ..operators import search as H
from ..sources import tables as S
from .oracles import ACTS, COS, MESSAGES, bm25, fold, tokens

Query = Callable[[SparkSession, str], DataFrame]
_all: dict[str, Query] = {}
_sql: dict[str, str] = {}

A, M = f"WITH {ACTS}\n", f"WITH {MESSAGES}\n"
WORDS = "array<string>"


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _all[f.__name__], _sql[f.__name__] = f, sql
        return f

    return add


# --- what is asked: identifiers, acts in play and entities of a query follow from its id


def _asked(spark, d):
    q = F.col("item_id")
    none = F.array().cast(WORDS)
    ids = F.when(q % 4 == 1, F.array(F.concat((q % 60 + 1).cast("string"), F.lit("/"), (2024 + q % 3).cast("string")))).otherwise(none)
    codes = F.when((q % 8).isin(1, 2), F.array(F.concat(F.lit("DISP-SRC"), (q % 25).cast("string")))).otherwise(none)
    v = S.read(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    return S.read(spark, d, "benchmark").join(v, q == F.col("vec_id")).select(q.alias("q"), "text", "v", ids.alias("ids"), codes.alias("codes"))


def _named(spark, d):
    """Each query with the act of the document three times its id."""
    b = S.read(spark, d, "benchmark").select(F.col("item_id").alias("q"))
    return b.join(S.acts(spark, d), F.col("i") == F.col("q") * 3)


def _in_play(spark, d):
    return _named(spark, d).where("q % 8 = 3").select("q", "code", "number", F.when(F.col("q") % 16 == 3, 0.5).otherwise(1.0).alias("w"))


def _entities(spark, d):
    pieces = F.slice(F.filter(T.tokens(F.col("title")), lambda t: F.length(t) >= 4), 1, 2)
    return _named(spark, d).where("q % 8 = 4").select("q", pieces.alias("pieces"), F.lit(1.0).alias("w"))


ASKED = """asked AS (SELECT item_id AS q, CASE WHEN item_id % 4 = 1 THEN (item_id % 60 + 1)::VARCHAR || '/' || (2024 + item_id % 3)::VARCHAR END AS id,
  CASE WHEN item_id % 8 IN (1, 2) THEN 'DISP-SRC' || (item_id % 25)::VARCHAR END AS code FROM benchmark JOIN embeddings ON vec_id = item_id)"""
ANCHORS = """x AS (SELECT q, i, bool_or(coalesce(a.code = k.code, false)) AS hit FROM asked k JOIN acts a ON number = id GROUP BY q, i),
anc AS (SELECT q, i FROM (SELECT *, bool_or(hit) OVER (PARTITION BY q) AS known FROM x) WHERE hit OR NOT known UNION ALL SELECT q, i FROM asked k JOIN acts a ON a.code = k.code WHERE id IS NULL)"""
PLAY = "play AS (SELECT item_id AS q, code, number, CASE WHEN item_id % 16 = 3 THEN 0.5 ELSE 1.0 END::DOUBLE AS w FROM benchmark JOIN acts ON i = item_id * 3 WHERE item_id % 8 = 3)"
ENTITIES = f"ent AS (SELECT item_id AS q, list_filter({tokens('title')}, lambda t: length(t) >= 4)[:2] AS p, 1.0::DOUBLE AS w FROM benchmark JOIN acts ON i = item_id * 3 WHERE item_id % 8 = 4)"
SAID = f"said AS (SELECT i, {fold(chr(39).join(['title || ', ' ', ' || text']))} AS s FROM acts)"
LOOSE = "coalesce(len(p) > 0 AND len(list_filter(p, lambda y: contains(s, y))) >= least(2, len(p)), false)"
STRICT = "len(p) > 0 AND len(list_filter(p, lambda y: NOT contains(s, y))) = 0 AND (len(p) = 1 OR p[1] = p[2] OR regexp_matches(s, '(?s)' || p[1] || '.{0,' || (40 - length(p[1])) || '}' || p[2] || '|' || p[2] || '.{0,' || (40 - length(p[2])) || '}' || p[1]))"
FREE = "(t.q NOT IN (SELECT q FROM anc) OR EXISTS (SELECT 1 FROM anc WHERE anc.q = t.q AND anc.i = t.i))"
BONUS = """pa AS (SELECT q, code, number, a.i, w FROM play JOIN acts a USING (code, number)),
hs AS (SELECT pa.*, bool_or(f.total IS NOT NULL) OVER (PARTITION BY q, code, number) AS scored, row_number() OVER (PARTITION BY q, code, number ORDER BY i) AS rn FROM pa LEFT JOIN fu f USING (q, i)),
tb AS (SELECT q, i, total + coalesce(w, 0) / 61::DOUBLE AS total FROM fu LEFT JOIN pa USING (q, i) UNION ALL SELECT q, i, w / 61::DOUBLE FROM hs WHERE NOT scored AND rn <= 2)"""


@query(A + f", {ASKED}, {ANCHORS} SELECT q, i FROM anc WHERE i % 2 = 0")
def ret06_anchoring(spark, d):
    """What the queries that name an act are restricted to, within a filter."""
    c = S.acts(spark, d).select("i", "number", "code")
    return H.anchored(c, _asked(spark, d), c.where("i % 2 = 0"))


@query(A + f", {ASKED} SELECT q, i FROM asked k JOIN acts a ON a.code = k.code WHERE id IS NULL")
def ret07_codes_only(spark, d):
    asked = _asked(spark, d).where(F.size("ids") == 0)
    return H.anchored(S.acts(spark, d), asked)


@query(A + f", {PLAY}, fu AS (SELECT q, i, 1 / (60 + i)::DOUBLE AS total FROM play JOIN acts a ON i % 10 = q % 10), {BONUS} SELECT q, i, round(total, 9) AS total FROM tb")
def ret09_act_bonus(spark, d):
    acts, play = S.acts(spark, d).select("i", "code", "number"), _in_play(spark, d)
    scored = play.join(acts.select("i"), F.col("i") % 10 == F.col("q") % 10).select("q", "i", (1.0 / (60 + F.col("i"))).alias("total"))
    return H.act_bonus(scored, play, acts).select("q", "i", F.round("total", 9).alias("total"))


@query(A + f", {ENTITIES}, {SAID} SELECT q, i, {LOOSE} AS loose, round(1 / (60 + i)::DOUBLE + CASE WHEN {LOOSE} THEN w / 61 ELSE 0 END, 9) AS total FROM ent JOIN said ON i % 10 = q % 10")
def ret10_entity_bonus(spark, d):
    acts, ent = S.acts(spark, d).select("i", "title", "text"), _entities(spark, d)
    scored = ent.select("q").join(acts.select("i"), F.col("i") % 10 == F.col("q") % 10).select("q", "i", (1.0 / (60 + F.col("i"))).alias("total"))
    return H.entity_bonus(scored, ent, acts).select("q", "i", "loose", F.round("total", 9).alias("total"))


@query(A + f""", {ENTITIES}, {SAID}, base AS (SELECT q, i, row_number() OVER (PARTITION BY q ORDER BY i) AS rank FROM ent JOIN acts ON i % 50 = (q + 1) % 50 QUALIFY rank <= 4),
  tp AS (SELECT q, i, rank, {LOOSE} AS loose FROM base JOIN ent USING (q) JOIN said USING (i)), mt AS (SELECT q, bool_or(loose) AS met, max(rank) AS last FROM tp GROUP BY q),
  nw AS (SELECT q, i, least(last + 1, 4) AS rank FROM ent JOIN mt USING (q) JOIN said ON {STRICT} WHERE NOT met QUALIFY row_number() OVER (PARTITION BY q ORDER BY i DESC) = 1)
  SELECT tp.q, tp.i, tp.rank::INT AS rank, loose FROM tp LEFT JOIN nw ON tp.q = nw.q WHERE nw.rank IS NULL OR tp.rank < nw.rank UNION ALL SELECT q, i, rank::INT, true FROM nw""")
def ret11_guarantee(spark, d):
    """Four rows a query, and a strict mention in the last place where none of them names the entity; the score is the id."""
    acts, ent = S.acts(spark, d).select("i", "title", "text"), _entities(spark, d)
    base = ent.select("q").join(acts.select("i"), F.col("i") % 50 == (F.col("q") + 1) % 50).select("q", "i", (-F.col("i").cast("double")).alias("total"))
    top = H.best(H.entity_bonus(base, ent.withColumn("w", F.lit(0.0)), acts), 4)
    return H.guaranteed(top, ent, acts, lambda pairs: pairs.distinct().withColumn("score", F.col("i")), 4).select("q", "i", "rank", "loose")


SEARCH = f"""WITH {ACTS}, {bm25(60)}, {ASKED}, {ANCHORS}, {PLAY}, {ENTITIES}, {SAID},
cs AS (SELECT a.vec_id AS q, b.vec_id AS i, {COS} AS score FROM embeddings a JOIN benchmark ON a.vec_id = item_id, embeddings b),
den AS (SELECT q, i, row_number() OVER (PARTITION BY q ORDER BY score DESC, i) AS rank FROM cs t WHERE {FREE} QUALIFY rank <= 60),
lx AS (SELECT q, i, row_number() OVER (PARTITION BY q ORDER BY score DESC, i) AS rank FROM sc t WHERE {FREE} QUALIFY rank <= 60),
fu AS (SELECT q, i, round(coalesce(1 / (60 + d.rank)::DOUBLE, 0) + coalesce(1 / (60 + l.rank)::DOUBLE, 0), 9) AS total FROM den d FULL JOIN lx l USING (q, i)), {BONUS},
te AS (SELECT q, i, {LOOSE} AS loose, total + CASE WHEN {LOOSE} THEN w / 61 ELSE 0 END AS total FROM tb LEFT JOIN ent USING (q) LEFT JOIN said USING (i)),
tp AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(total, 9) DESC, i) AS rank FROM te QUALIFY rank <= 8),
mt AS (SELECT q, bool_or(loose) AS met, max(rank) AS last FROM tp GROUP BY q),
nw AS (SELECT q, i, least(last + 1, 8) AS rank, w / 61 AS total FROM ent JOIN mt USING (q) JOIN said ON {STRICT} JOIN cs USING (q, i) WHERE NOT met QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, i) = 1)
SELECT tp.q, tp.i, tp.rank::INT AS rank, round(tp.total, 9) AS total, loose FROM tp LEFT JOIN nw ON tp.q = nw.q WHERE nw.rank IS NULL OR tp.rank < nw.rank
UNION ALL SELECT q, i, rank::INT, round(total, 9), true FROM nw"""


@query(SEARCH)
def ret12_search(spark, d):
    """The whole hybrid search for all queries: anchoring, both rankings, fusion, bonuses, guarantee."""
    v = S.read(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").alias("v"))
    return H.search(S.acts(spark, d).select("i", "code", "number", "title", "text"), v, _asked(spark, d), _in_play(spark, d), _entities(spark, d))


@query(A + """, r AS (SELECT number, i, '[' || code || ' ' || number || ']' || chr(10) || title AS h, text FROM acts QUALIFY row_number() OVER (PARTITION BY number ORDER BY i) <= 5),
b AS (SELECT *, length(text) AS n, greatest(0, 9000 - sum(length(h) + 1) OVER w) AS room, count(*) OVER w AS m FROM r WINDOW w AS (PARTITION BY number)),
g AS (SELECT *, least(n, room // m) AS given FROM b),
l AS (SELECT *, room - sum(given) OVER w - coalesce(sum(n - given) OVER (PARTITION BY number ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM g WINDOW w AS (PARTITION BY number)),
k AS (SELECT *, (given + greatest(0, least(n - given, rest)))::BIGINT AS take, substring(text, 1, (given + greatest(0, least(n - given, rest)))::BIGINT) AS head FROM l),
c AS (SELECT *, length(head) - instr(reverse(head), ' ') AS space FROM k)
SELECT number, string_agg(h || chr(10) || CASE WHEN n <= take THEN text ELSE CASE WHEN contains(head, ' ') AND space > take // 2 THEN substring(text, 1, space) ELSE head END || ' […]' END, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY i) AS context FROM c GROUP BY number""")
def ret13_context(spark, d):
    """The context of the first five acts of each number, within 9,000 characters."""
    a = S.acts(spark, d).withColumn("rn", F.row_number().over(Window.partitionBy("number").orderBy("i"))).where("rn <= 5")
    head = F.concat(F.lit("["), "code", F.lit(" "), "number", F.lit("]\n"), "title")
    return H.context(a.select("number", "i", head.alias("header"), "text"), "number", "i")


PLAIN = lambda x: f"regexp_extract_all({fold(x)}, '[a-z0-9/-]+')"


@query(f"""WITH tok AS (SELECT doc_id AS i, {PLAIN("text")} AS t FROM documents), len AS (SELECT i, len(t) AS len FROM tok), st AS (SELECT count(*) AS n, avg(len) AS avg FROM len),
post AS (SELECT token, i, count(*) AS tf FROM (SELECT i, unnest(t) AS token FROM tok) GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM post GROUP BY token),
qt AS (SELECT q, token, count(*) AS qtf FROM (SELECT item_id AS q, unnest({PLAIN("text")}) AS token FROM benchmark) GROUP BY ALL)
SELECT q, i, round(sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg))), 6) AS score,
  row_number() OVER (PARTITION BY q ORDER BY score DESC, i)::INT AS rank FROM qt JOIN df USING (token) JOIN post USING (token) JOIN len USING (i), st GROUP BY q, i QUALIFY rank <= 400""")
def ret03_plain_index(spark, d):
    """The plain full-text index: other tokens and another saturation, 400 rows a query."""
    chunks = S.spread(S.read(spark, d, "documents").select(F.col("doc_id").alias("i"), "text"))
    asked = S.read(spark, d, "benchmark").select(F.col("item_id").alias("q"), "text")
    return I.top(I.bm25(chunks, asked, k1=1.2, tokenize=I.plain_tokens), 400)


MODES = ("answer", "list", "news", "compare", "dossier", "summary")


@query(M + f"""SELECT id, [{', '.join(f"'{x}'" for x in MODES)}][(id % 6 + 1)::INT] AS mode, CASE WHEN id % 6 IN (1, 2, 3) THEN greatest(16, id % 31) WHEN id % 6 IN (4, 5) THEN greatest(12, id % 31) ELSE id % 31 END AS k,
  CASE WHEN id % 6 = 2 THEN DATE '2025-12-31' - greatest(7, least(365, CASE WHEN id % 5 = 0 THEN 45 ELSE id % 500 END))::INT END AS since FROM messages WHERE role = 'user'""")
def ret14_modes(spark, d):
    """The number of rows and the first day that an output mode asks for."""
    i = F.col("id")
    m = S.messages(spark, d).where("role = 'user'").withColumn("mode", F.element_at(F.array(*map(F.lit, MODES)), (i % 6 + 1).cast("int")))
    least = F.when(F.col("mode").isin("list", "news", "compare"), 16).when(F.col("mode").isin("dossier", "summary"), 12).otherwise(0)
    days = F.greatest(F.lit(7), F.least(F.lit(365), F.coalesce(F.when(i % 5 != 0, i % 500), F.lit(45)))).cast("int")
    return m.select("id", "mode", F.greatest(i % 31, least).alias("k"), F.when(F.col("mode") == "news", F.date_sub(F.lit("2025-12-31").cast("date"), days)).alias("since"))


@query(M + "SELECT conv_id, max(substring(text, 1, 200)) AS entity, least(60, count(*)) AS acts, count(*) FILTER (role = 'user') AS own FROM messages GROUP BY conv_id")
def ret17_state(spark, d):
    """Dialogue state within its bounds: texts of 200 characters, at most 60 acts, an origin by default."""
    act = F.struct(F.col("id"), F.coalesce(F.when(F.col("role") == "user", "usuario"), F.lit("sistema")).alias("origin"))
    s = S.messages(spark, d).groupBy("conv_id").agg(F.max(F.substring("text", 1, 200)).alias("entity"), F.array_sort(F.collect_list(act)).alias("all"))
    return s.select("conv_id", "entity", F.size(F.slice("all", 1, 60)).cast("long").alias("acts"), F.size(F.filter("all", lambda a: a.origin == "usuario")).cast("long").alias("own"))


@query(M + """, e AS (SELECT conv_id, id, role, (id % 7)::VARCHAR AS act, CASE WHEN role = 'user' THEN CASE WHEN id % 3 = 0 THEN 'descartado' ELSE 'usuario' END ELSE 'sistema' END AS origin, max(id) OVER (PARTITION BY conv_id) AS last FROM messages),
  own AS (SELECT conv_id, act, arg_max(origin, id) AS origin FROM e WHERE origin <> 'sistema' GROUP BY ALL),
  s AS (SELECT conv_id, act, origin FROM own UNION ALL SELECT conv_id, act, origin FROM e WHERE id = last AND origin = 'sistema' AND NOT EXISTS (SELECT 1 FROM own WHERE own.conv_id = e.conv_id AND own.act = e.act))
  SELECT conv_id, string_agg(act || ':' || origin, ',' ORDER BY act) AS state, sum(CASE origin WHEN 'sistema' THEN 0.5 WHEN 'usuario' THEN 1 ELSE 0 END)::DOUBLE AS weight FROM s GROUP BY conv_id""")
def ret18_state_merge(spark, d):
    """What the user decided stays, discarded acts too; the system's acts last one turn and never replace a decision."""
    i = F.col("id")
    origin = F.when(F.col("role") == "user", F.when(i % 3 == 0, "descartado").otherwise("usuario")).otherwise("sistema")
    m = S.messages(spark, d).select("conv_id", "id", (i % 7).cast("string").alias("act"), origin.alias("origin"))
    own = m.where("origin <> 'sistema'").groupBy("conv_id", "act").agg(F.max_by("origin", "id").alias("origin"))
    last = m.groupBy("conv_id").agg(F.max_by(F.struct("act", "origin"), "id").alias("x")).select("conv_id", "x.act", "x.origin").where("origin = 'sistema'")
    state = own.unionByName(last.join(own, ["conv_id", "act"], "left_anti"))
    weight = F.when(F.col("origin") == "sistema", 0.5).when(F.col("origin") == "usuario", 1.0).otherwise(0.0)
    rows = F.array_sort(F.collect_list(F.struct("act", "origin")))
    return state.groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda r: F.concat(r.act, F.lit(":"), r.origin)), ",").alias("state"), F.sum(weight).alias("weight"))


@query(A + f"SELECT number, contains(s, 'the') AND contains(s, 'that') AS right FROM (SELECT number, string_agg({fold('text')}, ' ' ORDER BY i) AS s FROM acts GROUP BY number)")
def ret22_attribution(spark, d):
    """Whether the cited texts of a number hold all names that were asked for, each in any of them."""
    t = T.fold(F.col("text"))
    held = [F.coalesce(F.max(F.contains(t, F.lit(n))), F.lit(False)) for n in ("the", "that")]
    return S.acts(spark, d).groupBy("number").agg((held[0] & held[1]).alias("right"))


@query(A + "SELECT i, ['qué dice ', 'contenido de ', 'quién firma ', 'fecha de '][((rn - 1) % 4 + 1)::INT] || code || ' ' || number AS question FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY i) AS rn FROM acts)")
def ret23_templates(spark, d):
    """Questions for evaluation: four templates in turn within a section."""
    forms = F.array(*map(F.lit, ("qué dice ", "contenido de ", "quién firma ", "fecha de ")))
    a = S.acts(spark, d).select("i", "section", "code", "number").withColumn("rn", F.row_number().over(Window.partitionBy("section").orderBy("i")))
    return a.select("i", F.concat(F.element_at(forms, ((F.col("rn") - 1) % 4 + 1).cast("int")), "code", F.lit(" "), "number").alias("question"))


def queries() -> dict[str, Query]:
    return dict(_all)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
