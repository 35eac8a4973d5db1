"""Queries over titles, file names, cities, commands, glossaries and written dates, in many forms; operator and SQL both parse them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import titles as L
from ..sources import tables as S
from .citations import _form, _form_sql, _planted
from .citations import P as PLANTED
from .oracles import ACTS, LINES, fold, kind, tokens

Query = Callable[[SparkSession, str], DataFrame]
_all: dict[str, Query] = {}
_sql: dict[str, str] = {}

A = f"WITH {ACTS}\n"
KINDS = ["RESOLUCIÓN del consejo", "orden 7", "cONTRATO", "  ", "Acta", "DISPOSICIÓN CONSEJO DIRECTIVO", "nóta", "unknown"]
CODES = ["DISP", "unknown", "", "CS-#n"]
NAMES = ["ACTAS_#n", "notas_#n", "RES_HCS_#n", "DISPCD-CB_61_#y", "DISPCD-CB_#n", "ORDENANZAS", ""]
CITIES = ["VILLA  MARÍA DEL RÍO", "LUJAN", "san luis, BUENOS AIRES", " , ", "de la garma", "CABA,", ""]
COMMANDS = ["/novedades #n concursos", "/Novedades", "/listado  becas\nde grado ", "/listado", "/otro x", "novedades 3", "/ficha #n/#y", "/novedades 1234 x"]
TITLES = ["# Disposición DISPCD-CB : #n / #y", "## RESOLUCION reshcs #n-#y.", "Acta #n", "# Resolución  ", "x # disposicion sec.: #n"]
DAYS = ["#n", "7", "32", "0", "15"]
MONTHS = ["Marzo", "set", "13", "ABR", "4", "xyz", "diciembre"]
YEARS = ["#y", "#z", "999", "2024"]
GLOSSARY = "the → artículo único, that\nthat->norma, artículo único\n\nzzzz → nada\nsin flecha\n → vacío\nWITH → con"


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _all[f.__name__], _sql[f.__name__] = f, sql
        return f

    return add


def _flat(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'))"


def _capital(x: str) -> str:
    return f"upper(substring({x}, 1, 1)) || lower(substring({x}, 2))"


def _genre(x: str) -> str:
    first = f"coalesce(nullif(string_split({_flat(x)}, ' ')[1], ''), 'documento')"
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.GENRES.items())
    return f"CASE translate(lower({first}), 'óíáéú', 'oiaeu') {cases} ELSE {_capital(first)} END"


def _shorten(x: str) -> str:
    t = _flat(x)
    return f"CASE WHEN length({t}) <= 60 THEN {t} ELSE CASE WHEN contains(substring({t}, 1, 60), ' ') THEN regexp_extract(substring({t}, 1, 60), '(?s)^(.*) ', 1) ELSE substring({t}, 1, 60) END || '…' END"


@query(A + f"SELECT i, {_genre(_form_sql(KINDS))} AS genre FROM acts")
def str15_genre(spark, d):
    return S.acts(spark, d).select("i", L.genre(_form(KINDS)).alias("genre"))


@query(f"""WITH {ACTS}, {LINES}, l AS (SELECT doc_id, ord, CASE WHEN ord % 3 = 0 THEN line ELSE heading END AS title, {_genre(_form_sql(KINDS))} AS genre, {_form_sql(CODES)} AS code, number, CASE WHEN i % 3 = 0 THEN '' WHEN i % 3 = 1 THEN 'Anexo II' END AS annex FROM lines JOIN acts ON i = doc_id),
k AS (SELECT *, {kind('title', "doc_id % 2 = 0")} AS part, {_shorten('title')} AS t, array_to_string(list_filter([genre, code, number], lambda x: coalesce(x, '') <> '' AND lower(x) <> 'unknown'), ' ') AS h FROM l),
m AS (SELECT *, upper(substring(h, 1, 1)) || substring(h, 2) AS head FROM k)
SELECT doc_id, ord, CASE WHEN title = '' OR part = 'otra' THEN coalesce(nullif(head, ''), 'documento sin identificar') WHEN part = 'anexo' AND NOT prefix(lower(t), 'anexo') THEN head || ' — ' || coalesce(nullif(annex, ''), 'Anexo') || ', ' || t ELSE head || ' — ' || t END AS citation FROM m""")
def str18_citation(spark, d):
    """The citation of every line as the heading of a part, by its kind of section."""
    a = S.acts(spark, d).select("i", "number", _form(KINDS).alias("kind"), _form(CODES).alias("code"), F.when(F.col("i") % 3 == 0, "").when(F.col("i") % 3 == 1, "Anexo II").alias("annex"))
    ln = S.lines(spark, d).withColumn("title", F.when(F.col("ord") % 3 == 0, F.col("line")).otherwise(F.col("heading"))).join(a, F.col("doc_id") == F.col("i"))
    part = T.section_type(F.col("title"), F.col("doc_id") % 2 == 0)
    return ln.select("doc_id", "ord", L.citation(F.col("kind"), F.col("code"), F.col("number"), F.col("title"), part, F.col("annex")).alias("citation"))


@query(A + f"""SELECT i, CASE WHEN n <> '' AND i % 6 <> 5 THEN array_to_string(list_filter([array_to_string(list_transform(string_split(k, ' '), lambda w: {_capital('w')}), ' '), upper(trim(c)), n || '/' || year], lambda x: x <> ''), ' ') || CASE WHEN i % 2 = 0 THEN ' — Visto' ELSE '' END END AS citation
FROM (SELECT i, year, coalesce(nullif({_flat(_form_sql(KINDS))}, ''), 'Acto') AS k, {_form_sql(CODES)} AS c, CASE WHEN i % 9 = 0 THEN ' ' ELSE split_part(number, '/', 1) END AS nn, trim(nn) AS n FROM acts)""")
def str19_catalogue_citation(spark, d):
    i = F.col("i")
    number, year = F.when(i % 9 == 0, " ").otherwise(F.split_part("number", F.lit("/"), F.lit(1))), F.when(i % 6 != 5, F.col("year").cast("string"))
    return S.acts(spark, d).select("i", L.catalogue_citation(L.flat(_form(KINDS)), _form(CODES), number, year, F.when(i % 2 == 0, "Visto")).alias("citation"))


@query(A + f"SELECT i, CASE WHEN stem = upper(stem) AND NOT regexp_matches(stem, '{L.IDENTITY_NAME}') THEN stem ELSE '' END AS section FROM (SELECT i, regexp_replace({_form_sql(NAMES)}, '_\\d+$', '') AS stem FROM acts)")
def str22_section_of_file(spark, d):
    return S.acts(spark, d).select("i", L.section_of_file(_form(NAMES)).alias("section"))


@query(A + f"""SELECT i, CASE WHEN len(p) = 0 THEN 'unknown' ELSE array_to_string(list_transform(p, lambda x: CASE WHEN upper(x) = 'LUJAN' THEN 'Luján' ELSE array_to_string(list_transform(string_split(x, ' '), lambda w, k: CASE WHEN k > 1 AND lower(w) IN {L.PARTICLES} THEN lower(w) ELSE {_capital('w')} END), ' ') END), ', ') END AS city
FROM (SELECT i, list_filter(list_transform(string_split({_flat(_form_sql(CITIES))}, ','), lambda x: trim(x)), lambda x: x <> '') AS p FROM acts)""")
def str33_city(spark, d):
    return S.acts(spark, d).select("i", L.city(_form(CITIES)).alias("city"))


@query(A + f"""SELECT i, CASE WHEN ok THEN mode END AS mode, CASE WHEN ok THEN days END AS days, CASE WHEN ok THEN CASE WHEN rest = '' THEN '{L.NO_TOPIC}' ELSE rest END END AS question FROM (SELECT *, mode IN {L.COMMANDS} AND (mode = 'novedades' OR rest <> '') AS ok FROM (
SELECT i, mode, days, CASE WHEN days IS NOT NULL THEN trim(regexp_extract(r, '(?s)^(\\d{{1,3}})\\s*(.*)$', 2)) ELSE r END AS rest FROM (SELECT *, CASE WHEN mode = 'novedades' THEN nullif(regexp_extract(r, '(?s)^(\\d{{1,3}})\\s*(.*)$', 1), '')::INT END AS days FROM (
SELECT i, lower(regexp_extract(t, '{L.COMMAND}', 1)) AS mode, trim(regexp_extract(t, '{L.COMMAND}', 2), ' ') AS r FROM (SELECT i, {_form_sql(COMMANDS)} AS t FROM acts)))))""")
def str34_slash_command(spark, d):
    return S.acts(spark, d).select("i", L.command(_form(COMMANDS)).alias("c")).select("i", "c.mode", "c.days", "c.question")


@query(f"""WITH g(ord, l, r) AS (VALUES (1, 'the', ['artículo único', 'that']), (2, 'that', ['norma', 'artículo único']), (3, 'zzzz', ['nada']), (4, 'with', ['con'])),
b AS (SELECT item_id AS q, text, {fold('text')} AS t FROM benchmark), x AS (SELECT q, ord, k, r[k] AS term FROM b JOIN g ON contains(t, l), unnest(range(1, len(r) + 1)) AS u(k) WHERE NOT contains(t, {fold('r[k]')})),
y AS (SELECT q, string_agg(term, ', ' ORDER BY ord, k) AS said FROM (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY q, term ORDER BY ord, k) = 1) GROUP BY q)
SELECT b.q, text || coalesce(' (' || said || ')', '') AS question FROM b LEFT JOIN y USING (q)""")
def str35_glossary(spark, d):
    return S.read(spark, d, "benchmark").select(F.col("item_id").alias("q"), L.expanded(F.col("text"), GLOSSARY).alias("question"))


@query(A + f"""SELECT i, base || CASE WHEN row_number() OVER (PARTITION BY base ORDER BY i) > 1 THEN '__' || substring(id_archivo, 1, 8) ELSE '' END || '.pdf' AS name
FROM (SELECT i, id_archivo, coalesce(nullif(concat_ws('_', nullif(upper(trim(regexp_replace({fold('c')}, '[^a-z0-9]+', '-', 'g'), '-')), ''), CASE WHEN i % 8 <> 6 THEN n END, CASE WHEN i % 8 <> 6 THEN year END), ''), substring(id_archivo, 1, 16)) AS base FROM (SELECT *, {_form_sql(["Disp Cd.", "", "Ñandú—X", "CS"])} AS c, i % 5 AS n FROM acts))""")
def str38_file_name(spark, d):
    """Names by identity; of equal ones all but the first take the file id as well. The first of a name is found by its key alone."""
    i = F.col("i")
    some = lambda c: F.when(i % 8 != 6, c.cast("string"))
    stem = L.file_stem(_form(["Disp Cd.", "", "Ñandú—X", "CS"]), some(i % 5), some(F.col("year")), F.col("id_archivo"))
    a = S.acts(spark, d).select("i", "id_archivo", stem.alias("base"))
    first = a.groupBy("base").agg(F.min("i").alias("first"))
    named = a.join(first, "base")
    return named.select("i", F.concat("base", F.when(i != F.col("first"), F.concat(F.lit("__"), F.substring("id_archivo", 1, 8))).otherwise(""), F.lit(".pdf")).alias("name"))


@query(A + f"SELECT i, CASE WHEN regexp_matches(t, p) THEN CASE WHEN contains(lower(regexp_extract(t, p, 1)), 'res') THEN 'res_' ELSE 'disp_' END || trim(regexp_replace(lower(regexp_extract(t, p, 2)), '[\\s/\\-:.]+', '_', 'g'), '_') END AS slug FROM (SELECT i, {_form_sql(TITLES)} AS t, '(?i)#\\s*(Resolución|Disposición|Resolucion|Disposicion)\\s+(.*)' AS p FROM acts)".replace("regexp_matches(t, p)", "regexp_matches(t, '(?i)#\\s*(Resolución|Disposición|Resolucion|Disposicion)\\s+(.*)')").replace("regexp_extract(t, p,", "regexp_extract(t, '(?i)#\\s*(Resolución|Disposición|Resolucion|Disposicion)\\s+(.*)',"))
def str40_slug(spark, d):
    return S.acts(spark, d).select("i", L.slug(_form(TITLES)).alias("slug"))


_MONTH = "CASE WHEN regexp_full_match(m, '\\d+') THEN lpad(m, 2, '0') ELSE CASE substring(lower(m), 1, 3) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.MONTHS.items()) + " END END"
_YEAR = "CASE length(y) WHEN 2 THEN '20' || y WHEN 4 THEN y END"
_WRITTEN = f"CASE WHEN d::INT BETWEEN 1 AND 31 AND ({_MONTH})::INT BETWEEN 1 AND 12 THEN {_YEAR} || '-' || {_MONTH} || '-' || lpad(d, 2, '0') END"


@query(A + f"SELECT i, {_WRITTEN} AS iso FROM (SELECT i, {_form_sql(DAYS)} AS d, {_form_sql(MONTHS)} AS m, {_form_sql(YEARS)} AS y FROM acts)")
def dat03_written_date(spark, d):
    return S.acts(spark, d).select("i", L.written_date(_form(DAYS), _form(MONTHS), _form(YEARS)).alias("iso"))


_CANDS = "CASE i % 5 WHEN 0 THEN ['2031-01-05', year || '-08-09', year || '-03-02'] WHEN 1 THEN ['2031-05-05', '1999-04-07', '1999-04-02'] WHEN 2 THEN ['2031-05-05', '1999-04-02', '1999-04-01'] WHEN 3 THEN ['2031-05-05', '2030-01-01'] ELSE [] END"


@query(A + f"""SELECT i, coalesce(list_min(list_filter(c, lambda x: substring(x, 1, 4) = year::VARCHAR)), CASE WHEN list_contains(c, '1999-04-01') THEN '1999-04-01' END, list_min(list_filter(c, lambda x: prefix(x, '1999-04'))), c[1], 'unknown') AS issued FROM (SELECT i, year, {_CANDS} AS c FROM acts)""")
def dat04_issue_date(spark, d):
    """Of the dates in a text that of the act's year, of its head, of its head's month, or the first."""
    i, y = F.col("i"), F.col("year").cast("string")
    arr = lambda *x: F.array(*[F.lit(v) if isinstance(v, str) else v for v in x])
    found = F.when(i % 5 == 0, arr("2031-01-05", F.concat(y, F.lit("-08-09")), F.concat(y, F.lit("-03-02")))).when(i % 5 == 1, arr("2031-05-05", "1999-04-07", "1999-04-02")).when(i % 5 == 2, arr("2031-05-05", "1999-04-02", "1999-04-01")).when(i % 5 == 3, arr("2031-05-05", "2030-01-01"))
    head = F.concat(F.lit("# Acta\nLUJÁN, 1º DE ABRIL DE 1999\n"), F.coalesce("text", F.lit("")))
    return S.acts(spark, d).select("i", L.issue_date(found, F.col("number"), head).alias("issued"))


@query(PLANTED + f"""SELECT i, array_to_string(list_sort(list_distinct(list_filter({tokens("said || ' ' || lower(code)")}, lambda t: t IN (SELECT DISTINCT {fold('code')} FROM acts)))), ',') AS codes FROM planted""".replace(f"lambda t: t IN (SELECT DISTINCT {fold('code')} FROM acts)", "lambda t: list_contains(known, t)").replace("FROM planted", f"FROM planted, (SELECT list(DISTINCT {fold('code')}) AS known FROM acts)"))
def str05_known_codes(spark, d):
    """The codes that a text names, of those that the index has."""
    a = S.spread(_planted(spark, d))
    known = S.acts(spark, d).select(T.fold(F.col("code")).alias("t")).distinct()
    said = a.select("i", F.explode(F.array_distinct(T.tokens(F.concat("said", F.lit(" "), F.lower("code"))))).alias("t")).join(known, "t")
    found = said.groupBy("i").agg(F.array_join(F.array_sort(F.collect_list("t")), ",").alias("codes"))
    return S.acts(spark, d).select("i").join(found, "i", "left").select("i", F.coalesce("codes", F.lit("")).alias("codes"))


@query(A + f"SELECT i, t IN {L.ENTITY_TYPES} AND e <> '' AS kept, CASE WHEN t IN {L.ENTITY_TYPES} AND e <> '' THEN e END AS entity, CASE WHEN t IN {L.ENTITY_TYPES} AND e <> '' THEN t END AS type FROM (SELECT i, {_form_sql(['persona', 'tema', 'acto', '', 'organo', 'carrera'])} AS t, CASE WHEN i % 4 = 0 THEN '' ELSE title END AS e FROM acts)")
def ret20_entity_types(spark, d):
    """An entity is followed only with one of the five types; else there is none."""
    t, e = _form(["persona", "tema", "acto", "", "organo", "carrera"]), F.when(F.col("i") % 4 == 0, "").otherwise(F.col("title"))
    kept = t.isin(*L.ENTITY_TYPES) & (e != "")
    return S.acts(spark, d).select("i", kept.alias("kept"), F.when(kept, e).alias("entity"), F.when(kept, t).alias("type"))


@query(A + f"SELECT code, number, max(w) AS weight FROM (SELECT code, number, CASE coalesce({_form_sql(['sistema', 'usuario', 'descartado', 'otro'])}, 'sistema') WHEN 'usuario' THEN 1.0 WHEN 'descartado' THEN 0.0 ELSE 0.5 END::DOUBLE AS w FROM acts) WHERE w > 0 GROUP BY ALL")
def ret19_weights(spark, d):
    """The weight of each act in play by its origin; discarded ones weigh nothing and go."""
    table = F.create_map(*[F.lit(x) for kv in L.WEIGHTS.items() for x in kv])
    w = F.coalesce(F.try_element_at(table, _form(["sistema", "usuario", "descartado", "otro"])), F.lit(L.WEIGHTS["sistema"]))
    return S.acts(spark, d).select("code", "number", w.alias("w")).where("w > 0").groupBy("code", "number").agg(F.max("w").alias("weight"))


def queries() -> dict[str, Query]:
    return dict(_all)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
