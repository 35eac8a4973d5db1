"""Queries over citations, names, entities and marked-up bodies. Sentences of many forms are put in front of whole texts; operator and SQL both parse them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import citations as C
from ..operators import relational as R
from ..operators.signers import consolidated
from ..sources import tables as S
from .oracles import ACTS, fold

Query = Callable[[SparkSession, str], DataFrame]
_all: dict[str, Query] = {}
_sql: dict[str, str] = {}

FORMS = [
    "según DISP : 00#n / #y, art. 3", "ver RESHCS #n/#z y RES-CB #n / #y", "Se cita DISPCD-CB: #n/98. Otra: dispcd-cb : #n/#y.", "pedido de Ana Ruiz ante el Consejo Superior por Ley 24.521", "El alumno Juan Carlos Gómez López cursa Materia (20134) Análisis Matemático; ver EXP-LUJ N°: 0916/2024",
    "Orden de Compra N° 305/#z y EXP-LUJ: #n/#y", "Licenciatura en Trabajo Social, Profesorado en Física; Resolución RESHCS-LUJ: #n-#z", "sin actos ni nombres", "firma María Pérez. Ana Ruiz no. CS 33/2026 y CS 033/2026", "ACTDB-LUJ #n/#y; disp 4/2020; RESOL-12/24", "El Departamento de Ciencias Sociales y Luis Alberto Sosa", "",
]
NUMBERS = ["DISPCD-CB : #n / #y", " DR - #n / #z ", "disp #n/#y", "DR-#n/#y", "#n/#y", "X9 : 7 / 2024 bis", "Ñ-1 : 5/99", ""]
ISSUERS = ["Por ello, EL RECTOR DE LA UNIVERSIDAD NACIONAL DE LUJAN R E S U E L V E :", "EL  CONSEJO DIRECTIVO DEL DEPARTAMENTO DE CIENCIAS SOCIALES DISPONE", "La Directora General de Personal de la Universidad Nacional de Luján", "el secretario académico universidad nacional de luján, sede central", "Subsecretario de Extensión de la", "H. CONSEJO SUPERIOR"]
ROLES = ["  rector ", "- Secretaria   Académica.", "unknown", "ver anexo del director", "vecino", "Jefe de división: ", "", "coordinadora de la carrera"]
BODIES = ["# Acta\n## Visto\ntexto\n### Artículo 1\n", "membrete\nUniversidad Nacional de Luján Departamento de Ciencias\n## EL CONSEJO DIRECTIVO\n### ARTICULO 2\nRegístrese, comuníquese\n## Firmas\n", "", "## Parte resolutiva\n## Parte dispositiva\n### Hoja de firmas\nno tendrá validez sin autenticación\nDISP 4/2020 y Disp-5/21\n## Anexo I\n"]


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _all[f.__name__], _sql[f.__name__] = f, sql
        return f

    return add


def _form(forms: list[str]):
    """The form of a row: the forms in turn, #n, #y and #z for the number and year of the act and the year's last two digits."""
    i = F.col("i")
    text = F.element_at(F.array(*map(F.lit, forms)), (i % len(forms) + 1).cast("int"))
    year = F.col("year").cast("string")
    for mark, value in (("#n", (i % 50 + 1).cast("string")), ("#y", year), ("#z", F.substring(year, 3, 2))):
        text = F.replace(text, F.lit(mark), value)
    return text


def _form_sql(forms: list[str]) -> str:
    listed = ", ".join("'" + f.replace("\n", "' || chr(10) || '") + "'" for f in forms)
    return f"replace(replace(replace([{listed}][(i % {len(forms)} + 1)::INT], '#n', (i % 50 + 1)::VARCHAR), '#y', year::VARCHAR), '#z', substring(year::VARCHAR, 3, 2))"


def _planted(spark, d, forms=FORMS):
    """(acts, said): the sentence in front of the whole text."""
    return S.acts(spark, d).withColumn("said", F.concat(_form(forms), F.lit("\n"), F.coalesce("text", F.lit(""))))


P = f"WITH {ACTS}, planted AS (SELECT *, {_form_sql(FORMS)} || chr(10) || coalesce(text, '') AS said FROM acts)\n"
A = f"WITH {ACTS}\n"


def _lists(parts: str, x: str = "x") -> str:
    """The distinct elements of a list in their order."""
    return f"list_filter({parts}, lambda v, k: list_position({parts}, v) = k)"


def _acts_sql(text: str) -> str:
    at = lambda k: f"regexp_extract(x, '{C.ACT}', {k})"
    y = at(3)
    return _lists(f"list_transform(regexp_extract_all({text}, '{C.ACT}', 0), lambda x: {at(1)} || ' ' || regexp_replace({at(2)}, '^0+', '') || '/' || CASE WHEN length({y}) = 2 THEN CASE WHEN {y} > '50' THEN '19' ELSE '20' END || {y} ELSE {y} END)")


@query(P + f"SELECT i, array_to_string({_acts_sql('said')}, ',') AS acts FROM planted")
def str07_cited_for_checks(spark, d):
    return _planted(spark, d).select("i", F.array_join(C.acts_of(F.col("said")), ",").alias("acts"))


@query(P + "SELECT i, array_to_string(" + _lists(f"list_transform(regexp_extract_all(said, '{C.STATE_ACT}', 0), lambda x: regexp_extract(x, '{C.STATE_ACT}', 1) || ' ' || regexp_replace(regexp_extract(x, '{C.STATE_ACT}', 2), '\\s', '', 'g'))") + ", ',') AS cited FROM planted")
def str06_cited_acts(spark, d):
    return _planted(spark, d).select("i", F.array_join(C.state_acts(F.col("said")), ",").alias("cited"))


@query(P + f"SELECT i, len(list_distinct(regexp_extract_all(said, '{C.NORM}', 1)))::INT AS n FROM planted")
def str08_norm_families(spark, d):
    return _planted(spark, d).select("i", F.size(C.norm_families(F.col("said"))).alias("n"))


# RE2 has no lookbehind: white space that follows the end of a sentence is marked first
_MARKED = "regexp_replace(regexp_replace(' ' || said, '([.¿¡\\n])[ \\t]', '\\1§', 'g'), '([.¿¡])\\n', '\\1§', 'g')"
_OPEN = ", ".join(f"'{x}'" for x in sorted({x.translate(str.maketrans("áéíóúñ", "aeioun")) for x in C.INSTITUTIONS}))


@query(P + f"SELECT i, array_to_string(list_filter(list_transform(regexp_extract_all({_MARKED}, '\\s({C.NAME})', 1), lambda n: regexp_replace(trim(n), '\\s+', ' ', 'g')), lambda n: len(list_filter(string_split(n, ' '), lambda w: {fold('w')} IN ({_OPEN}))) = 0), ',') AS names FROM planted")
def str09_person_names(spark, d):
    return _planted(spark, d).select("i", F.array_join(C.person_names(F.col("said")), ",").alias("names"))


_NUM = _form_sql(NUMBERS)
_PART = lambda k: f"regexp_extract(f, '{C.PORTAL_NUMBER}', {k})"


@query(A + f", n AS (SELECT i, {_NUM} AS f FROM acts) SELECT i, CASE WHEN ok THEN upper({_PART(1)}) END AS code, CASE WHEN ok THEN {_PART(2)} || '/' || {_PART(3)} END AS number, CASE WHEN ok THEN CASE WHEN length({_PART(3)}) = 4 THEN {_PART(3)} ELSE '20' || {_PART(3)} END::INT END AS year FROM (SELECT *, regexp_matches(f, '{C.PORTAL_NUMBER}') AS ok FROM n)")
def str13_split_number(spark, d):
    """A portal's number with the separator as it comes; two digits of a year mean 20yy."""
    return S.acts(spark, d).select("i", C.split_number(_form(NUMBERS)).alias("s")).select("i", "s.code", "s.number", "s.year")


@query(A + f", n AS (SELECT i, {_NUM} AS f FROM acts) SELECT i, nullif(regexp_extract(f, ':\\s*0*(\\d+)\\s*/\\s*(\\d{{4}})', 1), '')::BIGINT AS n, nullif(regexp_extract(f, ':\\s*0*(\\d+)\\s*/\\s*(\\d{{4}})', 2), '')::BIGINT AS year FROM n")
def str12_act_key(spark, d):
    """The number and year behind a colon, zeros in front gone; nulls in other forms."""
    part = lambda k: F.nullif(F.regexp_extract(_form(NUMBERS), r":\s*0*(\d+)\s*/\s*(\d{4})", k), F.lit("")).cast("long")
    return S.acts(spark, d).select("i", part(1).alias("n"), part(2).alias("year"))


_ISSUER = f"trim(regexp_replace({_form_sql(ISSUERS)}, '\\s+', ' ', 'g'))"
for _p, _to in C.ISSUER_STEPS:
    _ISSUER = f"regexp_replace({_ISSUER}, '{_p}', '{_to}', 'g')"


@query(A + f"SELECT i, CASE WHEN regexp_matches(e, '(?i)^RECTOR(?:A)?\\s*(?:DE\\s+LA\\s+UNIVERSIDAD)?') THEN CASE WHEN i % 2 = 0 THEN 'RESOLUCION RECTOR' ELSE 'DISPOSICION RECTOR' END ELSE upper(trim(regexp_replace(e, '\\s+', ' ', 'g'))) END AS issuer FROM (SELECT i, {_ISSUER} AS e FROM acts)")
def str30_issuer(spark, d):
    kind = F.when(F.col("i") % 2 == 0, "resolucion").otherwise("disposicion")
    return S.acts(spark, d).select("i", C.issuer(_form(ISSUERS), kind).alias("issuer"))


_ROLE = f"regexp_replace(regexp_replace({_form_sql(ROLES)}, '\\s+', ' ', 'g'), '^[ .:\\-\\t]+|[ .:\\-\\t]+$', '', 'g')"


@query(A + f"SELECT i, role, role <> '' AND lower(role) <> 'unknown' AND length(role) <= 180 AND NOT regexp_matches(role, '(?i){C.NO_ROLE}') AND regexp_matches(role, '(?i)\\b{C.ROLE_WORDS}\\b') AS valid FROM (SELECT i, upper(substring(r, 1, 1)) || substring(r, 2) AS role FROM (SELECT i, {_ROLE} AS r FROM acts))")
def str31_roles(spark, d):
    return S.acts(spark, d).select("i", C.clean_role(_form(ROLES)).alias("role"), C.valid_role(_form(ROLES)).alias("valid"))


def _entity_sql(family: str) -> str:
    return "array_to_string(" + _lists(f"list_transform(regexp_extract_all(said, '{C.ENTITIES[family]}', 1), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g')))") + f", '|') AS \"{family}\""


@query(P + f"SELECT i, {', '.join(map(_entity_sql, C.ENTITIES))} FROM planted")
def str32_entities(spark, d):
    return _planted(spark, d).select("i", *[F.array_join(C.entities(F.col("said"), f), "|").alias(f) for f in C.ENTITIES])


# --- answers and their sources


def _answers(spark, d):
    """Assistant turns with a planted answer, and the citations and texts retrieved for it: those of two acts."""
    a = _planted(spark, d).select("i", "said", "section", F.concat_ws(" ", F.lit("Disposición"), F.regexp_replace("code", "-", ""), "number").alias("cita"), "number")
    near = S.acts(spark, d).select((F.col("i") - 1).alias("k"), F.concat_ws(" ", F.lit("RESHCS"), "number", F.lit("— Artículo 2")).alias("other"), F.concat(F.lit("véase DISP "), F.regexp_replace("number", "/", " / ")).alias("body"))
    return a.join(near, F.col("i") == F.col("k"), "left").drop("k")


_ANSWERS = P + """, answers AS (SELECT a.i, a.said, a.section, a.number, 'Disposición ' || replace(a.code, '-', '') || ' ' || a.number AS cita, 'RESHCS ' || b.number || ' — Artículo 2' AS other, 'véase DISP ' || replace(b.number, '/', ' / ') AS body
  FROM planted a LEFT JOIN acts b ON b.i = a.i + 1)"""
_LOOSE = f"""checked AS (SELECT i, section, {_acts_sql('said')} AS cited, {_acts_sql("coalesce(cita, '')")} || {_acts_sql("coalesce(other, '')")} || {_acts_sql("coalesce(body, '')")} AS named FROM answers)"""


@query(f"{_ANSWERS}, {_LOOSE} SELECT i, array_to_string(list_filter(cited, lambda x: NOT list_contains(named, x)), ',') AS loose FROM checked")
def ret21_grounding(spark, d):
    """Acts that an answer cites and no retrieved citation or text names."""
    a = _answers(spark, d)
    return a.select("i", F.array_join(C.ungrounded(F.col("said"), F.array("cita", "other"), F.array("body")), ",").alias("loose"))


@query(f"""{_ANSWERS}, {_LOOSE}, s AS (SELECT section, len(cited) AS cited, len(list_filter(cited, lambda x: NOT list_contains(named, x))) AS loose FROM checked)
SELECT section, count(*) AS answers, count(*) FILTER (cited > 0) AS citing, sum(cited)::BIGINT AS cited, sum(loose)::BIGINT AS loose, count(*) FILTER (loose > 0) AS with_loose FROM s GROUP BY section""")
def agg29_fidelity(spark, d):
    """Answers, those that cite, acts cited, acts that no source names, and answers with such acts."""
    a = _answers(spark, d).select("section", F.size(C.acts_of(F.col("said"))).cast("long").alias("cited"), F.size(C.ungrounded(F.col("said"), F.array("cita", "other"), F.array("body"))).cast("long").alias("loose"))
    return a.groupBy("section").agg(F.count(F.lit(1)).alias("answers"), F.count_if(F.col("cited") > 0).alias("citing"), F.sum("cited").alias("cited"), F.sum("loose").alias("loose"), F.count_if(F.col("loose") > 0).alias("with_loose"))


_CITED = "CASE i % 6 WHEN 0 THEN 'DISPOSICION A ' || number || ' — articulo 1' WHEN 1 THEN 'Acto ' || replace(number, '/', ' / ') || ' — Anexo I' WHEN 2 THEN 'Acto ' || number || ' — Visto' WHEN 3 THEN 'Nota' WHEN 4 THEN 'una Nota interna del área' ELSE 'Ley 1/1900' END"
_SOURCES = "['Resolución B ' || (i % 9)::VARCHAR || '/1999', 'Disposición A ' || number || ' — Artículo 1', 'Disposición A ' || number || ' — Anexo I', 'Nota interna']"


@query(A + f""", c AS (SELECT i, {_CITED} AS cita, {_SOURCES} AS src FROM acts),
f AS (SELECT *, {fold('cita')} AS t, list_transform(src, lambda s: {fold('s')}) AS p, CASE WHEN regexp_matches(cita, '{C.NUMBER}') THEN regexp_extract(cita, '{C.NUMBER}', 1) || '/' || regexp_extract(cita, '{C.NUMBER}', 2) END AS key, {fold("trim(split_part(cita, '—', 2))")} AS sec FROM c),
n AS (SELECT *, list_filter(range(1, len(src) + 1), lambda k: key IS NOT NULL AND contains(replace(src[k], ' ', ''), key)) AS num, list_filter(range(1, len(src) + 1), lambda k: contains(p[k], t) OR contains(t, p[k])) AS mut FROM f),
m AS (SELECT *, list_filter(num, lambda k: sec <> '' AND {fold("trim(split_part(src[k], '—', 2))")} = sec) AS same FROM n)
SELECT i, (coalesce(CASE WHEN list_contains(p, t) THEN list_position(p, t) WHEN len(num) > 1 AND len(same) > 0 THEN same[1] WHEN len(num) > 0 THEN num[1] ELSE mut[1] END, 0) - 1)::INT AS source FROM m""")
def join18_citation_source(spark, d):
    """The source that a citation means, among the few of one answer."""
    a = S.acts(spark, d).select("i", F.expr(_CITED.replace("::VARCHAR", "")).alias("cita"), F.expr("array" + _SOURCES.replace("[", "(").replace("]", ")").replace("(i % 9)::VARCHAR", "cast(i % 9 as string)")).alias("src"))
    return a.select("i", C.resolve(F.col("cita"), F.col("src")).alias("source"))


# --- audits of bodies


def _bodies(spark, d):
    return S.acts(spark, d).select("i", F.concat(_form(BODIES), F.coalesce("text", F.lit(""))).alias("body"))


def _chunk_sql() -> str:
    n = lambda p: f"len(regexp_extract_all(body, '{p}'))"
    parts = f"string_split(regexp_replace(body, '{C.HEADER}', chr(1) || '\\1', 'g'), chr(1))"
    noise = ", ".join(f"{n(p)}::INT AS {k}" for k, p in C.BODY_NOISE.items())
    levels = ", ".join(f"{n('(?m)^#{%d}[ \\t]+\\S.*$' % k)}::INT AS h{k}" for k in (1, 2, 3))
    return f"""WITH {ACTS}, b AS (SELECT i, {_form_sql(BODIES)} || coalesce(text, '') AS body FROM acts),
m AS (SELECT i, {n(C.HEADER)}::INT AS headers, {levels}, {n(C.ARTICLE)}::INT AS articles, length(regexp_replace({parts}[1], '^\\s+|\\s+$', '', 'g'))::INT AS orphan,
  coalesce(list_max(list_transform({parts}[2:], lambda x: length(x))), 0)::INT AS largest, {n(C.FORMULA)}::INT AS formulas, {noise}, len(list_distinct(regexp_extract_all(body, '{C.NORM}', 1)))::INT AS families FROM b)"""


@query(_chunk_sql() + " SELECT * FROM m")
def agg14_chunkability(spark, d):
    return _bodies(spark, d).select("i", *C.chunkability(F.col("body")))


@query(_chunk_sql() + """ SELECT count(*) AS n, count(*) FILTER (headers = 0) AS no_headers, count(*) FILTER (articles = 0) AS no_articles, sum(articles)::BIGINT AS articles, median(headers)::DOUBLE AS median_headers, min(headers) AS min_headers, max(headers) AS max_headers,
median(orphan)::DOUBLE AS median_orphan, count(*) FILTER (orphan > 300) AS orphans, median(largest)::DOUBLE AS median_section, count(*) FILTER (largest > 4000) AS giants FROM m""")
def agg15_audit(spark, d):
    """The roll-up of all documents' metrics, with exact medians."""
    a = agg14_chunkability(spark, d)
    mid = lambda c: F.expr(f"percentile({c}, 0.5)")
    return a.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("headers") == 0).alias("no_headers"), F.count_if(F.col("articles") == 0).alias("no_articles"), F.sum("articles").alias("articles"), mid("headers").alias("median_headers"), F.min("headers").alias("min_headers"), F.max("headers").alias("max_headers"),
        mid("orphan").alias("median_orphan"), F.count_if(F.col("orphan") > 300).alias("orphans"), mid("largest").alias("median_section"), F.count_if(F.col("largest") > 4000).alias("giants"),
    )


VARIANTS = {"parte": r"(?i)^parte (resolutiva|dispositiva)", "firmas": r"(?i)firmas", "anexo": r"(?i)^anexo"}


@query(f"""WITH {ACTS}, b AS (SELECT {_form_sql(BODIES)} || coalesce(text, '') AS body FROM acts),
t AS (SELECT title, count(*) AS n FROM (SELECT unnest(list_transform(regexp_extract_all(body, '{C.HEADER}', 1), lambda h: trim(regexp_replace(h, '^#{{1,3}}[ \\t]+', '')))) AS title FROM b) GROUP BY title)
SELECT * FROM (SELECT 'title' AS kind, title AS name, n FROM t ORDER BY n DESC, title LIMIT 12) UNION ALL """ + " UNION ALL ".join(f"SELECT 'forms', '{k}', count(*) FILTER (regexp_matches(title, '{p}')) FROM t" for k, p in VARIANTS.items()))
def agg16_headings(spark, d):
    """The twelve most frequent headers, and in how many forms each concept is written."""
    t = _bodies(spark, d).select(F.explode(C.titles(F.col("body"))).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    top = t.orderBy(F.desc("n"), "name").limit(12).select(F.lit("title").alias("kind"), "name", "n")
    forms = t.agg(*[F.count_if(F.col("name").rlike(p)).alias(k) for k, p in VARIANTS.items()])
    return top.unionByName(forms.unpivot([], list(VARIANTS), "name", "n").select(F.lit("forms").alias("kind"), "name", "n"))


# --- repair and survivorship


_FRAG = """frag AS (SELECT i, 'd' || (i // 3)::VARCHAR AS doc, id_archivo, section, url, confidence,
  CASE i % 7 WHEN 0 THEN 'unknown — Artículo 2' WHEN 1 THEN '' WHEN 2 THEN 'Orden_Compra' ELSE 'Disposición ' || code || ' ' || number || ' — Visto' END AS cita FROM acts),
cat AS (SELECT id_archivo AS k, 'disposición' AS type, lower(code) AS code, CASE WHEN i % 11 <> 0 THEN split_part(number, '/', 1) ELSE '' END AS nro, year::VARCHAR AS anio, title FROM acts WHERE i % 5 <> 0)"""
_HEAD = lambda c: f"lower(trim(split_part({c}, '—', 1)))"
_BAD = "('unknown', 'orden_compra', '')"


@query(A + f""", {_FRAG},
r AS (SELECT f.*, c.k IS NOT NULL AND nro <> '' AND {_HEAD('cita')} IN {_BAD} AS mended, trim(CASE WHEN contains(cita, '—') THEN split_part(cita, '—', 2) WHEN section <> cita AND section <> doc THEN section ELSE '' END) AS suffix, 'Disposición ' || upper(c.code) || ' ' || nro || '/' || anio AS base FROM frag f LEFT JOIN cat c ON f.id_archivo = c.k),
n AS (SELECT *, CASE WHEN mended THEN base || CASE WHEN suffix <> '' THEN ' — ' || suffix ELSE '' END ELSE cita END AS new FROM r),
g AS (SELECT *, CASE WHEN {_HEAD('new')} IN {_BAD} THEN '__doc__' || doc ELSE {_HEAD('new')} END AS act FROM n),
p AS (SELECT act, doc, arg_min(coalesce(url, '') <> '', i) AS u, arg_min(coalesce(confidence, '') IN ('catalogo', 'alta'), i) AS c, count(*) AS m FROM g GROUP BY act, doc),
w AS (SELECT act, doc FROM p QUALIFY row_number() OVER (PARTITION BY act ORDER BY u DESC, c DESC, m DESC, doc DESC) = 1)
SELECT i, new AS cita FROM g JOIN w USING (act, doc)""")
def dml08_dedup(spark, d):
    """Degraded citations are mended from the catalogue by file id; of an act's copies the one with a link, a sure origin and most fragments stays."""
    i = F.col("i")
    kept = F.when(i % 7 == 0, "unknown — Artículo 2").when(i % 7 == 1, "").when(i % 7 == 2, "Orden_Compra").otherwise(F.concat(F.lit("Disposición "), "code", F.lit(" "), "number", F.lit(" — Visto")))
    a = S.acts(spark, d)
    frag = a.select("i", F.concat(F.lit("d"), F.floor(i / 3).cast("string")).alias("doc"), "id_archivo", "section", "url", "confidence", kept.alias("cita"))
    cat = a.where("i % 5 <> 0").select("id_archivo", F.lit("disposición").alias("type"), F.lower("code").alias("code"), F.when(i % 11 != 0, F.split_part("number", F.lit("/"), F.lit(1))).otherwise("").alias("nro"), F.col("year").cast("string").alias("anio"), "title")
    return R.deduplicated(R.mended(frag, cat)).select("i", "cita")


# --- lists


@query(A + "SELECT i, CASE i % 4 WHEN 0 THEN 'Ángel S. BERTOGLIO:Rector|Ana Ruiz:unknown' WHEN 1 THEN 'JUAN PABLO SOSA:Secretario' WHEN 2 THEN '' ELSE 'María Pérez:unknown|Luis Gómez:Decano' END AS signers FROM acts")
def arr01_signers(spark, d):
    """Variants of one signer become one, that with a role first."""
    lists = [[("ANGEL SEBASTIAN BERTOGLIO", "unknown"), ("Ana  Ruiz", ""), ("Ángel S. BERTOGLIO", "Rector"), ("Angel Bertoglio Vidal", "Decano")], [("Juan Pablo Sosa", None), ("JUAN PABLO SOSA", "Secretario"), ("unknown", "Rector")], [], [("María Pérez", "unknown"), ("Luis Gómez", "Decano"), ("GOMEZ", "Jefe"), (None, "x")]]
    said = F.array(*[F.array(*[F.struct(F.lit(n).cast("string").alias("name"), F.lit(r).cast("string").alias("role")) for n, r in v]) if v else F.array().cast("array<struct<name:string,role:string>>") for v in lists])
    rows = S.acts(spark, d).select("i", F.get(said, (F.col("i") % 4).cast("int")).alias("signers"))
    return consolidated(rows, "signers").select("i", F.array_join(F.transform("signers", lambda s: F.concat(s["name"], F.lit(":"), s["role"])), "|").alias("signers"))


def queries() -> dict[str, Query]:
    return dict(_all)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
