"""Queries over records: incomplete metadata, folders, nested objects, warnings, headings, and changes of tables with their guards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relational as R
from ..sources import tables as S
from .citations import _form, _form_sql
from .oracles import ACTS, MESSAGES

Query = Callable[[SparkSession, str], DataFrame]
_all: dict[str, Query] = {}
_sql: dict[str, str] = {}

A, M = f"WITH {ACTS}\n", f"WITH {MESSAGES}\n"
KINDS, CITIES, ISSUERS = ["resolucion", "unknown", "", "Acta", " UNKNOWN "], ["Luján", "", "unknown"], ["CONSEJO", " ", "unknown", "RECTOR", "", "Unknown", "x"]
FOLDERS = ['{"id": #n, "nombre": "Actas", "publico": true, "eliminado": false}', '{"id": #n, "publico": true, "eliminado": true}', '{"id": #n, "publico": false}', '{"id": #n, "publico": true}', '{"id": #n', "", '{"id": #n, "publico": 1, "eliminado": null}']
OBJECTS = ['{"nro": {"tipo": "DISP", "nro": "#n"}, "numero_asignado": " DISP  #n / #y ", "estado": {"nombre": "vigente"}}', '{"nro": {"codigo_tipo_documento": "DR"}, "numero_asignado": null, "estado": null}', '{"nro": null, "estado": {}}', "no json", '{"nro": {"tipo": null, "codigo_tipo_documento": "CS"}, "numero_asignado": "7"}']
ACTS_IN_CAPITALS = ["VISTO: el expediente #n\nCONSIDERANDO\nque corresponde\nRESUELVE:\nARTÍCULO 1º.- Apruébase", "Visto el x\nDISPONE :\nARTICULO  2° : Regístrese\n", "Artículo 3.- en minúsculas\n VISTO sangrado", ""]
HEADINGS = [(r"(?m)^VISTO\s*:?\s*", "## Visto\n\n"), (r"(?m)^CONSIDERANDO\s*:?\s*", "## Considerando\n\n"), (r"(?m)^(?:RESUELVE|DISPONE)\s*:?\s*", "## Parte resolutiva\n\n"), (r"(?m)^ART[ÍI]CULO\s+(\d+)\s*[º°]?\s*[.:]?-?\s*", "### Artículo $1\n\n")]


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _all[f.__name__], _sql[f.__name__] = f, sql
        return f

    return add


def incomplete(fields: list[Column]) -> Column:
    """How many fields are null, blank or 'unknown'."""
    lacks = lambda c: F.coalesce(F.lower(F.trim(c)), F.lit("")).isin("", "unknown").cast("int")
    return sum((lacks(c) for c in fields), F.lit(0))


_FIELDS = ["id_archivo", _form_sql(KINDS), _form_sql(CITIES), _form_sql(ISSUERS), "CASE WHEN i % 3 = 0 THEN number END", "CASE WHEN i % 2 = 0 THEN code ELSE 'unknown' END", "url", "CASE WHEN i % 4 = 0 THEN fecha_acto END", "CASE WHEN i % 5 = 0 THEN title END", "CASE WHEN i % 6 <> 0 THEN '' ELSE section END", "CASE WHEN confidence = 'baja' THEN NULL ELSE confidence END"]


@query(A + "SELECT i, lacking, lacking >= 7 AS special FROM (SELECT i, " + " + ".join(f"(coalesce(lower(trim({f})), '') IN ('', 'unknown'))::INT" for f in _FIELDS) + " AS lacking FROM acts)")
def flt16_special_document(spark, d):
    """At least seven of eleven basic fields are incomplete."""
    i = F.col("i")
    fields = [F.col("id_archivo"), _form(KINDS), _form(CITIES), _form(ISSUERS), F.when(i % 3 == 0, F.col("number")), F.when(i % 2 == 0, F.col("code")).otherwise("unknown"), F.col("url"), F.when(i % 4 == 0, F.col("fecha_acto")), F.when(i % 5 == 0, F.col("title")), F.when(i % 6 != 0, "").otherwise(F.col("section")), F.when(F.col("confidence") != "baja", F.col("confidence"))]
    return S.acts(spark, d).select("i", incomplete(fields).alias("lacking")).select("i", "lacking", (F.col("lacking") >= 7).alias("special"))


@query(A + f"SELECT i, CASE WHEN json_valid(o) THEN json_extract_string(o, '$.nombre') END AS name FROM (SELECT i, {_form_sql(FOLDERS)} AS o FROM acts) WHERE CASE WHEN json_valid(o) THEN coalesce(json_extract_string(o, '$.publico') = 'true' AND coalesce(json_extract_string(o, '$.eliminado'), 'false') <> 'true', false) ELSE false END")
def flt20_public_folders(spark, d):
    """Folders of the portal that are public and not deleted; objects that cannot be read are none."""
    get = lambda k: F.get_json_object("o", f"$.{k}")
    o = S.acts(spark, d).select("i", _form(FOLDERS).alias("o"))
    return o.where((get("publico") == "true") & (F.coalesce(get("eliminado"), F.lit("false")) != "true")).select("i", get("nombre").alias("name"))


_GET = lambda *paths: "coalesce(" + ", ".join(f"CASE WHEN json_valid(o) THEN json_extract_string(o, '{p}') END" for p in paths) + ", '')"


@query(A + f"SELECT i, {_GET('$.nro.tipo', '$.nro.codigo_tipo_documento')} AS code, trim(regexp_replace({_GET('$.numero_asignado')}, '\\s+', ' ', 'g')) AS number, {_GET('$.estado.nombre')} AS state FROM (SELECT i, {_form_sql(OBJECTS)} AS o FROM acts)")
def jsn03_portal_rows(spark, d):
    """Nested objects of a portal as flat rows: the code under either of two keys, and empty texts for what lacks."""
    shape = "struct<nro: struct<tipo: string, codigo_tipo_documento: string>, numero_asignado: string, estado: struct<nombre: string>>"
    a = S.acts(spark, d).select("i", F.from_json(_form(OBJECTS), shape).alias("o"))
    empty = F.lit("")
    return a.select("i", F.coalesce("o.nro.tipo", "o.nro.codigo_tipo_documento", empty).alias("code"), F.trim(F.regexp_replace(F.coalesce("o.numero_asignado", empty), r"\s+", " ")).alias("number"), F.coalesce("o.estado.nombre", empty).alias("state"))


@query("SELECT substring(w, 1, 70) AS warning, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS w FROM documents) GROUP BY 1 ORDER BY n DESC, warning LIMIT 15")
def agg23_warnings(spark, d):
    """The most frequent warnings by their first 70 characters; the lines of a text stand for the warnings of a run."""
    w = S.read(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("w"))
    return w.groupBy(F.substring("w", 1, 70).alias("warning")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "warning").limit(15)


_HEAD_SQL = f"{_form_sql(ACTS_IN_CAPITALS)} || coalesce(text, '')"
for _p, _to in HEADINGS:
    _HEAD_SQL = "regexp_replace({}, '{}', '{}', 'g')".format(_HEAD_SQL, _p, _to.replace("\n", "' || chr(10) || '").replace("$1", "\\1"))


@query(A + f"SELECT i, {_HEAD_SQL} AS body FROM acts")
def str27_headings(spark, d):
    """The parts of an act in capitals at the start of a line become headings."""
    body = F.concat(_form(ACTS_IN_CAPITALS), F.coalesce("text", F.lit("")))
    for pattern, to in HEADINGS:
        body = F.regexp_replace(body, pattern, to)
    return S.acts(spark, d).select("i", body.alias("body"))


@query(A + """SELECT i, CASE WHEN i % 10 = 1 THEN DATE '2024-05-01' WHEN i IN (SELECT doc_id FROM labels) THEN DATE '2025-01-01' END AS downloaded_on,
  CASE WHEN i IN (SELECT vec_id FROM embeddings) THEN DATE '2025-01-01' END AS indexed_on FROM acts""")
def dml02_reconcile(spark, d):
    """Files found and rows of the index stamp the catalogue; a stamp that is there stays."""
    c = S.acts(spark, d).select("i", F.when(F.col("i") % 10 == 1, F.lit("2024-05-01").cast("date")).alias("downloaded_on"), F.lit(None).cast("date").alias("indexed_on"))
    found = {"downloaded_on": S.read(spark, d, "labels").select(F.col("doc_id").alias("i")), "indexed_on": S.read(spark, d, "embeddings").select(F.col("vec_id").alias("i"))}
    return R.reconciled(c, found, "i", F.lit("2025-01-01").cast("date"))


@query(M + """, t AS (SELECT id, conv_id, user_id, text FROM messages UNION ALL SELECT id + 500, conv_id, user_id, 'nuevo' FROM messages WHERE role = 'user' AND id + 500 NOT IN (SELECT id FROM messages))
SELECT id, conv_id, user_id, CASE WHEN id % 4 = 0 AND user_id = (CASE WHEN id % 8 = 0 THEN user_id ELSE user_id + 1 END) THEN 'cambiado' ELSE text END AS text FROM t WHERE conv_id % 9 <> 0""")
def dml05_ignore_and_cascade(spark, d):
    """Messages whose id is there are not inserted again, changes by others than the owner change nothing, and messages of deleted conversations go."""
    m = S.messages(spark, d).select("id", "conv_id", "user_id", "text", "role")
    t = m.drop("role")
    more = m.where("role = 'user'").select((F.col("id") + 500).alias("id"), "conv_id", "user_id", F.lit("nuevo").alias("text"))
    t = R.insert_or_ignore(t, more.unionByName(t.where("id % 3 = 0").withColumn("text", F.lit("otra vez"))), "id")
    by = F.when(F.col("id") % 8 == 0, F.col("user_id")).otherwise(F.col("user_id") + 1)
    t = R.owned_update(t, t.where("id % 4 = 0").select("id", by.alias("user_id"), F.lit("cambiado").alias("text")), "id", "user_id", "text")
    return R.without_children(t, t.where("conv_id % 9 = 0").select("conv_id"), "conv_id")


_NEW = "CASE i % 5 WHEN 0 THEN NULL WHEN 1 THEN title || ' (texto ordenado)' WHEN 2 THEN '  ' || replace(title, ' ', '   ') WHEN 3 THEN '' ELSE title END"


@query(A + f"""SELECT i, CASE WHEN i % 6 <> 0 THEN coalesce(nullif(section || '-nueva', ''), section) ELSE section END AS section, title,
  CASE WHEN i % 6 <> 0 THEN coalesce(nullif({_NEW}, '') IS NOT NULL AND trim(regexp_replace(title, '\\s+', ' ', 'g')) <> trim(regexp_replace({_NEW}, '\\s+', ' ', 'g')), false) ELSE false END AS drifted FROM acts""")
def dml07_drift(spark, d):
    """Columns that are not embedded follow the metadata; acts whose title changed by more than white space are to be embedded again."""
    a = S.acts(spark, d).select("i", "section", "title")
    meta = a.where("i % 6 <> 0").select("i", F.concat("section", F.lit("-nueva")).alias("section"), F.expr(_NEW).alias("title"))
    return R.refreshed(a, meta, "i", "title", ["section"])


def queries() -> dict[str, Query]:
    return dict(_all)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
