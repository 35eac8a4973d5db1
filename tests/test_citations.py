"""Citations, names, entities, issuers, signers and bodies on hand-written cases."""

import pytest
from cartulary.functions import citations as C
from cartulary.operators import relational as R
from cartulary.operators.signers import consolidate
from pyspark.sql import functions as F


def run(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("RESHCS 893/2025 y DISPCD-CB : 0528 / 25, otra vez DISPCD-CB 528/2025", ["RESHCS 893/2025", "DISPCD-CB 528/2025"]),
        ("CS 33/98 y cs 34/2026 y A 1/2026", ["CS 33/1998"]),
        ("", []),
        (None, []),
    ],
)
def test_acts(spark, text, want):
    assert run(spark, C.acts_of(F.col("t").cast("string")), t=text) == want


def test_state_acts_and_families(spark):
    assert run(spark, C.state_acts(F.col("t")), t="DISPCD-CB 528/2025, CS 33/2026, RES 9 / 25 y RES 9/25") == ["DISPCD-CB 528/2025", "RES 9/25"]
    assert run(spark, C.norm_families(F.col("t")), t="DISP 4/2020, disp-5/21, RESOL-12/24, DISPCD-T : 7/2020, DISP 9/2020") == ["DISP", "disp", "RES", "DISPCD"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("el pedido de Ana Ruiz ante el Consejo Superior", ["Ana Ruiz"]),
        ("Vino. Juan Sosa firma", []),
        ("¿ Juan Sosa firma con Luis Alberto Paz Soldán y Ana?", ["Luis Alberto Paz Soldán"]),
        ("Ana Ruiz abre la oración", ["Ana Ruiz"]),
        ("plan de Estudios Avanzados Uno", []),
    ],
)
def test_person_names(spark, text, want):
    assert run(spark, C.person_names(F.col("t")), t=text) == want


@pytest.mark.parametrize(("text", "want"), [("DISPCD-CB : 528 / 2025", ("DISPCD-CB", "528/2025", 2025)), ("DR - 250 / 2023", ("DR", "250/2023", 2023)), (" dr 7/98 ", ("DR", "7/98", 2098)), ("528/2025", (None, None, None)), ("DR 7/2023 bis", (None, None, None))])
def test_portal_numbers(spark, text, want):
    assert tuple(run(spark, C.split_number(F.col("t")), t=text)) == want


def test_grounding(spark):
    said = F.lit("según CS 1/2025, DISP 2/25 y RES 3/2025")
    assert run(spark, C.ungrounded(said, F.array(F.lit("Resolución CS 1/25 — Visto")), F.array(F.lit("texto con RES : 003/2025"))), x=1) == ["DISP 2/2025"]


@pytest.mark.parametrize(
    ("citation", "want"),
    [("resolucion cs 1/2025 — articulo 1", 1), ("Acto 1 / 2025 — Artículo 2", 2), ("Acto 1/2025 — Anexo", 1), ("DISPP 7/2024", 0), ("Nota", 3), ("la nota interna de hoy", 3), ("Ley 9/1900", -1)],
)
def test_citation_sources(spark, citation, want):
    sources = F.array(*map(F.lit, ["Disposición DISP 7/2024", "Resolución CS 1/2025 — Artículo 1", "Resolución CS 1/2025 — Artículo 2", "Nota interna"]))
    assert run(spark, C.resolve(F.col("c"), sources), c=citation) == want
    assert run(spark, C.resolve(F.col("c"), F.array().cast("array<string>")), c=citation) == -1


def test_entities(spark):
    text = "Orden de Compra N°: 11/25; EXP-LUJ N°: 0916/2024; Ley 24.521, Licenciatura en Trabajo  Social; Materia (20134) Análisis Matemático, fin"
    got = {f: run(spark, C.entities(F.col("t"), f), t=text) for f in C.ENTITIES}
    assert got["order"] == ["11/25"] and got["file"] == ["916/2024"] and got["norm"] == ["Ley 24.521"] and got["career"] == ["Licenciatura en Trabajo Social"] and got["course"] == ["20134"]
    assert "EXP-LUJ N°: 0916/2024" in got["code"]


@pytest.mark.parametrize(
    ("words", "kind", "want"),
    [
        ("Por ello, EL RECTOR DE LA UNIVERSIDAD NACIONAL DE LUJÁN RESUELVE", "resolucion", "RESOLUCION RECTOR"),
        ("EL CONSEJO DIRECTIVO DEL DEPARTAMENTO DE  CIENCIAS D I S P O N E :", "disposicion", "CONSEJO DIRECTIVO DEL DEPARTAMENTO DE CIENCIAS"),
        ("la directora general de personal de la universidad nacional de luján", "", "DIRECCION GENERAL DE PERSONAL"),
        ("El Secretario Académico de la", "", "SECRETARIA ACADÉMICA"),
    ],
)
def test_issuers(spark, words, kind, want):
    assert run(spark, C.issuer(F.col("w"), F.col("k")), w=words, k=kind) == want


def test_roles(spark):
    assert run(spark, C.clean_role(F.col("r")), r=" - secretaria   académica. ") == "Secretaria académica"
    assert [run(spark, C.valid_role(F.col("r")), r=r) for r in ("Rector", "rectorado", "director de tesis", "unknown", "", "x" * 181 + " rector")] == [True, False, False, False, False, False]


def test_signers():
    got = consolidate([{"name": "Ángel S. BERTOGLIO", "role": ""}, {"name": "ANGEL SEBASTIAN BERTOGLIO VIDAL", "role": "Rector"}, {"name": "unknown", "role": "x"}, None, {"name": "Ana Ruiz", "role": "unknown"}, {"name": "RUIZ", "role": None}, {"name": "Ana Vidal", "role": "Jefa"}])
    # the group of the first two knows four words; one shared word is not enough
    assert got == [{"name": "ANGEL SEBASTIAN BERTOGLIO VIDAL", "role": "Rector"}, {"name": "Ana Ruiz", "role": "unknown"}, {"name": "Ana Vidal", "role": "Jefa"}]
    assert consolidate(None) == []


def test_chunkability(spark):
    body = "  antes \n# Uno\ntexto\n### Artículo 1\nRegístrese, comuníquese\n## LA SECRETARIA GENERAL\n#no es\n#### tampoco\nDISP 1/2020 DISP 2/2020"
    r = spark.createDataFrame([(body,), ("",), ("# solo",)], "b string").select(*C.chunkability(F.col("b"))).collect()
    a = r[0].asDict()
    assert (a["headers"], a["h1"], a["h2"], a["h3"], a["articles"], a["orphan"], a["formulas"], a["closing"], a["families"]) == (3, 1, 1, 1, 1, 5, 1, 1, 1)
    assert a["largest"] == len(body) - body.index("## LA") and r[1].largest == r[1].orphan == 0 and (r[2].orphan, r[2].largest) == (0, 6)


def test_repair_and_survivors(spark):
    frag = spark.createDataFrame(
        [
            (1, "a", "1", "Visto", None, None, "unknown — Anexo I"),
            (2, "b", "2", "Visto", "u", "baja", "Resolución CS 7/2025 — Visto"),
            (3, "b", "2", "Visto", "u", "baja", "Resolución CS 7/2025"),
            (4, "c", "3", "Visto", "u", "alta", "resolución cs 7/2025 — Firmas"),
            (5, "d", "4", "Firmas", None, None, ""),
            (6, "e", None, None, None, None, "unknown"),
        ],
        "i long, doc string, id_archivo string, section string, url string, confidence string, cita string",
    )
    cat = spark.createDataFrame([("1", "resolución", " cs", "7", "2025"), ("4", "", "", "9", "2024"), ("3", "otra", "x", "1", "2000")], "id_archivo string, type string, code string, nro string, anio string")
    got = {r.i: r.cita for r in R.mended(frag, cat).collect()}
    assert got == {1: "Resolución CS 7/2025 — Anexo I", 2: "Resolución CS 7/2025 — Visto", 3: "Resolución CS 7/2025", 4: "resolución cs 7/2025 — Firmas", 5: "Acto 9/2024 — Firmas", 6: "unknown"}
    # a, b and c are copies of one act: c has a link and a sure origin
    assert {r.i for r in R.deduplicated(R.mended(frag, cat)).collect()} == {4, 5, 6}
