"""Titles, names, commands, glossaries and dates on hand-written cases."""

import pytest
from cartulary.functions import titles as L
from pyspark.sql import functions as F


def run(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).cast("string").alias(k) for k, v in values.items()]).select(column).first()[0]


@pytest.mark.parametrize(("kind", "want"), [("DISPOSICIÓN CONSEJO DIRECTIVO", "Disposición"), ("orden de compra", "Orden de compra"), ("cONTRATO x", "Contrato"), ("  ", "Documento"), (None, "Documento")])
def test_genres(spark, kind, want):
    assert run(spark, L.genre(F.col("k")), k=kind) == want


@pytest.mark.parametrize(
    ("code", "title", "part", "annex", "want"),
    [
        ("DISPCD-CB", "Artículo  2", "articulo", None, "Disposición DISPCD-CB 528/2025 — Artículo 2"),
        ("unknown", "Artículo 2", "anexo", "Anexo I", "Disposición 528/2025 — Anexo I, Artículo 2"),
        ("", "Artículo 2", "anexo", None, "Disposición 528/2025 — Anexo, Artículo 2"),
        ("CS", "ANEXO III", "anexo", "Anexo I", "Disposición CS 528/2025 — ANEXO III"),
        ("CS", "algo", "otra", None, "Disposición CS 528/2025"),
        ("CS", "", "articulo", None, "Disposición CS 528/2025"),
        ("CS", "x" * 30 + " " + "y" * 40, "articulo", None, "Disposición CS 528/2025 — " + "x" * 30 + "…"),
        ("CS", "z" * 70, "articulo", None, "Disposición CS 528/2025 — " + "z" * 60 + "…"),
    ],
)
def test_citations(spark, code, title, part, annex, want):
    c = L.citation(F.lit("disposicion"), F.col("c"), F.lit("528/2025"), F.col("t"), F.col("p"), F.col("a"))
    assert run(spark, c, c=code, t=title, p=part, a=annex) == want


def test_catalogue_citations(spark):
    c = L.catalogue_citation(F.col("k"), F.col("c"), F.col("n"), F.col("y"), F.col("s"))
    assert run(spark, c, k="RESOLUCION HCS", c=" cs ", n="7", y="2025", s="Visto") == "Resolucion Hcs CS 7/2025 — Visto"
    assert run(spark, c, k=None, c=None, n="7", y="2025", s=None) == "Acto 7/2025" and run(spark, c, k="x", c="y", n=" ", y="2025", s=None) is None


@pytest.mark.parametrize(("name", "want"), [("DEPTO_SOCIALES_12", "DEPTO_SOCIALES"), ("DISPCD-CB_61_2026", ""), ("depto_12", ""), ("ACTAS", "ACTAS"), (None, "")])
def test_sections_of_files(spark, name, want):
    assert run(spark, L.section_of_file(F.col("n")), n=name) == want


@pytest.mark.parametrize(("value", "want"), [("VILLA  MARÍA DEL RÍO", "Villa María del Río"), ("LUJAN , buenos aires", "Luján, Buenos Aires"), ("de la garma", "De la Garma"), (" , ", "unknown"), (None, "unknown")])
def test_cities(spark, value, want):
    assert run(spark, L.city(F.col("v")), v=value) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("/novedades 60 concursos", ("novedades", 60, "concursos")), ("/NOVEDADES", ("novedades", None, L.NO_TOPIC)), ("/listado becas\nde grado", ("listado", None, "becas\nde grado")), ("/listado", (None, None, None)), ("/nada x", (None, None, None)), ("hola /listado x", (None, None, None))],
)
def test_commands(spark, text, want):
    assert tuple(run(spark, L.command(F.col("t")), t=text)) == want


def test_glossary(spark):
    g = "carreras → oferta académica, sede de dictado\noferta->carreras, plan\nsin flecha\n → x"
    q = lambda t: run(spark, L.expanded(F.col("t"), g), t=t)
    assert q("¿Qué CARRÉRAS hay?") == "¿Qué CARRÉRAS hay? (oferta académica, sede de dictado)"
    assert q("oferta académica de carreras") == "oferta académica de carreras (sede de dictado, plan)" and q("nada") == "nada"


def test_names_and_slugs(spark):
    assert run(spark, L.file_stem(F.lit("Disp. Cd"), F.lit("7"), F.lit("2025"), F.lit("ab")), x="") == "DISP-CD_7_2025"
    assert run(spark, L.file_stem(F.lit(""), F.lit(None).cast("string"), F.lit(""), F.lit("1234-5678-9012-3456-7890")), x="") == "1234-5678-9012-3"
    s = L.slug(F.col("t"))
    assert run(spark, s, t="# Disposición DISPCD-CB : 528 / 2025") == "disp_dispcd_cb_528_2025" and run(spark, s, t="Acta 1") is None


def test_dates(spark):
    w = L.written_date(F.col("d"), F.col("m"), F.col("y"))
    assert [run(spark, w, d=d, m=m, y=y) for d, m, y in (("7", "Marzo", "25"), ("31", "02", "2025"), ("32", "abril", "2025"), ("1", "xyz", "2025"), ("1", "set", "999"))] == ["2025-03-07", "2025-02-31", None, None, None]
    i = lambda dates, n, h: run(spark, L.issue_date(F.array(*map(F.lit, dates)) if dates else F.array().cast("array<string>"), F.col("n"), F.col("h")), n=n, h=h)
    assert i(["2026-03-31", "2025-08-01", "2025-04-01"], "101/25", "") == "2025-04-01"
    assert i(["2026-03-31", "2025-04-01"], "x", "LUJAN, 1º DE ABRIL DE 2025") == "2025-04-01"
    assert i(["2026-03-31", "2025-04-09", "2025-04-02"], None, "a\nLUJAN, 1 DE ABRIL DE 2025") == "2025-04-02"
    assert i(["2026-03-31", "2025-05-01"], None, "") == "2026-03-31" and i([], "1/25", "") == "unknown"
