"""Text functions on hand-written cases."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from cartulary.functions import text as T
from pyspark.sql import functions as F


def run(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("ABC-X: 0000042-24", ["abc-x:0000042-24", "abc-x", "0000042-24"]),
        ("ABC-X : 528 / 2025", ["abc-x:528/2025", "abc-x", "528", "2025"]),
        ("expediente 175/2008", ["expediente", "175/2008", "175", "2008"]),
        ("pingüino ÁRBOL a de", ["ping", "ino", "arbol"]),
        ("", []),
    ],
)
def test_tokens(spark, text, want):
    assert run(spark, T.tokens(F.col("t")), t=text) == want


def test_act_ids(spark):
    assert run(spark, T.act_ids(F.col("t")), t="acto 12/2024 y 7/99") == ["12/2024"]
    assert run(spark, T.act_ids(F.col("t")), t="DISP-A : 12/2024") == []  # one token with its code; its parts are no identifiers


def test_mentions(spark):
    pieces = F.array(F.lit("juan"), F.lit("perez"))
    near, far = "juan " + "x" * 34 + " perez", "juan " + "x" * 35 + " perez"
    assert run(spark, T.mentions_strict(F.col("t"), pieces), t=near) is True
    assert run(spark, T.mentions_strict(F.col("t"), pieces), t=far) is False
    assert run(spark, T.mentions_loose(F.col("t"), pieces), t=far) is True
    assert run(spark, T.mentions_strict(F.col("t"), F.array().cast("array<string>")), t=far) is False


def test_truncate_and_dates(spark):
    assert run(spark, T.truncate_on_word(F.col("t"), 10), t="short") == "short"
    assert run(spark, T.truncate_on_word(F.col("t"), 10), t="aaaaaaa bbbbbbb") == "aaaaaaa […]"
    assert run(spark, T.truncate_on_word(F.col("t"), 10), t="aa bbbbbbbbbbbb") == "aa bbbbbbb […]"
    assert run(spark, T.iso_date(F.col("t")), t="23/02/2026") == "2026-02-23"
    assert run(spark, T.iso_date(F.col("t")), t="2026-02-23") == ""


@pytest.mark.parametrize(("title", "after", "want"), [("FIRMAS", True, "firmas"), ("Anexo II", False, "anexo"), ("Página 3", True, "ruido"), ("PROGRAMA", True, "anexo"), ("Artículo 1", False, "articulo"), ("Que es", False, "considerando"), ("Parte dispositiva", False, "parte_resolutiva"), ("x", False, "otra")])
def test_section_type(spark, title, after, want):
    assert run(spark, T.section_type(F.col("t"), F.col("a")), t=title, a=after) == want


def test_strict_mentions(spark):
    def brute(text, pieces):
        at = lambda p: [i for i in range(len(text)) if text.startswith(p, i)]
        return bool(pieces) and any(all(any(abs(a - b) <= 40 for b in at(p)) for p in pieces[1:]) for a in at(pieces[0]))

    gap = lambda n: "x" * n
    texts = ["abcd" + gap(36) + "wxyz", "abcd" + gap(37) + "wxyz", "wxyz" + gap(36) + "abcd", "wxyz" + gap(37) + "abcd", "abcdef", "abcd\n\nwxyz", "abcd wxyz" + gap(90) + "abcd", "ñandú abcd " + gap(20) + "\U0001f600 wxyz", ""]
    cases = [(t, p) for t in texts for p in ([], ["abcd"], ["abcd", "wxyz"], ["cdef", "abcd"], ["abcd", "wxyz", "ñandú"], ["a.cd", "wxyz"])]
    df = spark.createDataFrame(cases, "t string, p array<string>")
    got = df.select("t", "p", T.mentions_strict(F.col("t"), F.col("p")).alias("m")).collect()
    assert all(r.m == brute(r.t, r.p) for r in got)


def test_capitals_and_spaces_of_every_character(spark, tmp_path):
    path = f"{tmp_path}/letters.parquet"
    pq.write_table(pa.table({"k": (k := [k for k in range(1, 0x110000) if not 0xD800 <= k < 0xE000]), "c": [chr(x) for x in k]}), path)
    got = spark.read.parquet(path).select("k", T.upper(F.col("c")), T.trim(F.col("c")), F.regexp_replace("c", T.WHITE, "_"))
    want = duckdb.sql(f"SELECT k, upper(c), trim(c), regexp_replace(c, '\\s', '_', 'g') FROM '{path}'").fetchall()
    assert not {tuple(r) for r in got.collect()} ^ set(want)
    assert [run(spark, T.upper(F.col("x")), x=x) for x in ("straße", "ŉ ﬁ", "ᾳ", None)] == ["STRAẞE", "ŉ ﬁ", "ᾼ", None]
