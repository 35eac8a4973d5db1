"""Queries over the whole of their tables, against independent results on small made tables."""

import random

import duckdb
from cartulary.operators import retrieval
from cartulary.plans import registry


def test_strict_mentions_in_long_texts(spark, tmp_path):
    def brute(t):
        at = lambda p: [i for i in range(len(t)) if t.startswith(p, i)]
        return any(all(any(abs(a - b) <= 40 for b in at(p)) for p in ("that", "with")) for a in at("the"))

    pad = "lorem ipsum " * 400
    texts = ["the that with", "the that " + "x" * 60 + " with", pad + "The with thát" + pad, pad + "the that" + pad + "with", pad]
    spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.strict for r in registry.queries()["flt10_mentions_strict"](spark, str(tmp_path)).collect()}
    assert got == {i: brute(t.lower().replace("á", "a")) for i, t in enumerate(texts)}
    assert got[2] and not got[3]


def test_attribution_reads_all_texts(spark, tmp_path):
    # doc_id 150 apart: one number; the names stand in the fourth and fifth text only, or one of them never
    texts = {0: "x", 150: "y", 300: None, 450: "THE", 600: "thát", 1: "the", 151: "x", 301: "x", 451: "x", 2: "the that", 3: None}
    spark.createDataFrame([(i, t, "en", "a") for i, t in texts.items()], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.number: r.right for r in registry.queries()["ret22_attribution"](spark, str(tmp_path)).collect()}
    assert got == {"1/2024": True, "2/2025": False, "3/2026": True, "4/2024": False}


def test_knn_of_every_hundredth_row(spark, tmp_path):
    rng = random.Random(3)
    rows = {i: [rng.gauss(0, 1) for _ in range(8)] for i in [*range(0, 900, 3), -100, -7]}
    rows |= {i: [1.0] * 8 for i in range(5001, 5041)} | {7000: [1.0] * 8, 7100: [0.0] * 8}  # copies: ties to the smaller id
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<float>")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.q, r.rank): (r.i, r.score) for r in registry.queries()["ret04_knn"](spark, str(tmp_path)).collect()}
    asked = [i for i in rows if i % 100 == 0]
    assert {q for q, _ in got} == set(asked) and len(got) == 10 * len(asked)
    v = df.selectExpr("vec_id as i", "embedding as v")
    want = retrieval.top(retrieval.cosine(v, v.where("pmod(i, 100) = 0").selectExpr("i as q", "v")), 10)
    assert got == {(r.q, r.rank): (r.i, r.score) for r in want.collect()}
    again = retrieval.knn(v, v.where("pmod(i, 100) = 0").selectExpr("i as q", "v"), 10, rows=7)  # many blocks of both
    assert got == {(r.q, r.rank): (r.i, r.score) for r in again.collect()}


def test_daily_series_counts_all_events(spark, tmp_path):
    days = ["2024-01-02", "2024-01-03", "2024-01-03", "2024-01-06", "2024-01-08"]
    spark.createDataFrame([(k, x) for k, x in enumerate(days)], "event_id long, x string").selectExpr("event_id", "cast(x as timestamp) as ts").write.parquet(f"{tmp_path}/events.parquet")
    got = {str(r.day): r.n for r in registry.queries()["agg08_daily_series"](spark, str(tmp_path)).collect()}
    assert got == {f"2024-01-0{k}": n for k, n in {2: 1, 3: 2, 4: 0, 5: 0, 6: 1, 7: 0, 8: 1}.items()}


def test_cited_by_reads_texts(spark, tmp_path):
    # doc_id 1 and 151 have the number 2/2025, doc_id 2 has 3/2026; even acts can be cited and can cite
    rows = {0: "nothing", 1: "acto 2/2025 propio", 151: "ver acto 2/2025", 2: "ver 2/2025", 4: "ver 2 / 2025 y 3/2026", 5: "12/2025 y 2/20"}
    rows |= {k: "ver 2/2025 " + "palabra " * (k - 5) for k in range(6, 20)}
    df = spark.createDataFrame([(i, t, "en", "b" if i == 151 else "a") for i, t in rows.items()], "doc_id long, text string, lang string, source string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    name = lambda i: f"DISP-{'B' if i == 151 else 'A'} {i % 50 + 1}/{2024 + i % 3}"
    got = {}
    for r in sorted(registry.queries()["join21_cited_by"](spark, str(tmp_path)).collect(), key=lambda r: r.place):
        got.setdefault(r.k, []).append(r.citing)
    assert set(got) == {1, 151, 2} and got[2] == [name(4)]
    score = retrieval.top(retrieval.bm25(df.selectExpr("doc_id as i", "text"), spark.createDataFrame([("2/2025", "2/2025")], "q string, text string")), 60)
    ranked = [r.i for r in score.orderBy("rank").collect() if r.i not in (0, 5)]
    for k in (1, 151):
        assert got[k] == [name(i) for i in ranked if name(i) != name(k)][:10]


def test_unique_candidates_of_odd_titles(spark, tmp_path):
    texts = {0: "Uß.", 1: "Uss.", 2: "ab\u00a0", 3: "AB", 4: "c\x0bd", 5: "c d", 6: None, 7: None, 8: "", 9: " \nx", 10: "e \t f\nx", 11: "E F", 12: "ﬁn", 13: "fin", 14: "éa", 15: "ÉA"}
    rows = [(i, t, "de", "a") for i, t in texts.items()] + [(20, "Uß.", None, "a"), (21, None, None, "a"), (22, "g", None, "a"), (23, "G", None, "a"), (24, None, "fr", "a")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.i, r.id_archivo) for r in registry.queries()["join04_unique_candidate"](spark, str(tmp_path)).collect())
    assert got == [(i, str(i)) for i in (0, 1, 4, 5, 12, 13, 20, 21, 24)]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(registry.oracle_sql()["join04_unique_candidate"]).fetchall())


def test_numbering_of_odd_titles(spark, tmp_path):
    # ids 700 apart: one day
    texts = {0: "Erß b", 700: "Ert a", 1400: "erss", 2100: None, 2800: "", 3500: "ﬁ", 4200: "fz", 4900: "É", 5600: "ert A", 1: "a"}
    rows = [(i, t, "de", "ß") for i, t in texts.items()] + [(6300, "a", "de", "ss"), (7000, "b", "de", None), (7700, None, "de", None), (None, "a", "de", "ß")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.i: r.n for r in registry.queries()["win17_renumber"](spark, str(tmp_path)).collect()}
    order = [2800, 1400, 700, 5600, 0, 4200, 4900, 3500, 2100, 1, None]
    assert got == {i: n for n, i in enumerate(order, 1)} | {6300: 1, 7000: 1, 7700: 2}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == dict(con.execute(registry.oracle_sql()["win17_renumber"]).fetchall())
