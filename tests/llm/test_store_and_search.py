"""WARC bundles, vector searches and the shuffle against brute force and on odd input."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from cartulary.llm import hyper_shuffle, kdtree_topk, permutation_ann, warc_zstd

PAGES = "page_id long, url string, html string, digest string, id string"


def odd_pages(spark):
    rows = [(4, "http://a/b", "<p>one</p>"), (2, "http://a/ü%0A\r\n", "<p>one</p>"), (9, None, None), (7, "x", ""), (1, "http://b", "é" * 700_000), (None, "http://c", "<p>no id</p>"), (None, "http://c", "<p>one</p>"), (5, "u", "a\r\n\r\nb"), (5, "u", "a\r\n\r\nb")]
    return spark.createDataFrame([(*r, "z", "z") for r in rows], PAGES)


def test_warc_round_trip(spark, tmp_path):
    pages = odd_pages(spark)
    folder = f"file://{tmp_path}/warc"
    index = warc_zstd.write(pages, folder, frame_bytes=200)
    got = warc_zstd.read(index, with_payload=True).collect()
    assert len(got) == 9
    want = Counter((r.page_id, len((r.html or "").encode()), base64.b32encode(hashlib.sha1((r.html or "").encode()).digest()).decode()) for r in pages.collect())
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == want
    by = {r.page_id: r for r in got if r.page_id is not None}
    assert (by[4].record_type, by[4].refers_to) == ("revisit", 2) and by[2].record_type == "response" and by[9].refers_to == 7
    assert bytes(by[1].payload) == ("é" * 700_000).encode() and by[2].url == "http://a/ü%250A%0D%0A"
    assert sorted((r.record_type, r.refers_to) for r in got if r.page_id is None) == [("response", None), ("revisit", 2)]
    assert [r.record_type for r in got if r.page_id == 5] == ["response"] * 2
    # the bundles are plain Zstandard streams for any reader, and their seek tables name every frame
    for path in (tmp_path / "warc").iterdir():
        raw = zstandard.ZstdDecompressor().stream_reader(path.read_bytes(), read_across_frames=True).read()
        reader = warc_zstd.BundleReader(str(path))
        assert sum(f[2] for f in reader.frames) == len(raw) and raw.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    assert warc_zstd.archive(pages.limit(0)).count() == 0
    big = warc_zstd.read(warc_zstd.write(pages, f"{tmp_path}/other", min_bytes=100))
    assert {r.record_type for r in big.collect()} == {"response"}


def odd_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 4)).round(2)
    x[50:90] = x[50]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(200, None, 0), (220, [0.0] * 4, 0), (240, [1.0, None, 1.0, 1.0], 0), (260, [float("nan"), 1.0, 1.0, 1.0], 0), (280, [float("inf"), 1.0, 1.0, 1.0], 0), (None, [1.0] * 4, 0), (100, [-9.0] * 4, 1), (300, [], 0), (400, [2.0, -1.0], 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")


def brute(table, every, k, zeros, change):
    best = {}
    for r in table.collect():
        v = r.embedding
        if v is None or r.vec_id is None or any(x is None or not np.isfinite(x) for x in v) or (not zeros and not any(v)):
            continue
        best[r.vec_id] = max(best.get(r.vec_id, v), v)
    dim = max(map(len, best.values()), default=0)
    full = {i: change(np.array(v + [0.0] * (dim - len(v)))) for i, v in best.items()}
    out = set()
    for q in full:
        if q % every == 0:
            top = sorted(((-float(full[q] @ full[c]), c) for c in full if c != q))[:k]
            out |= {(q, n + 1, c, round(-s, 6)) for n, (s, c) in enumerate(top)}
    return out


@pytest.mark.parametrize("shard_rows", [8192, 30])
def test_kdtree_is_exact(spark, small, shard_rows):
    for table in (odd_vectors(spark), spark.read.parquet(f"{small}/embeddings.parquet")):
        got = kdtree_topk.search(table, every=20, shard_rows=shard_rows * 5 if table.count() > 300 else shard_rows, block_rows=9, leaf=4).collect()
        assert {(r.query_id, r.rank, r.vec_id, float(r.score)) for r in got} == brute(table, 20, 5, True, lambda v: np.floor(256 * v))
    assert kdtree_topk.search(odd_vectors(spark).limit(0)).count() == 0


def test_kdtree_large_components(spark):
    rows = [(0, [1e20, 1.0, -3.0]), (20, [1e20, 2.0, -3.0]), (3, [-1e20, 7.0, 1.0]), (4, [9e15, 1.5, 0.1]), (5, [9e15, 1.25, 0.1]), (40, [3e7, 2.0, 1.0]), (7, [1e300, -1e300, 1e300]), (8, [0.5, 0.25, 0.0])]
    rows += [(100 + i, [1e9 + i / 64, 1e9, float(i)]) for i in range(30)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in kdtree_topk.search(table, every=20, shard_rows=9, leaf=2).collect()}
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
    for q in (0, 20, 40, 100, 120):
        fits = lambda s: max(-(2**63), min(2**63 - 1, s))  # a score beyond a long counts as the nearest one
        top = sorted((-fits(sum(a * b for a, b in zip(whole[q], whole[c]))), c) for c in whole if c != q)[:5]
        assert [got[q, n + 1] for n in range(5)] == [(c, -s) for s, c in top]


def test_permutation_index(spark):
    table = odd_vectors(spark)
    got = permutation_ann.search(table, k=8, share=1.0, prefix=1024, front=1024, shard_rows=40, block_rows=3).collect()
    assert {(r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in got} == brute(table, 20, 8, False, lambda v: v)
    assert permutation_ann.search(table.limit(0)).count() == 0
    for sf in ("sf0.01", "sf0.1"):  # with the query's own parameters
        big = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
        got = {(r.query_id, r.vec_id) for r in permutation_ann.search(big).collect()}
        want = {(q, v) for q, _, v, _ in brute(big, 20, 20, False, lambda v: v)}
        assert len(got & want) / len(want) >= 0.9


def test_inverted_files_hold_the_footrule():
    rng = np.random.default_rng(2)
    x, piv = rng.normal(size=(300, 16)), rng.normal(size=(100, 16))
    lists = permutation_ann.prefixes(x, piv, 12)
    assert (lists == np.argsort(-(x @ piv.T), axis=1, kind="stable")[:, :12]).all()
    files = permutation_ann.Files(lists, 100)
    for q in lists[:20]:
        found, far = files.near(q, 3)
        assert found.tolist() == [i for i, v in enumerate(lists) if set(v[:3]) & set(q)]  # rows outside the query's files are not touched
        assert len(found) < 300
        place = lambda v: {p: i for i, p in enumerate(v.tolist())}
        for i, d in zip(found, far):
            a, b = place(q), place(lists[i])
            assert d == sum(abs(a.get(p, 12) - b.get(p, 12)) for p in a.keys() | b.keys())
    assert files.near(lists[0], 12)[1].min() == 0


def test_shuffle_is_exact(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for rows in (50_000, 3):
        got = hyper_shuffle.shuffle(docs, shards=7, rows=rows).collect()
        want = {r.doc_id: (len(r.text.encode()) + 16, zlib.crc32(r.text.encode())) for r in docs.collect()}
        assert {r.doc_id: (r.size, r.text_crc32) for r in got} == want and len(got) == len(want)
        sizes = Counter(r.shard for r in got)
        assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 7
        for s, n in sizes.items():
            assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
        again = {(r.doc_id, r.shard, r.slot) for r in hyper_shuffle.shuffle(docs.repartition(5), shards=7, rows=rows).collect()}
        assert again == {(r.doc_id, r.shard, r.slot) for r in got}


def test_shuffle_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (1, None, 5), (None, "", 6), (3, "ü", 7)], "doc_id long, text string, shard int")
    got = hyper_shuffle.shuffle(docs).collect()
    assert sorted((r.size, r.text_crc32) for r in got) == [(16, 0), (16, 0), (16, 0), (18, zlib.crc32("ü".encode()))]
    assert len({(r.shard, r.slot) for r in got}) == 4 and {r.grown_shard for r in got} == {None}
    assert hyper_shuffle.shuffle(docs.limit(0)).count() == 0


def test_shuffle_spreads_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(hyper_shuffle, "NUMBERED", 700)
    docs = spark.range(6000).selectExpr("case when id % 3 < 2 then 7 else id end doc_id", "'same' text")
    got = hyper_shuffle.shuffle(docs, shards=6).collect()
    assert Counter(r.doc_id for r in got)[7] == 4000 and len({(r.shard, r.slot) for r in got}) == 6000
    per = Counter(r.shard for r in got if r.doc_id == 7)
    assert all(560 < per[s] < 780 for s in range(6))  # 667 each, and not next to each other
    runs = sorted((r.shard, r.slot, r.doc_id == 7) for r in got)
    assert sum(a[2] != b[2] for a, b in zip(runs, runs[1:])) > 2000


def test_hypergeometric_draws():
    rng, n = random.Random(1), 20_000
    for good, bad, draws in ((5, 7, 6), (400, 300, 50), (3, 1000, 20), (10**10, 10**10, 10**6)):
        x = np.array([hyper_shuffle.hypergeometric(rng, good, bad, draws) for _ in range(n)])
        mean = draws * good / (good + bad)
        var = mean * bad / (good + bad) * (good + bad - draws) / (good + bad - 1)
        assert abs(x.mean() - mean) < 5 * (var / n) ** 0.5 and 0.93 < x.var() / var < 1.07
    m = hyper_shuffle.matrix([10, 0, 33, 4], 5, 2)
    assert [sum(r) for r in m] == [10, 0, 33, 4] and sorted(map(sum, zip(*m))) == [9, 9, 9, 10, 10]
