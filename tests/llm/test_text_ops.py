"""Language ID, SimHash, mixing and packing against brute force and on odd input."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from cartulary.llm import common, drr_pack, pareto_mix, ppm_langid, simhash_bk
from cartulary.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, start string, size string"


def odd_docs(spark):
    long = "palabra und the " * 20_000
    rows = [(1, "The same text of five words", "en", "a"), (2, "The same text of five words", "en", "a"), (3, None, None, None), (4, "", "de", "b"), (5, "123 !!", None, "b"), (6, long, "es", None), (None, "no id at all here", "en", "a"), (8, "the same text of five WORDS", "en", "é"), (8, "the same text of five WORDS", "en", "é"), (9, " double  spaces\tand\n\nlines <|endoftext|> x ", "en", "a")]
    return spark.createDataFrame([(*r, 0, "x", "y", "z") for r in rows], DOCS)


def brute_fp(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    sh = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius):
    keys = sorted(set(fps))
    parent = {k: k for k in keys}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= radius:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {k: root(k) for k in keys}


def test_simhash_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = docs.collect()
    fp = [brute_fp(r.text) for r in rows]
    comp = brute_components(fp, 4)
    least = {}
    for r, f in zip(rows, fp):
        least[comp[f]] = min(r.doc_id, least.get(comp[f], r.doc_id))
    want = {r.doc_id: (f, least[comp[f]]) for r, f in zip(rows, fp)}
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash_bk.near_duplicates(docs).collect()}
    assert got == want


@pytest.mark.parametrize(("agree", "shard_rows"), [(1, 4096), (1, 7), (2, 4096), (3, 5), (None, 4096), (None, 3)])
def test_links_of_dense_groups(spark, agree, shard_rows):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = set(base)
    for b in base[:2]:
        for _ in range(60):  # chains and clouds around a centre
            b2 = b
            for _ in range(rng.randint(1, 9)):
                b2 ^= 1 << rng.randrange(64)
            fps.add(b2)
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)), i) for i, f in enumerate(fps)], "fp long, doc_id long")
    got = {r.fp % 2**64: r.component_id for r in simhash_bk.clusters(df, "doc_id", 4, agree, shard_rows).collect()}
    comp = brute_components(fps, 4)
    least = {}
    for i, f in enumerate(fps):
        least.setdefault(comp[f], i)
    assert got == {f: least[comp[f]] for f in fps}


def test_simhash_odd_rows(spark):
    docs = odd_docs(spark)
    got = simhash_bk.near_duplicates(docs).collect()
    assert len(got) == 10
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.fp, r.component_id))
    assert by[3] == [(0, 3)] and by[4] == [(0, 3)] and by[1] == by[2] and len(by[8]) == 2 and by[8][0][1] == 1 and len(by[None]) == 1
    kept = simhash_bk.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == [1, 3, 5, 6, 9] and kept.where("doc_id is null").count() == 1
    assert simhash_bk.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    n = 300
    ids = list(range(n))
    random.Random(1).shuffle(ids)
    edges = spark.createDataFrame(list(zip(ids, ids[1:])) + [(1000, 1001)], "a long, b long")
    got = {r.node: r.comp for r in common.components(edges).collect()}
    assert got == {**dict.fromkeys(range(n), 0), 1000: 1000, 1001: 1000}


def brute_bits(texts, order, lang_texts):
    """Exact code lengths by counting with dictionaries."""
    out = []
    for train in lang_texts:
        count = defaultdict(lambda: defaultdict(int))
        for t in train:
            p = b"\n" * order + t
            for i in range(order, len(p)):
                for k in range(order + 1):
                    count[p[i - k : i]][p[i]] += 1
        row = []
        for t in texts:
            p, bits = b"\n" * order + t, 0.0
            for i in range(order, len(p)):
                for k in range(order, -1, -1):
                    seen = count.get(p[i - k : i])
                    if seen:
                        n, d = sum(seen.values()), len(seen)
                        if p[i] in seen:
                            bits += np.log2((n + d) / seen[p[i]])
                            break
                        bits += np.log2((n + d) / d)
                else:
                    bits += 8
            row.append(bits)
        out.append(row)
    return np.array(out).T


def test_ppm_code_lengths_are_exact(monkeypatch):
    train = {"en": [b"the cat sat on the mat", b"then the hen"], "xx": [b"zyzzy zyx", "ñandú".encode()]}
    texts = [b"the zebra sat", "ñ the".encode(), b"\x00\xff", b"a", b"the cat sat on the mat " * 30]
    model = ppm_langid.train(train, 3)
    want = brute_bits(texts, 3, [train[x] for x in model.langs])
    assert np.allclose(ppm_langid.code_bits(model, texts), want, rtol=1e-5)
    monkeypatch.setattr(ppm_langid, "PIECE", 17)
    assert np.allclose(ppm_langid.code_bits(model, texts), want, rtol=1e-5)


def test_langid_accuracy_and_hold_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in ppm_langid.identify(docs).collect()}
    rows = docs.collect()
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if got[r.doc_id].held_out]
    right = sum(got[r.doc_id].lang_pred == r.lang for r in held)
    assert right / len(held) >= 0.97
    assert ppm_langid.keep_known(docs).count() >= 0.99 * len(rows)


def test_langid_odd_rows(spark):
    docs = odd_docs(spark)
    got = {r.doc_id: r for r in ppm_langid.identify(docs).collect()}
    assert [got[i].lang_pred for i in (3, 4, 5)] == ["und"] * 3 and got[3].score == 0.0
    assert got[6].lang_pred != "und" and 0 <= got[6].score <= 1
    kept = ppm_langid.keep_known(docs)
    assert kept.columns == docs.columns
    assert ppm_langid.identify(docs.limit(0)).count() == 0
    clash = docs.selectExpr("*", "1 lang_pred", "2 lang_score", "3 lang_bits", "4 held_out", "5 h", "6 score")
    assert ppm_langid.keep_known(clash).columns == clash.columns and ppm_langid.keep_known(clash).count() == kept.count()
    assert ppm_langid.identify(clash).count() == docs.count()
    # several texts of one id, and long ones, are sampled by hash alone; reruns agree
    twice = docs.unionByName(docs.selectExpr("doc_id", "concat(text, ' more') text", "lang", "source", "n_chars", "fp", "start", "size"))
    assert ppm_langid.sample(twice) == ppm_langid.sample(twice.repartition(3)) and len(ppm_langid.sample(twice)["en"]) == 10
    assert [len(t) for t in ppm_langid.sample(twice, train_bytes=1).values()] == [1] * 3 and len(ppm_langid.sample(twice, langs=1)) == 1
    unlabelled = ppm_langid.identify(docs.drop("lang").selectExpr("*", "cast(null as string) lang"))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}


def test_mix_targets_and_totals(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = pareto_mix.mix(docs).collect()
    assert len(got) == 1000
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert r.taken <= 2 * r.size and (not r.size or r.taken % r.size == 0)
    total = sum(r.size for r in got)
    assert abs(sum(v[0].target for v in by.values()) - 1.5 * total) < 1e-6 * total
    for v in by.values():
        assert abs(sum(r.taken for r in v) - v[0].target) <= max(r.size for r in v)
    again = {(r.doc_id, r.taken) for r in pareto_mix.mix(docs.repartition(7), ).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}
    rows = pareto_mix.mixed(docs)
    assert rows.columns == docs.columns
    assert rows.groupBy("doc_id").count().count() == sum(r.taken > 0 for r in got)
    assert rows.count() == sum(r.taken // r.size for r in got if r.size)


def test_mix_inclusion_follows_size(spark):
    sizes = {0: 2, 1: 20, 2: 300}  # size classes 2, 5 and 9: relative copies 1/2, 1/4 and 1/16
    docs = spark.range(6000).selectExpr("id as doc_id", "repeat('w ', case id % 3 when 0 then 2 when 1 then 20 else 300 end) text", "'a' source")
    words = {n: 2000 * n for n in sizes.values()}
    got = pareto_mix.mix(docs, total_share=0.3, seed=5).collect()
    target = got[0].target
    assert abs(target - 0.3 * sum(words.values())) < 1e-6 and abs(sum(r.taken for r in got) - target) <= 150
    mean = lambda n: sum(r.taken for r in got if r.size == n) / words[n]
    c = target / (words[2] / 2 + words[20] / 4 + words[300] / 16)
    assert all(abs(mean(n) - c * a) < 0.05 for n, a in ((2, 1 / 2), (20, 1 / 4), (300, 1 / 16))) and 1.9 < c / 2 < 2
    assert {r.taken // r.size for r in got if r.size == 2} == {1, 2}  # one certain copy, and another by lot
    plain = pareto_mix.ranked(pareto_mix.slim_table(docs, "doc_id", "text", "source", 5), pareto_mix.plan(pareto_mix.slim_table(docs, "doc_id", "text", "source", 5), total_share=0.3)).where("q is not null").collect()
    cut = max(r.q for r in plain if r.q <= r.cut)
    assert any(r.u > s.u for r in plain[:500] for s in plain[:500] if r.q <= cut < s.q)  # the order is not that of the random numbers


def test_mix_ranges_do_not_matter(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    slim = pareto_mix.slim_table(docs, "doc_id", "text", "source", 11)
    a, b = (sorted(map(repr, pareto_mix.ranked(slim, pareto_mix.plan(slim, ranges=n)).select("doc_id", "target", pareto_mix.copies().alias("n")).collect())) for n in (1, 4096))
    assert a == b


def test_mix_odd_rows(spark):
    docs = odd_docs(spark)
    got = pareto_mix.mix(docs.drop("size")).collect()
    assert len(got) == 10 and {r.taken for r in got if r.doc_id in (3, 4)} == {0}
    assert pareto_mix.mix(docs.limit(0)).count() == 0
    assert {r.taken for r in pareto_mix.mix(docs.where("doc_id in (3, 4)")).collect()} == {0}
    assert pareto_mix.mixed(docs).columns == docs.columns


def check_packing(rows, docs, length=2048):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in docs}
    by, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id])
    for i, v in by.items():
        at = 0
        for r in sorted(v, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(ids[i])
    assert by.keys() == ids.keys()
    full = 0
    for v in seqs.values():
        at = 0
        for r in sorted(v, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= length and at.bit_count() == 1
        full += at == length
    assert sorted(seqs) == list(range(len(seqs)))
    return seqs


def test_packing_round_trip_and_shares(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = drr_pack.pack(docs, tokenizer_path()).collect()
    seqs = check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()])
    total, own = 0, defaultdict(int)
    for r in rows:
        own[r.source] += r.length
        total += r.length
    for s in range(total // 2048):
        got = defaultdict(int)
        for r in seqs[s]:
            got[r.source] += r.length
        assert all(abs(got[k] - 2048 * v / total) < 2 for k, v in own.items())


def lag(rows, weights, upto):
    """The largest distance of any source from its share at the end of any of the first `upto` sequences."""
    sent, worst, total = defaultdict(int), 0, 0
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    for s in range(upto):
        for r in by[s]:
            sent[r.source] += r.length
            total += r.length
        worst = max([worst, *(abs(sent[k] - w * total) for k, w in weights.items())])
    return worst


def test_packing_in_quanta(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = drr_pack.pack(docs, tokenizer_path(), quantum=256).collect()
    seqs = check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()])
    own = defaultdict(int)
    for r in rows:
        own[r.source] += r.length
    total = sum(own.values())
    assert lag(rows, {k: v / total for k, v in own.items()}, len(seqs) - 12) < 5 * 256
    # context is kept: a piece ends with its document, its turn or its sequence
    assert all((r.start + r.length == r.doc_tokens or (r.offset + r.length) % 256 == 0) for r in rows if r.sequence_id < len(seqs) * 0.9)
    assert len(rows) < 1.2 * (len(own) * 256 + total / 256 + docs.count())


@pytest.mark.parametrize("quantum", [1, 256])
def test_packing_follows_weights(spark, quantum):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    names = [r.source for r in docs.groupBy("source").count().orderBy("source").collect()]
    weights = {names[0]: 0.25, names[1]: 0.01, names[2]: 0.0}
    rows = drr_pack.pack(docs, tokenizer_path(), quantum=quantum, weights=weights).collect()
    seqs = check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()])
    own = defaultdict(int)
    for r in rows:
        own[r.source] += r.length
    assert lag(rows, weights, int(own[names[0]] / 0.25 / 2048) - 1) < 6 * quantum + 6  # as long as the first queue lasts
    # then only what is less than a quantum is left of it; the source without a weight comes after all others
    assert sum(r.length for r in rows if r.source == names[0] and r.sequence_id >= len(seqs) // 2) < quantum
    assert sum(r.length for r in rows if r.source == names[2] and r.sequence_id < len(seqs) * 0.6) == 0
    with pytest.raises(ValueError):
        drr_pack.pack(docs, tokenizer_path(), weights={names[0]: 1.2})


def test_packing_odd_rows(spark):
    docs = odd_docs(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    check_packing(drr_pack.pack(docs, tokenizer_path()).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    check_packing(drr_pack.pack(docs, tokenizer_path(), quantum=256, weights={None: 0.5, "b": 0.5}).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert drr_pack.pack(docs.limit(0), tokenizer_path()).count() == 0 == drr_pack.pack(docs.limit(0), tokenizer_path(), quantum=256, weights={"a": 0.1}).count()
    assert drr_pack.pack(odd_docs(spark), tokenizer_path()).where("doc_id is null").agg({"length": "sum"}).first()[0] > 1


@pytest.mark.parametrize("total", [1, 2047, 2048, 5000])
def test_pieces_fill_every_window(total):
    cuts = sorted({0, total, *random.Random(total).sample(range(total + 1), min(4, total))})
    seen = defaultdict(list)
    for low, high in zip(cuts, cuts[1:]):
        for start in range(0, high - low, 100):
            n = min(100, high - low - start)
            assert sum(k for _, k, _, _ in drr_pack.pieces(start, n, low, high, total, 2048)) == n
            for _, k, s, o in drr_pack.pieces(start, n, low, high, total, 2048):
                seen[s].append((o, k))
    for v in seen.values():
        at = 0
        for o, k in sorted(v):
            assert o == at
            at += k
        assert at.bit_count() == 1


@pytest.mark.parametrize("owns", [[1], [1] * 5000, [9000, 1, 1, 1], [3, 50_000, 7, 900, 20, 20, 1], [2048, 1, 4095]])
def test_rare_sources_stay_near_their_share(owns):
    total, by = sum(owns), defaultdict(list)
    for i, own in enumerate(owns):
        by[((total - 1) // (own * 2048)).bit_length()].append(i)
    levels = drr_pack.chains({k: sum(owns[i] for i in v) for k, v in by.items()}, 2048)
    place, got = {}, set()
    for k, v in by.items():
        low = 0
        for i in v:
            queue, window, above = levels[k]
            chain = [(low, low + owns[i], queue, window), *above]
            low += owns[i]
            place[i] = []
            for at, n, s, o in drr_pack.pieces(0, owns[i], 0, total, total, 2048, chain):
                assert at == len(place[i])
                place[i] += [s] * n
                assert not got & {(s, x) for x in range(o, o + n)}
                got |= {(s, x) for x in range(o, o + n)}
    assert len(got) == total
    for i, seqs in place.items():
        assert seqs == sorted(seqs)
        for w in range(total // 2048 + 1):
            assert abs(sum(s < w for s in seqs) - w * 2048 * owns[i] / total) < 5


def test_packing_many_rare_sources(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").selectExpr("doc_id", "text", "case when doc_id % 3 = 0 then source when doc_id % 31 = 0 then null else cast(doc_id as string) end source")
    check_packing(drr_pack.pack(docs, tokenizer_path()).collect(), [(r.doc_id, r.text) for r in docs.collect()])
