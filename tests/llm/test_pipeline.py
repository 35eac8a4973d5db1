"""The corpus pipeline against a brute-force version of its stages."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
from cartulary.llm import common
from cartulary.llm.queries import tokenizer_path
from test_text_ops import brute_bits, brute_components, brute_fp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, fp long, whole int, u double, size string"


def rows_of(small_docs):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in small_docs if len(r.text) < 600][:70]
    rows += [(9000, None, "en", "src1"), (9001, "", "de", None), (9002, "123 !!", None, "src1"), (9003, rows[0][1], "en", None), (None, "words without any id in the table", "en", "src2"), (None, None, None, None)]
    rows += [rows[3], rows[3], (9004, "ÄÖ ß " * 40, None, "é"), (9005, "퟿一二三" * 30, None, "src3"), (9006, rows[5][1] + " x", "en", "src1")]
    return [(*r, 0, "c", 1, 2, 0.5, "z") for r in rows]


def brute_known(rows):
    train = defaultdict(list)
    for i, t, lang, *_ in rows:
        held = i is not None and zlib.crc32(str(i).encode()) % 3 == 1
        if lang is not None and t and not held and (i, t) not in [(a, b) for a, b, x in train[lang]]:
            train[lang].append((i, t, lang))
    langs = sorted(train)
    bits = brute_bits([(r[1] or "").encode() for r in rows], 4, [[t.encode() for _, t, _ in train[x]] for x in langs])
    out = []
    for r, b in zip(rows, bits):
        if r[1] and any(c.isalpha() for c in r[1]):
            share = 1 / np.exp2(np.maximum(b.min() - b, -1000)).sum()
            if share >= 0.5 and b.min() / len(r[1].encode()) <= 8:
                out.append(r)
    return out


def brute_one(rows):
    fps = [brute_fp(r[1]) for r in rows]
    comp, best = brute_components(fps, 4), {}
    for at, (r, f) in enumerate(zip(rows, fps)):
        key = (r[0] is None, r[0] if r[0] is not None else 0, at)
        best[comp[f]] = min(best.get(comp[f], (key, at)), (key, at))
    return [rows[at] for _, at in sorted(best.values(), key=lambda x: x[1])]


def brute_mix(rows):
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    total = defaultdict(int)
    for r in rows:
        total[r[3]] += size(r)
    names = sorted(total, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), 1.5 * sum(total.values()), set(names)
    while open_ and left > 1e-9:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        full = {s for s in open_ if target[s] + share[s] >= 2 * total[s]}
        for s in open_:
            new = 2.0 * total[s] if s in full else target[s] + share[s] if not full else target[s]
            left -= new - target[s]
            target[s] = new
        if not full:
            break
        open_ -= full
    taken = Counter()
    for s in names:
        mine = [(at, r, size(r)) for at, r in enumerate(rows) if r[3] == s and size(r)]
        classes = defaultdict(int)
        for _, _, n in mine:
            classes[n.bit_length()] += n
        a = {k: 2.0 ** -(k // 2) for k in classes}
        low, high = 0.0, 4.0**40
        for _ in range(400):  # the scale of expected copies, by halving
            c = (low + high) / 2
            low, high = (c, high) if sum(min(2, c * a[k]) * n for k, n in classes.items()) < target[s] else (low, c)
        expected = {k: min(2.0, low * a[k]) for k in classes}
        expected = {k: 2.0 if e > 2 - 1e-9 else e for k, e in expected.items()}
        rest, drawn = target[s], []
        for at, r, n in mine:
            e = expected[n.bit_length()]
            taken[at] += int(e)
            rest -= int(e) * n
            u = (int(hashlib.md5(f"{'' if r[0] is None else r[0]}:11".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            p = e - int(e)
            if p:
                drawn.append(((u / (1 - u)) / (p / (1 - p)), n, at))
        drawn.sort()
        upto, cut = 0, -1.0
        for q, n, _ in drawn:
            upto += n
            if upto - n < rest and abs(upto - rest) <= abs(upto - n - rest):
                cut = q
        for q, _, at in drawn:
            taken[at] += q <= cut
    return [rows[at] for at in sorted(taken) for _ in range(taken[at])]


def check_pieces(pieces, rows):
    from tokenizers import Tokenizer

    tok, seqs, cover = Tokenizer.from_file(tokenizer_path()), defaultdict(list), defaultdict(Counter)
    ids = {(r[0], r[1]): [*tok.encode(r[1], add_special_tokens=False).ids, 1] for r in rows}
    by_id = defaultdict(list)
    for (i, _), v in ids.items():
        by_id[i].append(v)
    for p in pieces:
        seqs[p.sequence_id].append(p)
        fits = [v for v in by_id[p.doc_id] if len(v) == p.doc_tokens and zlib.crc32(np.array(v[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32]
        assert fits
        cover[p.doc_id, p.doc_tokens].update(range(p.start, p.start + p.length))
    want = Counter((r[0], len(ids[r[0], r[1]])) for r in rows)
    assert cover.keys() == want.keys() and all(set(cover[k].values()) == {n} and len(cover[k]) == k[1] for k, n in want.items())
    for v in seqs.values():
        at = 0
        for p in sorted(v, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048 and at.bit_count() == 1
    assert sorted(seqs) == list(range(len(seqs)))


def test_pipeline_against_brute_force(spark, small, tmp_path):
    rows = rows_of(spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect())
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs, want = spark.read.parquet(f"{tmp_path}/documents.parquet"), rows
    key = lambda rs: Counter(tuple(r) for r in rs)
    for (name, stage), brute in zip(corpus_pipeline.STAGES, (brute_known, brute_one, brute_mix)):
        docs, want = common.write_table(stage(spark, docs, str(tmp_path)), name), brute(want)
        assert docs.columns == [x.split()[0] for x in SCHEMA.split(", ")]
        assert key(docs.collect()) == key(want), name
        assert 0 < len(want)
    assert len(brute_known(rows)) < len(rows)
    check_pieces(corpus_pipeline.STAGES[3][1](spark, docs, str(tmp_path)).collect(), want)
    check_pieces(corpus_pipeline.run(spark, str(tmp_path)).collect(), want)


def test_stages_of_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0, name


def test_scratch_tables_are_deleted(spark):
    with common.scratch() as kept:
        gone, stays = common.write_table(spark.range(3).toDF("a"), "gone"), common.write_table(spark.range(4).toDF("a"), "stays")
        kept.append(stays)
    path = lambda t: t._cartulary_path.removeprefix("file:")
    assert not os.path.exists(path(gone)) and stays.count() == 4
    common.drop_table(stays)
    assert not os.path.exists(path(stays))
