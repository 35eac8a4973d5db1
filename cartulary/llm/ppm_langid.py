"""Language identification by prediction by partial matching (PPM).

Each language has a variable-order tree of byte contexts with escape probabilities (method C, without exclusions). The statistics are frozen
after training, so the code length of a byte depends on the `order` bytes before it alone, and a text's exact code length under a language is
a sum over its bytes. The language with the shortest code wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batches, write_table

ORDER = 4
#: The classifier is fitted on at most this many labelled documents of each language, chosen by a hash of id and text, and of those on the first ones
#: by that hash up to TRAIN_BYTES bytes (the first one whole). Labels beyond the LANGS most frequent ones are not learned.
DOCS_PER_LANG = 300
TRAIN_BYTES = 8 << 20
LANGS = 500
#: Bytes scored at once; a longer text is scored in pieces, which changes nothing as contexts overlap.
PIECE = 1 << 20
UND = "und"

_MULT = np.uint64(0x9E3779B97F4A7C15)


class Table:
    """Keys (uint64) to row numbers, by open addressing; -1 for absent keys."""

    def __init__(self, keys: np.ndarray) -> None:
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.rows = np.full(1 << bits, -1, np.int32)
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):
            free = self.rows[at] < 0
            _, first = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.slots[at[won]], self.rows[at[won]] = keys[left[won]], left[won]
            lost = np.ones(len(left), bool)
            lost[won] = False
            left, at = left[lost], (at[lost] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULT) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        out = np.where(self.slots[at] == keys, self.rows[at], np.int32(-1))
        left = np.flatnonzero((out < 0) & (self.rows[at] >= 0))
        at = at[left]
        while len(left):
            at = (at + 1) & self.mask
            hit = self.slots[at] == keys[left]
            out[left[hit]] = self.rows[at[hit]]
            go = ~hit & (self.rows[at] >= 0)
            left, at = left[go], at[go]
        return out


@dataclass
class Model:
    langs: list[str]
    order: int
    grams: list[tuple[Table, np.ndarray]]  # by order k: grams of k + 1 bytes, bits in each language
    escapes: list[tuple[Table, np.ndarray]]  # by order k: contexts of k bytes, bits of an escape in each language


def _keys(data: np.ndarray, n: int) -> np.ndarray:
    """For each byte the key of the n bytes that end there (from position n - 1 on)."""
    out = data[n - 1 :].astype(np.uint64)
    for i in range(1, n):
        out |= data[n - 1 - i : len(data) - i].astype(np.uint64) << np.uint64(8 * i)
    return out


def _framed(texts: list[bytes], order: int) -> np.ndarray:
    pad = b"\n" * order
    return np.frombuffer(b"".join(pad + t for t in texts), np.uint8)


def train(texts: dict[str, list[bytes]], order: int = ORDER) -> Model | None:
    """Frozen statistics of texts by language; None where there is no text with a byte."""
    langs = sorted(x for x, t in texts.items() if any(t))
    if not langs:
        return None
    counts = []  # by language, by order k: (grams, counts)
    for lang in langs:
        data = _framed(texts[lang], order)
        inside = np.concatenate([np.r_[np.zeros(order, bool), np.ones(len(t), bool)] for t in texts[lang]])
        counts.append([np.unique(_keys(data, k + 1)[inside[k:]], return_counts=True) for k in range(order + 1)])
    grams, escapes = [], []
    for k in range(order + 1):
        keys = np.unique(np.concatenate([np.arange(256, dtype=np.uint64)] * (k == 0) + [c[k][0] for c in counts]))
        contexts = np.unique(keys >> np.uint64(8))
        esc = np.zeros((len(contexts), len(langs)))
        bits = np.zeros((len(keys), len(langs)))
        shorter = keys & np.uint64((1 << (8 * k)) - 1)
        for j in range(len(langs)):
            own, n = counts[j][k]
            total = np.zeros(len(contexts))
            kinds = np.zeros(len(contexts))
            of = np.searchsorted(contexts, own >> np.uint64(8))
            np.add.at(total, of, n)
            np.add.at(kinds, of, 1)
            known = total > 0
            esc[known, j] = np.log2((total[known] + kinds[known]) / kinds[known])
            mine = np.searchsorted(contexts, keys >> np.uint64(8))
            lower = grams[k - 1][1][grams[k - 1][0].find(shorter), j] if k else np.full(len(keys), 8.0)
            bits[:, j] = esc[mine, j] + lower
            at = np.searchsorted(keys, own)
            bits[at, j] = np.log2((total[of] + kinds[of]) / n)
        grams.append((Table(keys), bits.astype(np.float32) if k == order else bits))
        escapes.append((Table(contexts), esc.astype(np.float32)))
    return Model(langs, order, [(t, b.astype(np.float32)) for t, b in grams], escapes)


def code_bits(model: Model, texts: list[bytes]) -> np.ndarray:
    """Bits of each whole text (rows) under each language (columns)."""
    out = np.zeros((len(texts), len(model.langs)))
    pad, piece, size = b"\n" * model.order, [], 0
    for i, t in enumerate(texts):
        for at in range(0, len(t), PIECE):
            part = t[at : at + PIECE]
            piece.append((i, (pad + t[max(0, at - model.order) : at])[-model.order :] + part if model.order else part))
            size += len(part)
            if size >= PIECE:
                _score(model, piece, out)
                piece, size = [], 0
    if piece:
        _score(model, piece, out)
    return out


def _score(model: Model, pieces: list[tuple[int, bytes]], out: np.ndarray) -> None:
    n = model.order
    data = np.frombuffer(b"".join(p for _, p in pieces), np.uint8)
    keys = _keys(data, n + 1)
    bits = np.zeros((len(keys), len(model.langs)), np.float32)
    left = None
    for k in range(n, -1, -1):
        table, cost = model.grams[k]
        mine = keys if left is None else keys[left]
        mine = mine & np.uint64((1 << (8 * (k + 1))) - 1)
        row = table.find(mine)
        hit = row >= 0
        if left is None and hit.all():
            bits = cost[row]
            break
        at = np.flatnonzero(hit) if left is None else left[hit]
        bits[at] += cost[row[hit]]
        left = np.flatnonzero(~hit) if left is None else left[~hit]
        if not len(left):
            break
        contexts, esc = model.escapes[k]
        row = contexts.find(mine[~hit] >> np.uint64(8))
        bits[left[row >= 0]] += esc[row[row >= 0]]
    ends = np.cumsum([len(p) for _, p in pieces])
    starts = np.r_[0, ends[:-1]]  # a piece's own bytes begin n after its start, where keys begin too
    cuts = np.stack([starts, ends - n], 1).ravel()
    sums = np.add.reduceat(np.vstack([bits, np.zeros((1, bits.shape[1]), np.float32)]), np.minimum(cuts, len(bits)), axis=0, dtype=np.float64)[::2]
    np.add.at(out, [i for i, _ in pieces], sums)


def sample(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", docs_per_lang: int = DOCS_PER_LANG, train_bytes: int = TRAIN_BYTES, langs: int = LANGS) -> dict[str, list[bytes]]:
    """The bounded training sample: for each of the `langs` most frequent non-null labels up to docs_per_lang whole non-empty texts, the first by hash."""
    told = docs.where(F.col(lang).isNotNull() & (F.length(text) > 0))
    key = F.xxhash64(F.lit(7), F.col(id_col), F.crc32(F.col(text).cast("binary")))
    keyed = told.select(F.col(lang).alias("lang"), key.alias("h"), F.octet_length(text).cast("long").alias("n"))
    # counts of 256 ranges of the hash tell which ranges hold the first texts, so only these are ranked by language
    keyed = write_table(keyed.withColumn("range", F.shiftright("h", 56)), "lang_keys")
    counts = write_table(keyed.groupBy("lang", "range").count(), "lang_counts")
    named = counts.groupBy("lang").agg(F.sum("count").alias("all")).orderBy(F.desc("all"), "lang").limit(langs)
    upto = F.sum("count").over(Window.partitionBy("lang").orderBy("range"))
    ranges = counts.withColumn("upto", upto).where(F.col("upto") - F.col("count") < docs_per_lang).join(F.broadcast(named.select("lang")), "lang", "left_semi")
    near = keyed.join(F.broadcast(ranges.select("lang", "range")), ["lang", "range"], "left_semi")  # 256 rows a language at most
    # rows of the same text and id count once
    best = Window.partitionBy("lang").orderBy("h")
    chosen = near.groupBy("lang", "h").agg(F.max("n").alias("n")).withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= docs_per_lang)
    chosen = chosen.withColumn("upto", F.sum("n").over(best)).where((F.col("rn") == 1) | (F.col("upto") <= train_bytes)).select("lang", "h")
    chosen = write_table(chosen, "lang_sample")  # langs * docs_per_lang rows at most
    found = told.select(F.col(lang).alias("lang"), F.col(text).alias("text"), key.alias("h")).join(F.broadcast(chosen), ["lang", "h"], "left_semi")
    out: dict[str, dict[int, bytes]] = {}
    for r in found.groupBy("lang", "h").agg(F.min("text").alias("text")).collect():  # train_bytes a language, or one text
        out.setdefault(r.lang, {})[r.h] = r.text.encode()
    return {x: [t for _, t in sorted(texts.items())] for x, texts in sorted(out.items())}


#: Names of the columns that predict() adds.
PREDICTED = ("lang_pred", "lang_score", "lang_bits")


def predict(docs: DataFrame, model: Model | None, text: str = "text", names: tuple[str, str, str] = PREDICTED) -> DataFrame:
    """docs and columns `names`, by default lang_pred, lang_score (the winner's share of the languages' likelihoods, uniform prior), lang_bits (its bits for each byte).

    Only the whole text is read. A text that is null or has no letter, and any text where nothing was learned, gives `und`, 0 and null.
    Ties go to the first language in code point order.
    """
    arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample, some MB
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter, m = regex.compile(r"\p{L}"), shared.value
        for b in batches:
            texts = b.column(at).to_pylist()
            ok = [i for i, t in enumerate(texts) if m and t and letter.search(t)]
            pred, score, mean = [UND] * len(texts), [0.0] * len(texts), [None] * len(texts)
            if ok:
                raw = [texts[i].encode() for i in ok]
                bits = code_bits(m, raw)
                best = bits.argmin(1)
                share = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
                for i, w, s, x, t in zip(ok, best.tolist(), share.tolist(), bits.min(1).tolist(), raw):
                    pred[i], score[i], mean[i] = m.langs[w], s, x / len(t)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(mean, pa.float64())], names=[*b.schema.names, *names])

    more = [T.StructField(c, k) for c, k in zip(names, (T.StringType(), T.DoubleType(), T.DoubleType()))]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *more]))


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 3, is 1; a null id counts as not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", order: int = ORDER) -> Model | None:
    """A model of the documents that are not held out."""
    return train(sample(docs.where(~held_out(id_col)), id_col, text, lang), order)


def identify(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", order: int = ORDER) -> DataFrame:
    """(id, held_out, lang_pred, score) for each row of docs.

    A null id is not held out; a null text, or one without a letter, is `und`; very long texts are scored whole, in pieces. Of several languages that
    code a text alike the first by code point wins. Repeated rows stay repeated; extra columns, also of the result's names, are ignored; an empty table
    gives an empty result.
    """
    model = fit(docs, id_col, text, lang, order)
    return predict(docs.select(id_col, text), model, text).select(id_col, held_out(id_col).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_bits").alias("bits_per_byte"))


#: A document goes where its language is unknown, the winner has less than half of the likelihood, or no language codes it better than raw bytes do.
MIN_SCORE, MAX_BITS = 0.5, 8.0


def keep_known(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of docs with a recognised language; the columns are those of docs, whatever their names."""
    cols = docs.columns
    pred, score, bits = names = tuple(f"__ppm_{c}" for c in PREDICTED)
    return predict(docs, fit(docs, id_col, text, lang), text, names).where((F.col(pred) != UND) & (F.col(score) >= MIN_SCORE) & (F.col(bits) <= MAX_BITS)).select(*cols)
