"""Mixture-controlled packing: deficit round-robin over source queues.

Each source is a queue of tokens. Every window takes from each source its target share, in turns of a quantum of tokens; what rounding withholds is
the source's deficit, carried to the next window. The state of the round-robin after w windows has a closed form: the sources up to k have sent
floor(w * L * B / T) quanta, where B is their share of all T quanta. So any partition knows the deficits at any window without a replay of the
windows before it, and a document's pieces follow from its place in its source's queue alone: no text or token is shuffled.

That form needs sources of at least a quantum a window. Rarer ones form a group, the last in order, which is filled in the same way in windows
twice as long, the rarer ones among them again, and so on: each source stays within a few quanta of its share at any window.

It also needs queues that end together. By default the shares are those of all tokens, so they do. Given weights are kept as long as all their queues
last; where one ends, a new phase begins, in which the others keep their proportions among themselves. What is left of each queue beyond its last
whole quantum makes a last phase, with a quantum of one token.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, write_table

LENGTH = 2048
END = 1
#: Tokens that a source sends in one turn, where a caller wants pieces longer than single tokens: an eighth of a sequence.
QUANTUM = 256
#: Weights are whole multiples of one part in so many.
PARTS = 1_000_000
#: Sources, at most: their table goes through windows of one task a level. More raise an error.
MAX_SOURCES = 1_000_000
#: Texts encoded together.
BATCH = 256


class Encoder:
    """Ids of whole texts by a tokenizer file of the tokenizers library, as little-endian bytes.

    A plain byte-level BPE whose ids follow the order of its merges has the same ids by ranks, which tiktoken encodes several times faster. Texts
    that hold an added token, and all texts where the file is of another kind, go through the tokenizer itself, which is read when first needed.
    """

    def __init__(self, path: str) -> None:
        import json
        import re

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec.get("added_tokens") or []
        vocab = spec["model"]["vocab"]
        top = max([len(vocab) - 1, *(x["id"] for x in added), *(vocab.values() if isinstance(vocab, dict) else ())])
        self.dtype = np.dtype("<u2") if top < 1 << 16 else np.dtype("<u4")
        self.added = re.compile("|".join(re.escape(x["content"]) for x in added) or r"(?!)")
        self.ranked = self._ranked(spec)

    @functools.cached_property
    def tok(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _ranked(self, spec: dict):
        import tiktoken

        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain_kind = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and model["type"] == "BPE" and not model.get("ignore_merges")
        if not plain_kind:
            return None
        merges, vocab = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]], model["vocab"]
        if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
            return None
        # the byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(letters[c] for c in w): i for w, i in vocab.items() if i < 256 + len(merges)}
        #: fixed value: the word pattern of byte-level pre-tokenizers
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list = [None] * len(texts)
        whole = [i for i, t in enumerate(texts) if self.ranked is None or self.added.search(t)]
        for i, e in zip(whole, self.tok.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False) if whole else []):
            out[i] = np.array(e.ids, self.dtype).tobytes()
        return [np.array(self.ranked(t), self.dtype).tobytes() if x is None else x for t, x in zip(texts, out)]


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder for all tasks of a Python worker."""
    return Encoder(path)


def _tokens(docs: DataFrame, tokenizer: str, id_col: str, text: str, source: str, end: int | None) -> DataFrame:
    """(id, source, part, start, n, ids): start is the document's place among its source's tokens in its part (the task that read it)."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, sent = encoder(tokenizer), TaskContext.get().partitionId(), {}
        tail = b"" if end is None else np.array([end], enc.dtype).tobytes()
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                s = b.slice(at, BATCH)
                ids = [x + tail for x in enc.encode([t or "" for t in s.column(2).to_pylist()])]
                n, start = [len(x) // enc.dtype.itemsize for x in ids], []
                for key, k in zip(s.column(1).to_pylist(), n):
                    start.append(sent.get(key, 0))
                    sent[key] = start[-1] + k
                yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), pa.array([part] * len(n), pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array([enc.dtype.itemsize] * len(n), pa.int32())], names=["id", "source", "part", "start", "n", "ids", "width"])

    plain = docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"), F.col(text).alias("text"))
    kinds = dict(plain.dtypes)
    return plain.mapInArrow(run, f"id {kinds['id']}, source {kinds['source']}, part long, start long, n long, ids binary, width int")


def sent(window: int, upto: int, total: int, length: int) -> int:
    """Tokens that the first sources, with `upto` of all `total` tokens, have sent when `window` windows are full."""
    return min(upto, window * length * upto // total)


def _runs(start: int, n: int, low: int, high: int, total: int, length: int) -> Iterator[tuple[int, int, int]]:
    """(place, length, position) of n tokens from `start` on in the queue of a source that holds [low, high) of `total` tokens in windows of `length`.

    The queue grows with every window if the source sends at least a token a window, or if it is the first or the last in order.
    """
    queue = lambda x: sent(x, high, total, length) - sent(x, low, total, length)
    w = max(0, min(start * total // (length * (high - low)), total // length)) if n else 0
    while w and queue(w) > start:
        w -= 1
    done = 0
    while done < n:
        begin, stop = queue(w), queue(w + 1)
        take = min(n - done, stop - start - done)
        if take > 0:
            yield done, take, w * length + sent(w + 1, low, total, length) - sent(w, low, total, length) + start + done - begin
            done += take
        w += 1


def pieces(start: int, n: int, low: int, high: int, total: int, length: int, inner: Iterable[tuple[int, int, int, int]] = ()) -> Iterator[tuple[int, int, int, int]]:
    """(place in the document, length, sequence, offset) of n tokens from `start` on in the queue of a source that holds tokens [low, high) of all.

    `inner` are the levels (low, high, tokens, window) below that queue, the deepest first, where the source is one of a group. The last window
    is partly full: its tokens go to sequences of powers of two, largest first, which take no padding.
    """
    return cut(runs(start, n, low, high, total, length, inner), total, length)


def runs(start: int, n: int, low: int, high: int, total: int, length: int, inner: Iterable[tuple[int, int, int, int]] = ()) -> list[tuple[int, int, int]]:
    """(place, length, position) of n units of a queue, through the levels below it and its own."""
    out = [(0, n, start)]
    for level in [*inner, (low, high, total, length)]:
        out = [(at + a, k, p) for at, m, q in out for a, k, p in _runs(q, m, *level)]
    return out


def cut(placed: Iterable[tuple[int, int, int]], total: int, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(place, length, sequence, offset) of runs (place, length, position) in a stream of `total` tokens."""
    last = total // length  # the number of full windows
    cuts, at = [(0, last * length, length)], last * length
    for bit in range(length.bit_length() - 1, -1, -1):
        if total % length >> bit & 1:
            cuts.append((at, at + (1 << bit), 1 << bit))
            at += 1 << bit
    for at, k, p in placed:
        done = 0
        while done < k:
            c = next(i for i, (_, e, _) in enumerate(cuts) if p + done < e)
            size = cuts[c][2]
            window, offset = divmod(p + done - cuts[c][0], size)
            take = min(k - done, size - offset)
            yield at + done, take, window if not c else last + c - 1, offset
            done += take


def in_phase(a: int, b: int, begin: int, unit: int, base: int, own: tuple[int, int, int, int], inner: Iterable[tuple[int, int, int, int]], origin: int) -> Iterator[tuple[int, int, int]]:
    """(place, length, position in the whole stream) of a queue's tokens [a, b) that lie in a phase which takes the queue from token `begin` on in turns of `unit`."""
    first, stop = (a - begin) // unit, -(-(b - begin) // unit)
    for at, k, p in runs(first, stop - first, *own, inner):
        low, high = begin + (first + at) * unit, begin + (first + at + k) * unit
        x, y = max(a, low), min(b, high)
        yield x - origin, y - x, base + p * unit + x - low


def phases(own: dict, rest: int, weights: dict, quantum: int) -> list[tuple[int, int]]:
    """The ends of the phases, in order, as fractions (quanta, parts): virtual times at which a queue of `own` (tokens of each weighted source), or the
    group of all other sources with `rest` quanta, is empty. A queue sends `parts` quanta in a unit of that time."""
    parts = weight_parts(weights)
    ends = {(own[s] // quantum, parts[s]) for s in own if parts[s] and own[s] >= quantum}
    if rest:
        ends.add((rest, PARTS - sum(parts.values())) if PARTS > sum(parts.values()) else (rest, 1))
    return sorted(ends, key=lambda x: x[0] / x[1])


def weight_parts(weights: dict) -> dict:
    return {s: round(w * PARTS) for s, w in weights.items()}


def chains(sums: dict[int, int], length: int) -> dict[int, tuple[int, int, list[tuple[int, int, int, int]]]]:
    """For each level of sources its (tokens of it and of deeper ones, window) and the levels above, next one first, in the form of pieces().

    A source of level k sends at least one token, and less than two, in 2 ** k windows. The deeper levels are one group, the last in order, of
    the level above them; `sums` are the tokens of each level's own sources.
    """
    total, out, above = sum(sums.values()), {}, []
    rest = total
    for k in sorted(sums):
        window = -(-length * 2**k * rest // total)
        out[k] = (rest, window, list(above))
        above.insert(0, (sums[k], rest, rest, window))
        rest -= sums[k]
    return out


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", source: str = "source", length: int = LENGTH, end: int | None = END, quantum: int = 1, weights: dict | None = None) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source) for each piece; each token lies in exactly one piece.

    quantum: tokens of a turn, a divisor of length; pieces are about that long. weights: target shares of tokens by source (null is a source too), together
    1 at most; the other sources share what is left in proportion to their tokens, and without weights so do all, so that all queues end together. A
    weight of 0 puts a source behind all others.

    A null or empty text has the end token only (no piece where `end` is None); a very long one fills as many pieces as it needs; rows that repeat an id are
    packed each; extra columns, also of the result's names, are ignored; an empty table gives an empty result. More than MAX_SOURCES sources raise an error.
    """
    weights = dict(weights or {})
    if length % quantum or min(weights.values(), default=0) < 0 or sum(weight_parts(weights).values()) > PARTS:
        raise ValueError("quantum must divide length, and weights be shares that sum to 1 at most")
    toks = write_table(_tokens(docs, tokenizer, id_col, text, source, end), "tokens")
    per_part = toks.groupBy("source", "part").agg(F.sum("n").alias("m"))
    sources = write_table(per_part.groupBy("source").agg(F.sum("m").alias("own")).where("own > 0"), "sources")  # one row a source
    if sources.count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    listed = F.lit(False)
    for x in weights:
        listed = listed | F.col("source").eqNullSafe(F.lit(x))
    own = {r.source: r.own for r in sources.where(listed).collect()}  # as many as there are weights
    rest, tokens = sources.agg(F.coalesce(F.sum(F.when(~listed, F.floor(F.col("own") / F.lit(quantum)))), F.lit(0)).cast("long"), F.coalesce(F.sum("own"), F.lit(0))).first()
    parts = weight_parts(weights)
    ends = phases(own, rest, weights, quantum)
    turns = len(ends)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(source, phase, unit, from, n): the part of a source's queue that each phase takes, in units."""
        for b in batches:
            out = []
            for i, (name, size) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                whole, at = size // quantum, 0
                for j, (n, d) in enumerate(ends):
                    if name in parts:
                        upto = whole if parts[name] and whole * d <= n * parts[name] else n * parts[name] // d
                    else:  # of the group's quanta the same share for each
                        group = PARTS - sum(parts.values()) or 1
                        upto = min(whole, n * group * whole // (d * rest)) if rest else whole
                    if upto > at:
                        out.append((i, j, quantum, at * quantum, upto - at))
                        at = upto
                if whole > at:  # without a weight
                    out.append((i, turns, quantum, at * quantum, whole - at))
                if size % quantum:
                    out.append((i, turns + 1, 1, whole * quantum, size % quantum))
            cols = np.array(out, np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[:, 0])), *[pa.array(cols[:, j]) for j in range(1, 5)]], names=["s", "phase", "unit", "begin", "units"])

    kind = dict(sources.dtypes)["source"]
    queues = write_table(sources.select("source", "own").mapInArrow(split, f"s {kind}, phase long, unit long, begin long, units long"), "queues")
    # level: the least k with units * window * 2 ** k >= total, the bit length of a quotient
    ratio = F.expr(f"(total - 1) div (units * ({length} div unit))")
    ranked = queues.withColumn("total", F.sum("units").over(Window.partitionBy("phase"))).withColumn("level", F.when(ratio > 0, F.length(F.bin(ratio))).otherwise(0))
    high = F.sum("units").over(Window.partitionBy("phase", "level").orderBy(F.col("s").isNull(), "s"))
    shares = write_table(ranked.withColumn("high", high).withColumn("low", F.col("high") - F.col("units")), "shares")
    sums: dict[int, dict[int, int]] = {}
    unit_of: dict[int, int] = {}
    for r in shares.groupBy("phase", "unit", "level").agg(F.sum("units").alias("units")).collect():  # 64 rows a phase at most
        sums.setdefault(r.phase, {})[r.level] = r.units
        unit_of[r.phase] = r.unit
    levels, base, at = {}, {}, 0
    for j in sorted(sums):
        levels[j], base[j] = chains(sums[j], length // unit_of[j]), at
        at += sum(sums[j].values()) * unit_of[j]
    entry = F.struct("begin", "phase", "unit", "units", "low", "high", "level", "total")
    plan = shares.groupBy("s").agg(F.sort_array(F.collect_list(entry)).alias("plan"))  # a few rows a source: one a phase
    before = F.sum("m").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    placed = per_part.withColumn("base", F.coalesce(before, F.lit(0))).join(plan, F.col("source").eqNullSafe(F.col("s")))
    placed = write_table(placed.select(F.col("s").alias("ps"), F.col("part").alias("pp"), "base", "plan"), "parts")
    rows = toks.join(placed, (F.col("part") == F.col("pp")) & F.col("source").eqNullSafe(F.col("ps")))
    rows = rows.select("id", "source", (F.col("base") + F.col("start")).alias("start"), "n", "ids", "width", "plan")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols, of, out = [b.column(i).to_pylist() for i in range(2, 6)], [], []
            for i, (start, n, ids, width, entries) in enumerate(zip(*cols, b.column(6).to_pylist())):
                ids, found = np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes(), []
                for e in entries:
                    a, z = max(start, e["begin"]), min(start + n, e["begin"] + e["units"] * e["unit"])
                    if a < z:
                        window = length // e["unit"]
                        queue, span, above = levels[e["phase"]][e["level"]]
                        *inner, top = (e["low"], e["high"], queue, span), *above
                        if top[3] != window:  # no source is of level 0
                            inner, top = [*inner, top], (0, e["total"], e["total"], window)
                        found += in_phase(a, z, e["begin"], e["unit"], base[e["phase"]], top, inner, start)
                for at, k, seq, offset in cut(found, tokens, length):
                    of.append(i)
                    out.append((at, k, zlib.crc32(ids[4 * at : 4 * (at + k)]), n, seq, offset))
            data = np.array(out, np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int64())), *[pa.array(data[:, j]) for j in range(6)], b.column(1).take(pa.array(of, pa.int64()))], names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"])

    kinds = dict(rows.dtypes)
    out = rows.mapInArrow(run, f"id {kinds['id']}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source {kinds['source']}")
    return out.withColumnRenamed("id", id_col)
