"""SimHash near-duplicates: 64-bit fingerprints linked within a radius by BK-trees.

Fingerprints are sharded by the pigeonhole principle: of `radius + k` blocks of bits, two fingerprints within the radius agree on some k, so
each fingerprint goes to one shard for each choice of k blocks and meets all its partners there. A shard's tree is a BK-tree: children are keyed
by their integer Hamming distance to the parent, and a search follows only the edges within the radius. A shard tree is sent to the task
that holds the shard's own fingerprints, not to all tasks: the shards of a large corpus together have no size bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batches, components, join_hot, write_table

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Fingerprints of a shard in one task; a larger shard is dealt as pairs of chunks of about this size, so its memory is bounded and no pair is lost.
SHARD_ROWS = 4096


def fingerprint(data: bytes | None, shingle: int = SHINGLE) -> int:
    """The unsigned SimHash of a text in UTF-8: words are runs without ASCII white space, A-Z are lower-cased, no word gives 0."""
    from xxhash import xxh64_intdigest

    words = (data or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
    n = len(starts)
    h = np.array([xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :].tolist())], np.uint64)
    total = np.zeros(64, np.int64)
    for at in range(0, n, 255):  # sums of up to 255 bits stay in a byte
        bits = np.unpackbits(h[at : at + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """df and a column `out`: the fingerprint of its text as a signed long. Other columns pass through unchanged; a null text counts as empty."""
    arrow_batches(df.sparkSession)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x, shingle) for x in b.column(at).cast(pa.binary()).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps, pa.int64())], names=[*b.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.LongType())]))


def shard_keys(radius: int, agree: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number, [(shift, width)]) for each choice of `agree` of `radius + agree` blocks of the 64 bits."""
    n = radius + agree
    cuts = [64 * i // n for i in range(n + 1)]
    return [(k, [(cuts[i], cuts[i + 1] - cuts[i]) for i in c]) for k, c in enumerate(combinations(range(n), agree))]


class BKTree:
    """Integers; children are keyed by their Hamming distance to the parent."""

    def __init__(self) -> None:
        self.keys: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, x: int) -> None:
        self.keys.append(x)
        self.children.append({})
        at, new = 0, len(self.keys) - 1
        while new:
            at2 = self.children[at].setdefault((self.keys[at] ^ x).bit_count(), new)
            if at2 == new:
                return
            at = at2

    def within(self, x: int, radius: int) -> list[int]:
        """Positions of the keys within the radius."""
        keys, children, found, stack = self.keys, self.children, [], [0] if self.keys else []
        while stack:
            i = stack.pop()
            d = (keys[i] ^ x).bit_count()
            if d <= radius:
                found.append(i)
            lo, hi = d - radius, d + radius
            for k, c in children[i].items():
                if lo <= k <= hi:
                    stack.append(c)
        return found


def shard_links(own: list[int], other: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that join what is within the radius in a shard: own with own, or, where `other` is given, own with other. At most one for each fingerprint."""
    tree, parent = BKTree(), {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    links = []

    def join(x: int, hits: list[int]) -> None:
        for i in hits:
            a, b = root(x), root(tree.keys[i])
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((x, tree.keys[i]))

    for x in own:
        if not other:
            join(x, tree.within(x, radius))
        tree.add(x)
    for x in other:
        join(x, tree.within(x, radius))
    return links


def agreement(n: int, radius: int, shard_rows: int) -> int:
    """The fewest blocks to agree on with which a shard of n evenly spread fingerprints holds about shard_rows or less: shards hold n / 2 ** (64 * k / (radius + k))."""
    return next((k for k in range(1, 64 - radius) if n >> (64 * k // (radius + k)) <= shard_rows), 64 - radius)


def links(fps: DataFrame, radius: int = RADIUS, agree: int | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp`, at least one path for each pair within the radius.

    agree: blocks that a shard's fingerprints share, by default as many as their number asks for. Any choice finds the same links' components.
    """
    spark, col = fps.sparkSession, F.col("fp")
    agree = agree or agreement(fps.count(), radius, shard_rows)

    def value(blocks: list[tuple[int, int]]):
        out = F.lit(0).cast("long")
        for shift, width in blocks:
            out = F.shiftleft(out, width).bitwiseOR(F.shiftrightunsigned(col, shift).bitwiseAND(F.lit((1 << width) - 1)))
        return out

    keys = [F.struct(F.lit(k).alias("k"), value(b).alias("v")) for k, b in shard_keys(radius, agree)]
    rows = fps.select("fp", F.explode(F.array(*keys)).alias("s")).select("fp", "s.k", "s.v")
    hot = write_table(rows.groupBy("k", "v").count().where(F.col("count") > shard_rows).select("k", "v", F.ceil(F.col("count") / shard_rows).cast("int").alias("parts")), "hot")
    rows = rows.join(hot, ["k", "v"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    rows = rows.withColumn("met", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("k", "v", F.least("own", "met").alias("i"), F.greatest("own", "met").alias("j"), (F.col("own") > F.col("met")).cast("int").alias("side"), "fp")
    by = ["k", "v", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides, found = None, ([], []), []

        def close() -> None:
            if key is not None and len(sides[0]) + len(sides[1]) > 1 and (key[2] == key[3] or all(sides)):
                found.extend(shard_links(*sides, radius))

        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(5)]
            for *k, side, fp in zip(*cols, b.column(5).to_numpy().view(np.uint64).tolist()):
                if k != key:
                    close()
                    key, sides = k, ([], [])
                sides[side].append(fp)
            if found:
                yield out(found)
                found = []
        close()
        if found:
            yield out(found)

    def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
        pairs = np.array(found, np.uint64).view(np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *by).sortWithinPartitions(*by, "side").mapInArrow(run, "a long, b long")


def clusters(hashed: DataFrame, id_col: str = "doc_id", radius: int = RADIUS, agree: int | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(fp, component_id, rows) for each distinct fp of a table with `fp` and id_col; rows is the number of its rows, component_id is the smallest id reachable over links, null where none has an id."""
    fps = write_table(hashed.groupBy("fp").agg(F.min(id_col).alias("least_id"), F.count(F.lit(1)).alias("rows")), "fps")
    comp = write_table(components(links(fps, radius, agree, shard_rows)), "comp")
    named = write_table(comp.join(fps, comp.node == fps.fp).select("fp", "comp", "least_id"), "named")
    least = write_table(named.groupBy("comp").agg(F.min("least_id").alias("component_id")), "least")
    linked = write_table(named.join(least, "comp").select("fp", "component_id"), "linked")
    return fps.join(linked.withColumnRenamed("fp", "lfp"), F.col("fp") == F.col("lfp"), "left").select("fp", F.when(F.col("lfp").isNull(), F.col("least_id")).otherwise(F.col("component_id")).alias("component_id"), "rows")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, agree: int | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(id, fp, component_id) for each row: rows link where their fingerprints differ in at most `radius` bits.

    Null and empty texts have fingerprint 0 and link like any other; very long texts are hashed whole; rows with a null id keep their row and bridge
    links, and a component without any id has a null one; repeated rows stay repeated; extra columns, also of the result's names, are ignored; an
    empty table gives an empty result.
    """
    hashed = write_table(with_fingerprint(docs.select(F.col(id_col), F.col(text)), text, "fp", shingle).select(id_col, "fp"), "hashed")
    members = write_table(clusters(hashed, id_col, radius, agree, shard_rows), "members")
    members = members.withColumnRenamed("fp", "__fp")
    return join_hot(hashed, members, [("fp", "__fp")], "rows", hashed.count()).select(id_col, "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS, agree: int | None = None) -> DataFrame:
    """docs with one row of each component: that of the smallest id (rows with an id first, then in the table's order). The columns are those of docs."""
    cols = docs.columns
    table = write_table(with_fingerprint(docs.withColumn("__row", F.monotonically_increasing_id()), text, "__fp"), "docs_hashed")
    # ids may repeat or be null, row numbers may not
    order = F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), F.col("__row").alias("r"))
    kept = clusters(table.select(order.alias("order"), F.col("__fp").alias("fp")), "order", radius, agree)
    kept = write_table(kept.select(F.col("component_id.r").alias("__row")).distinct(), "kept")
    # a merge join at every size: the list of kept rows grows with the table, so it is never broadcast
    return table.join(kept.hint("merge"), "__row", "left_semi").select(*cols)
