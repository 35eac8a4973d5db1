"""A uniform shuffle into shards of exact sizes. DataFrame and SQL functions only.

The rows lie in logical partitions. How many rows each partition sends to each shard is drawn first, exactly as a uniform permutation would
have it: the matrix of counts is multivariate hypergeometric, with the partitions' sizes as row sums and the shards' sizes as column sums. Then
each partition permutes its rows locally and cuts them by its counts, the rows are exchanged, and each shard permutes again. The driver holds the
matrix only, which has at most MATRIX cells.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import write_table

SHARDS = 40
#: Rows that a logical partition, or a range of a shard's slots, is meant to hold, so no task sorts a whole shard.
ROWS = 50_000
#: Equal rows put out by one row of counts.
NUMBERED = 10_000
MIN_PARTITIONS, MATRIX = 64, 2_000_000


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Good ones among `draws` of good + bad without replacement: rejection for log-concave distributions around the mode, exact at any size."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    ln = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    log_p = lambda k: ln(good, k) + ln(bad, draws - k)
    top = log_p(mode)
    p = math.exp(top - ln(good + bad, draws))
    w = 1 + p / 2
    while True:
        y = rng.random() * w / p if rng.random() <= w / (1 + w) else (w + rng.expovariate(1)) / p
        x = mode + rng.choice((-1, 1)) * round(y)
        if low <= x <= high and rng.random() * min(1.0, math.exp(w - p * y)) <= math.exp(log_p(x) - top):
            return x


def matrix(row_sums: list[int], shards: int, seed: int) -> list[list[int]]:
    """Counts from each partition to each shard; column sums differ by one at most."""
    rng, total = random.Random(seed), sum(row_sums)
    room, out = [total // shards + (s < total % shards) for s in range(shards)], []
    for n in row_sums:
        row, rest, left = [], sum(room), n
        for s in range(shards):
            rest -= room[s]
            k = hypergeometric(rng, room[s], rest, left)
            row.append(k)
            left -= k
        room = [r - k for r, k in zip(room, row)]
        out.append(row)
    return out


def numbered(slim: DataFrame) -> DataFrame:
    """slim and `copy`: a number for each of several rows equal in all columns, 0 for all others.

    Equal rows are counted first, with partial sums, and each kind of them is put out again as often as it was counted, so no task sorts or holds a
    kind's rows, however many there are.
    """
    kinds = slim.groupBy("id", "size", "crc").agg(F.count(F.lit(1)).alias("m"))
    step = F.lit(NUMBERED)
    blocks = kinds.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, step))).withColumn("upto", F.least(F.col("from") + step, F.col("m")) - 1)
    blocks = write_table(blocks.select("id", "size", "crc", "from", "upto"), "kinds")
    return write_table(blocks.repartition("id", "size", "crc", "from").select("id", "size", "crc", F.explode(F.sequence("from", "upto")).alias("copy")), "numbered")


def shuffle(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shards: int = SHARDS, seed: int = 23, rows: int = ROWS) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for each row; the law is `rows`, so grown_shard is null.

    The shuffle follows from the ids, texts and seed, so reruns agree. Rows equal in id, size and checksum are told apart by a number given to
    each of them, so they are spread like any others. A null text has no bytes and crc32 0; very long texts only count. Extra columns, also of the result's
    names, are ignored; with fewer rows than shards some shards stay empty; an empty table gives an empty result.
    """
    spark, body = docs.sparkSession, F.coalesce(F.col(text), F.lit("")).cast("binary")
    slim = write_table(docs.select(F.col(id_col).alias("id"), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("crc")), "slim")
    slim = numbered(slim)
    n = slim.count()
    parts = max(1, min(MATRIX // shards, max(MIN_PARTITIONS, math.ceil(n / rows))))
    ranges = max(1, math.ceil(n / (shards * rows)))
    key = lambda k: F.xxhash64(F.lit(seed * 10 + k), F.col("id"), F.col("crc"), F.col("size"), F.col("copy"))
    slim = slim.withColumn("p", F.pmod(key(0), F.lit(parts)).cast("int"))
    counts = {r.p: r["count"] for r in slim.groupBy("p").count().collect()}  # at most `parts` rows
    cuts = []
    for p, row in enumerate(matrix([counts.get(p, 0) for p in range(parts)], shards, seed)):
        at, ends = 0, []
        for k in row:
            at += k
            ends.append(at)
        cuts.append({"p": p, "cuts": ends})
    table = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(cuts)), "array<struct<p: int, cuts: array<bigint>>>"))).withColumnRenamed("p", "mp")
    local = slim.withColumn("rn", F.row_number().over(Window.partitionBy("p").orderBy(key(1), "id", "crc", "size", "copy")).cast("long"))
    sent = local.join(F.broadcast(table), F.col("p") == F.col("mp"))  # at most MATRIX cells
    sent = sent.select("id", "size", "crc", "copy", F.size(F.filter("cuts", lambda c: c < F.col("rn"))).alias("shard"), F.pmod(key(2), F.lit(ranges)).cast("int").alias("range"))
    sent = write_table(sent, "sent")
    upto = Window.partitionBy("shard").orderBy("range")
    base = sent.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("m")).withColumn("base", F.sum("m").over(upto) - F.col("m"))
    base = write_table(base.select(F.col("shard").alias("bs"), F.col("range").alias("br"), "base"), "base")
    placed = sent.withColumn("rn", F.row_number().over(Window.partitionBy("shard", "range").orderBy(key(3), "id", "crc", "size", "copy")))
    placed = placed.join(base, (F.col("shard") == F.col("bs")) & (F.col("range") == F.col("br")))
    return placed.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", (F.col("base") + F.col("rn") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
