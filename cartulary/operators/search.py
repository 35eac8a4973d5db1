"""Hybrid search for a batch of queries: anchoring on identifiers, bonuses, the entity guarantee, and the assembly of a context."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..streaming.collect import written
from . import retrieval as I

#: The unit of a bonus: what the first place of one list is worth.
UNIT = 1 / (I.RRF_K + 1)
INJECTED = 2
BUDGET = 9000


def anchored(chunks: DataFrame, queries: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(q, i): the chunks (i, number, code) that queries (q, ids, codes) are restricted to; a query without a row here is not restricted by its identifiers.

    Numbers go first, narrowed by codes where that leaves any; codes alone restrict too; what no allowed chunk (i) meets restricts nothing.
    """
    c = chunks.select("i", "number", "code")
    byid = queries.select("q", "codes", F.explode("ids").alias("number")).join(c, "number")
    byid = byid.groupBy("q", "i").agg(F.max(F.coalesce(F.array_contains("codes", F.col("code")), F.lit(False))).alias("both"))
    any_both = byid.groupBy("q").agg(F.max("both").alias("any"))
    byid = byid.join(any_both, "q").where("both or not any").select("q", "i")
    bycode = queries.where(F.coalesce(F.size("ids"), F.lit(0)) < 1).select("q", F.explode("codes").alias("code")).join(c, "code").select("q", "i").distinct()
    out = byid.unionByName(bycode)
    return out if allowed is None else out.join(allowed.select("i").distinct(), "i", "left_semi").select("q", "i")


def restricted(scores: DataFrame, anchors: DataFrame) -> DataFrame:
    """The rows of scores (q, i, ...) that their query's anchors allow; queries without anchors keep all rows."""
    held = anchors.select("q").distinct().withColumn("held", F.lit(True))
    marked = scores.join(held, "q", "left").join(anchors.withColumn("fits", F.lit(True)), ["q", "i"], "left")
    return marked.where("held is null or fits").drop("held", "fits")


def act_bonus(totals: DataFrame, acts: DataFrame, chunks: DataFrame, injected: int = INJECTED) -> DataFrame:
    """(q, i, total) with w units for the chunks of acts (q, code, number, w) in play; an act without a scored chunk brings its first ones, with that alone."""
    parts = acts.join(chunks.select("i", F.col("code"), F.col("number")), ["code", "number"])
    parts = parts.groupBy("q", "code", "number", "i").agg(F.max("w").alias("w"))
    hit = parts.join(totals, ["q", "i"], "left")
    seen = hit.groupBy("q", "code", "number").agg(F.max(F.col("total").isNotNull()).alias("scored"))
    first = Window.partitionBy("q", "code", "number").orderBy("i")
    fresh = parts.join(seen.where("not scored"), ["q", "code", "number"], "left_semi").withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= injected)
    fresh = fresh.groupBy("q", "i").agg((F.max("w") * F.lit(UNIT)).alias("total"))
    more = parts.groupBy("q", "i").agg(F.sum("w").alias("w"))
    old = totals.join(more, ["q", "i"], "left").select("q", "i", (F.col("total") + F.coalesce("w", F.lit(0.0)) * F.lit(UNIT)).alias("total"))
    return old.unionByName(fresh)


def body(title: str = "title", text: str = "text") -> Column:
    return T.fold(F.concat_ws(" ", title, text))


def entity_bonus(totals: DataFrame, entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """(q, i, total, loose) with w units for chunks (i, title, text) that mention the entity (q, pieces, w) of their query loosely."""
    rows = totals.join(entities, "q", "left").join(chunks.select("i", body().alias("said")), "i", "left")
    loose = F.coalesce((F.size("pieces") > 0) & T.mentions_loose(F.col("said"), F.col("pieces")), F.lit(False))
    rows = rows.withColumn("loose", loose)
    return rows.select("q", "i", (F.col("total") + F.when(F.col("loose"), F.col("w") * F.lit(UNIT)).otherwise(F.lit(0.0))).alias("total"), "loose")


def best(totals: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc(F.round("total", 9)), "i")
    return totals.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def guaranteed(top: DataFrame, entities: DataFrame, chunks: DataFrame, scores: Callable[[DataFrame], DataFrame], k: int) -> DataFrame:
    """top (q, i, total, loose, rank); `scores` gives the score of pairs (q, i). Where no row of a query mentions its entity, the strict mention of the best score takes the last place, with w units."""
    met = top.groupBy("q").agg(F.max("loose").alias("met"), F.max("rank").alias("last"))
    need = entities.join(met.where("not met"), "q").select("q", "pieces", "w", "last")
    kinds = need.select("pieces").distinct()
    strict = kinds.join(chunks.select("i", body().alias("said")), T.mentions_strict(F.col("said"), F.col("pieces"))).select("pieces", "i")
    found = need.join(strict, "pieces")
    found = found.join(scores(found.select("q", "i")).select("q", "i", "score"), ["q", "i"])
    pick = Window.partitionBy("q").orderBy(F.desc("score"), "i")
    found = found.withColumn("rn", F.row_number().over(pick)).where("rn = 1")
    new = found.select("q", "i", (F.col("w") * F.lit(UNIT)).alias("total"), F.lit(True).alias("loose"), F.least(F.col("last") + 1, F.lit(k)).alias("rank"))
    kept = top.join(new.select("q", F.col("rank").alias("taken")), "q", "left").where("taken is null or rank < taken").drop("taken")
    return kept.unionByName(new)


def search(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, acts: DataFrame, entities: DataFrame, k: int = 8, candidates: int = I.CANDIDATES) -> DataFrame:
    """(q, i, rank, total, loose) for queries (q, text, v, ids, codes): both rankings under the anchors, their fusion, the bonuses and the guarantee."""
    anchors = written(anchored(chunks, queries), "anchors")
    asked = queries.select("q", "v")
    score = lambda pairs: I.cosine(vectors, asked, pairs)
    # restricted queries meet their own rows only, the others all rows in blocks
    free = asked.join(anchors.select("q").distinct(), "q", "left_anti")
    dense = I.top(score(anchors), candidates).unionByName(I.knn(vectors, free, candidates))
    lexical = I.top(restricted(I.bm25(chunks, queries), anchors), candidates)
    fused = written(I.fuse(dense, lexical, 2 * candidates).select("q", "i", "total"), "fused")  # some rows a query
    totals = entity_bonus(act_bonus(fused, acts, chunks), entities, chunks)
    top = guaranteed(written(best(totals, k), "best"), entities, chunks, score, k)
    return top.select("q", "i", "rank", F.round("total", 9).alias("total"), "loose")


def context(rows: DataFrame, by: str = "q", order: str = "rank", header: str = "header", text: str = "text", budget: int = BUDGET) -> DataFrame:
    """(by, context): the headers and texts of a group's few rows within the budget, cut at words, separated by rules."""
    heads = Window.partitionBy(by)
    rows = rows.withColumn("__room", F.greatest(F.lit(0), F.lit(budget) - F.sum(F.length(header) + 1).over(heads)))
    # every row gets an even share; what short rows leave goes, in order, to those that were cut
    share = F.floor(F.col("__room") / F.count(F.lit(1)).over(heads)).cast("long")
    upto = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__given", F.least(F.length(text), share)).withColumn("__lack", F.length(text) - F.col("__given"))
    rows = rows.withColumn("__left", F.col("__room") - F.sum("__given").over(heads) - F.coalesce(F.sum("__lack").over(upto), F.lit(0)))
    n = F.col("__given") + F.greatest(F.lit(0), F.least("__lack", "__left"))
    head = F.substr(F.col(text), F.lit(1), n.cast("int"))
    space = F.length(head) - F.instr(F.reverse(head), " ")
    cut = F.when((F.instr(head, " ") > 0) & (space > F.floor(n / 2)), F.substr(head, F.lit(1), space.cast("int"))).otherwise(head)
    said = F.when(F.length(text) <= n, F.col(text)).otherwise(F.concat(cut, F.lit(" […]")))
    block = F.concat_ws("\n", header, said)
    blocks = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), block.alias("b"))))
    return rows.groupBy(by).agg(F.array_join(F.transform(blocks, lambda x: x.b), "\n\n---\n\n").alias("context"))
