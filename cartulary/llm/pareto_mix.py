"""Mixing sources to target weights by Pareto order sampling. DataFrame and SQL functions only.

A source's target is its weighted share of the wanted total, at most `max_repeat` times its size; what is over goes to the other sources by
weight. Within a source the expected copies of a document fall with its size, by half for each fourfold size, so that the same words come from more
documents; they are capped at `max_repeat` and scaled so that the expected words are the target. A document is taken as many whole times as its
expected copies hold for certain. What is left is its inclusion probability p, which differs from document to document, and the rest of the
target is a sample of fixed size in words: with a random u, the source's documents are ranked by q = (u / (1 - u)) / (p / (1 - p)), the random odds
by the inclusion odds, and the first ones are taken until their words are nearest to the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import write_table

WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MAX_REPEAT = 2
#: Ranges of q in which words are summed before the range with the cut is sorted: no task sorts a whole source.
RANGES = 4096
#: Sources, at most: their table goes through windows of one task. More raise an error.
MAX_SOURCES = 1_000_000
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def uniform(id_col: str, seed: int) -> Column:
    """A number in (0, 1) for each id: 52 bits of an MD5."""
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(str(seed))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))


def targets(sizes: DataFrame, weights=WEIGHTS, total_share: float = TOTAL_SHARE, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target) of (source, source_size). One row a source goes through single-task windows: the table is as long as there are sources.

    Targets are min(cap, w * l): sources in order of cap / weight are full until the common l of the others stays under their own ratio.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    n = len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % n + 1).cast("int"))
    t = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
    everything = Window.partitionBy()
    ranked = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("total", F.sum("source_size").over(everything) * F.lit(total_share))
    t = t.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    # the first source, in this order, that is not full sets the level of all that follow
    t = t.withColumn("open", F.col("w") * F.col("level") < F.col("cap"))
    t = t.withColumn("common", F.min(F.when(F.col("open"), F.struct((F.col("cap") / F.col("w")).alias("r"), F.col("source").isNull().alias("n"), F.col("source").alias("s"), F.col("level").alias("l")))).over(everything))
    return t.select("source", "source_size", F.when(F.col("common").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("w") * F.col("common.l"))).alias("target"))


def tempered(klass: Column) -> Column:
    """The relative copies of a document of a size class (the size's length in bits): half for each fourfold size, a power of two."""
    return F.pow(F.lit(2.0), -F.floor(klass / 2))


def size_class(size: str = "size") -> Column:
    return F.length(F.bin(F.col(size))).cast("int")


def copies_by_class(slim: DataFrame, sources: DataFrame, max_repeat: int) -> DataFrame:
    """(source, source_size, target, klass, whole, p): the certain copies and the inclusion probability of the documents of each size class.

    Expected copies are min(max_repeat, c * tempered): classes in the order of their size are full until the common c of the others leaves the next
    one under the cap. A source has 63 classes at most, so its window is short whatever the source's rows.
    """
    t = slim.where("size > 0").groupBy("source", size_class().alias("klass")).agg(F.sum("size").alias("words"))
    s = sources.select(F.col("source").alias("_s"), "source_size", "target")
    t = t.join(s, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("a", tempered(F.col("klass")))
    whole = Window.partitionBy("source")
    before = whole.orderBy("klass").rowsBetween(Window.unboundedPreceding, -1)
    none = lambda c, zero: F.coalesce(c, F.lit(zero))
    full, upto = none(F.sum("words").over(before), 0) * F.lit(float(max_repeat)), none(F.sum(F.col("words") * F.col("a")).over(before), 0.0)
    t = t.withColumn("c", (F.col("target") - full) / (F.sum(F.col("words") * F.col("a")).over(whole) - upto))
    # the first class that stays under the cap sets the scale of all that follow
    t = t.withColumn("first", F.min(F.when(F.col("c") * F.col("a") < F.lit(float(max_repeat)), F.struct("klass", "c"))).over(whole))
    copies = F.when(F.col("klass") >= F.col("first.klass"), F.greatest(F.lit(0.0), F.col("first.c") * F.col("a"))).otherwise(F.lit(float(max_repeat)))
    t = t.withColumn("copies", copies).withColumn("whole", F.floor("copies").cast("long"))
    return t.select("source", "source_size", "target", "klass", "words", "whole", (F.col("copies") - F.col("whole")).alias("p"))


def plan(slim: DataFrame, weights=WEIGHTS, total_share: float = TOTAL_SHARE, max_repeat: int = MAX_REPEAT, ranges: int = RANGES) -> DataFrame:
    """(source, source_size, target, cut, strict, of) for each source of (source, size, u); `of` maps a size class to its certain copies and inclusion probability.

    Documents with q <= cut (q < cut where strict) are taken once more than for certain.
    """
    sizes = write_table(slim.groupBy("source").agg(F.sum("size").alias("source_size")), "source_sizes")
    if sizes.count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sources = write_table(targets(sizes, weights, total_share, max_repeat), "targets")
    by_class = write_table(copies_by_class(slim, sources, max_repeat), "classes")
    certain = by_class.groupBy(F.col("source").alias("cs")).agg(F.sum(F.col("whole") * F.col("words")).alias("certain"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("klass", F.struct("whole", "p"))))).alias("of"))
    t = sources.join(certain, F.col("source").eqNullSafe(F.col("cs")), "left").drop("cs")
    t = write_table(t.withColumn("rest", F.col("target") - F.coalesce("certain", F.lit(0))), "sources")
    drawn = ranked(slim, t).where("q is not null").withColumn("range", F.floor(F.col("q") / (F.col("q") + 1) * ranges).cast("int"))
    sums = drawn.groupBy("source", "rest", "range").agg(F.sum("size").alias("words"))
    so_far = Window.partitionBy("source").orderBy("range")
    sums = sums.withColumn("upto", F.sum("words").over(so_far)).withColumn("under", F.col("upto") - F.col("words"))
    edge = write_table(sums.where("under < rest and rest <= upto").select(F.col("source").alias("es"), F.col("range").alias("er"), "under"), "edge")
    close = drawn.join(edge, F.col("source").eqNullSafe(F.col("es")) & (F.col("range") == F.col("er"))).select("source", "rest", "q", "size", "under")
    in_order = Window.partitionBy("source").orderBy("q", "size").rowsBetween(Window.unboundedPreceding, 0)
    close = close.withColumn("upto", F.col("under") + F.sum("size").over(in_order))
    # the last document is taken where that brings the words nearer to the rest
    close = close.where(F.abs(F.col("upto") - F.col("rest")) <= F.abs(F.col("upto") - F.col("size") - F.col("rest")))
    cuts = close.groupBy("source").agg(F.max("q").alias("cut"))
    # where no document of the range is taken, the cut is the range's lower end
    low = edge.select("es", (F.col("er") / F.lit(float(ranges))).alias("r")).withColumn("low", F.col("r") / (1 - F.col("r")))
    # where all the words are less than the rest by a rounding error, all are taken
    over = sums.groupBy(F.col("source").alias("os")).agg((F.max("upto") < F.max("rest")).alias("all"))
    out = t.join(write_table(cuts.withColumnRenamed("source", "ks"), "cuts"), F.col("source").eqNullSafe(F.col("ks")), "left").join(low, F.col("source").eqNullSafe(F.col("es")), "left")
    out = out.join(write_table(over, "over"), F.col("source").eqNullSafe(F.col("os")), "left")
    out = out.select("source", "source_size", "target", F.coalesce("cut", "low", F.when(F.col("all"), float("inf")), F.lit(-1.0)).alias("cut"), (F.col("cut").isNull() & F.col("low").isNotNull()).alias("strict"), "of")
    return write_table(out, "mix_plan")


def odds(u: Column, p: Column) -> Column:
    """The random odds divided by the inclusion odds; null where nothing is left to chance."""
    return F.when((p > 0) & (p < 1), (u / (1 - u)) / (p / (1 - p)))


def ranked(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows (with source, size and u) joined with their source's figures, whole and q."""
    s = sources.withColumnRenamed("source", "_s")
    joined = rows.join(s, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("_of", F.when(F.col("size") > 0, F.element_at("of", size_class())))
    return joined.withColumn("whole", F.coalesce("_of.whole", F.lit(0))).withColumn("q", odds(F.col("u"), F.col("_of.p"))).drop("_of", "of")


def copies() -> Column:
    more = F.when(F.col("strict"), F.col("q") < F.col("cut")).otherwise(F.col("q") <= F.col("cut"))
    return F.col("whole") + F.coalesce(more, F.lit(False)).cast("long")


def slim_table(docs: DataFrame, id_col: str, text: str, source: str, seed: int) -> DataFrame:
    return write_table(docs.select(F.col(id_col), F.col(source).alias("source"), size_of(text).alias("size"), uniform(id_col, seed).alias("u")), "sizes")


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, total_share: float = TOTAL_SHARE, max_repeat: int = MAX_REPEAT, seed: int = 11) -> DataFrame:
    """(id, size, source_size, target, taken, source, copies) for each row.

    Sources go by code point with null as a source of its own, last. A null or empty text has size 0 and takes nothing; where all sizes are 0, so
    are the targets. A very long text is a document like any other: it is taken whole or not, so its source's words may miss the target by up to half
    of it. Rows that repeat an id share its draw, those of null ids share one; ties of q go by size, and equal rows are taken alike or, at the cut, cut
    together. Extra columns, also of the result's names, are ignored; an empty table gives an empty result. More than MAX_SOURCES sources raise an error.
    """
    slim = slim_table(docs, id_col, text, source, seed)
    out = ranked(slim, plan(slim, weights, total_share, max_repeat)).withColumn("copies", copies())
    return out.select(id_col, "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def mixed(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, total_share: float = TOTAL_SHARE, max_repeat: int = MAX_REPEAT, seed: int = 11) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; the columns are those of docs. Texts are not shuffled: a row's draw needs only its source's figures."""
    cols = docs.columns
    p = plan(slim_table(docs, id_col, text, source, seed), weights, total_share, max_repeat)
    p = p.toDF(*[f"__mix_{c}" for c in p.columns])
    u, c = uniform(id_col, seed), lambda name: F.col(f"__mix_{name}")

    def n(size: Column) -> Column:
        at = F.element_at(c("of"), F.length(F.bin(size)).cast("int"))
        q = odds(u, at["p"])
        more = F.when(c("strict"), q < c("cut")).otherwise(q <= c("cut"))
        return F.when(size > 0, (at["whole"] + F.coalesce(more, F.lit(False)).cast("long")).cast("int")).otherwise(F.lit(0))

    # a variable of a lambda, so that the words are counted once however often the size is needed
    copies_of = F.element_at(F.transform(F.array(size_of(text)), n), 1)
    rows = docs.join(p, F.col(source).eqNullSafe(c("source"))).withColumn("__mix_n", copies_of)
    return rows.withColumn("__mix_k", F.explode(F.when(F.col("__mix_n") > 0, F.sequence(F.lit(1), F.col("__mix_n"))))).select(*cols)
