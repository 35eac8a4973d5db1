"""Keyed operations on tables: survivorship, upsert, reconciliation, segments, series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..streaming.collect import written


def first_by(df: DataFrame, keys: list[str], *order: Column | str, n: int = 1) -> DataFrame:
    """The first n rows of each key in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def upsert(target: DataFrame, source: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """target with source's values of `columns` where a key is in both, and source's new rows; other columns of target are kept."""
    s = source.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in columns])
    j = target.join(s, F.col(key) == F.col("__k"), "full_outer")
    took = F.col("__k").isNotNull()
    return j.select(*[F.coalesce(key, "__k").alias(key) if c == key else F.when(took, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns])


def two_tier(left: DataFrame, first: DataFrame, second: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """left with `value` by key a, or, for rows without one, by key b: two equi-joins instead of one with OR."""
    f = first.select(F.col(a).alias("__a"), F.col(value).alias("__va"))
    s = second.select(F.col(b).alias("__b"), F.col(value).alias("__vb"))
    j = left.join(f, F.col(a) == F.col("__a"), "left").join(s, (F.col(b) == F.col("__b")) & F.col("__a").isNull(), "left")
    return j.withColumn(value, F.coalesce("__va", "__vb")).drop("__a", "__va", "__b", "__vb")


def unique_candidates(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value) of the keys that exactly one row has."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min(value).alias(value)).where("__n = 1").drop("__n")


def islands(df: DataFrame, part: list[str], order: list[str], counter: str, out: str = "segment") -> DataFrame:
    """A new segment starts where the counter does not rise."""
    w = Window.partitionBy(*part).orderBy(*order)
    new = F.coalesce((F.col(counter) <= F.lag(counter).over(w)).cast("int"), F.lit(0))
    return df.withColumn("__new", new).withColumn(out, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def daily_series(df: DataFrame, ts: str, value: Column, name: str) -> DataFrame:
    """(day, name) for each day from the first to the last, 0 where there is none."""
    per = df.groupBy(F.to_date(ts).alias("d")).agg(value.alias(name))
    days = per.agg(F.min("d").alias("a"), F.max("d").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    return days.join(per, F.col("day") == F.col("d"), "left").select("day", F.coalesce(name, F.lit(0)).alias(name))


def coverage_date(df: DataFrame, doc: str, day: str, skip: int = 5) -> DataFrame:
    """The newest date after the `skip` newest documents are set aside (the oldest, if there are fewer)."""
    per = df.where(F.col(day).isNotNull()).groupBy(doc).agg(F.max(day).alias("coverage_date"))
    return per.orderBy(F.desc("coverage_date"), doc).limit(skip + 1).agg(F.min("coverage_date").alias("coverage_date"))


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """df with its rows' places, from 0, in the order of columns that tell all rows apart: ranges are sorted each by itself, and numbered behind the counts of
    those before them, so no task holds all rows."""
    ranges = written(df.repartitionByRange(df.sparkSession.sparkContext.defaultParallelism, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))  # a row a range
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return ranges.join(F.broadcast(base), "__range").withColumn(out, F.col("__base") + place).drop("__range", "__base")


def merged_index(one: DataFrame, two: DataFrame, key: str, document: str, vector: str) -> DataFrame:
    """The rows of both indexes, those of the second numbered after the greatest key of the first.

    ValueError where the columns differ, a row's number is there twice, vectors have several dimensions, or a document is in both.
    """
    if one.dtypes != two.dtypes:
        raise ValueError("the columns differ")
    about = [t.agg(F.count(F.lit(1)), F.count_distinct(key), F.min(F.size(vector)), F.max(F.size(vector)), F.max(key)).first() for t in (one, two)]
    if any(n != kinds for n, kinds, *_ in about):
        raise ValueError("a number is there twice")
    if len({d for _, _, low, high, _ in about for d in (low, high) if d is not None and d >= 0}) > 1:
        raise ValueError("vectors have several dimensions")
    if not one.join(two, document, "left_semi").isEmpty():
        raise ValueError("a document is in both indexes")
    return one.unionByName(two.withColumn(key, F.col(key) + F.lit((about[0][4] if about[0][4] is not None else -1) + 1)))


#: Heads of citations that name no act.
DEGRADED = ("unknown", "orden_compra", "")


def _head(citation: Column) -> Column:
    return F.lower(F.trim(F.split_part(F.coalesce(citation, F.lit("")), F.lit("—"), F.lit(1))))


def mended(fragments: DataFrame, catalogue: DataFrame) -> DataFrame:
    """fragments (doc, id_archivo, section, cita, ...) with degraded citations built anew from the catalogue (id_archivo, type, code, nro, anio).

    What stood behind the dash, or else the section, stays behind it. Without a row of the catalogue, or without its number and year, a citation stays.
    """
    c = catalogue.select(F.col("id_archivo").alias("__k"), *[F.trim(F.coalesce(x, F.lit(""))).alias(f"__{x}") for x in ("type", "code", "nro", "anio")])
    j = fragments.join(c, F.col("id_archivo") == F.col("__k"), "left")
    section = F.when((F.col("section") != F.col("cita")) & (F.col("section") != F.col("doc")), F.col("section")).otherwise("")
    suffix = F.trim(F.when(F.contains("cita", F.lit("—")), F.split_part("cita", F.lit("—"), F.lit(2))).otherwise(section))
    kind = F.initcap(F.when(F.col("__type") == "", "acto").otherwise(F.col("__type")))
    number = F.concat_ws("/", "__nro", "__anio")
    base = F.concat_ws(" ", kind, F.nullif(F.upper("__code"), F.lit("")), number)
    able = _head(F.col("cita")).isin(*DEGRADED) & F.col("__k").isNotNull() & (F.col("__nro") != "") & (F.col("__anio") != "")
    return j.withColumn("cita", F.when(able, F.concat_ws(" — ", base, F.nullif(suffix, F.lit("")))).otherwise(F.col("cita"))).select(*fragments.columns)


def deduplicated(fragments: DataFrame) -> DataFrame:
    """The fragments of one copy of each act: that with a link, then of a sure origin, then with most fragments, then the last by name.

    An act is the head of its citation; where that is degraded, the document stands for itself, as nothing tells whose copy it is. Copies are weighed by one
    row each, so an act with very many fragments is a partial aggregate, not a window.
    """
    head = _head(F.col("cita"))
    rows = fragments.withColumn("__act", F.when(head.isin(*DEGRADED), F.concat(F.lit("__doc__"), F.col("doc"))).otherwise(head))
    linked, sure = F.coalesce("url", F.lit("")) != "", F.coalesce("confidence", F.lit("")).isin("catalogo", "alta")
    copies = rows.groupBy("__act", "doc").agg(F.min_by(F.struct(linked.alias("u"), sure.alias("c")), "i").alias("first"), F.count(F.lit(1)).alias("n"))
    best = copies.groupBy("__act").agg(F.max(F.struct("first.u", "first.c", "n", F.col("doc"))).alias("b")).select("__act", F.col("b.doc").alias("doc"))
    return rows.join(best, ["__act", "doc"], "left_semi").select(*fragments.columns)


def insert_or_ignore(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """target and those rows whose key it lacks; of several new rows of a key the first by all columns."""
    new = rows.select(*target.columns).join(target, key, "left_anti")
    one = new.groupBy(key).agg(F.min(F.struct(*target.columns)).alias("__row")).select("__row.*")
    return target.unionByName(one)


def without_children(children: DataFrame, gone: DataFrame, parent: str) -> DataFrame:
    """The children but those of parents that are gone."""
    return children.join(gone.select(parent).distinct(), parent, "left_anti").select(*children.columns)


def owned_update(target: DataFrame, changes: DataFrame, key: str, owner: str, column: str) -> DataFrame:
    """target with the new values of `column` of those changes (key, owner, column) whose owner is the row's; others change nothing."""
    c = changes.select(F.col(key).alias("__k"), F.col(owner).alias("__o"), F.col(column).alias("__v"))
    j = target.join(c, (F.col(key) == F.col("__k")) & (F.col(owner) == F.col("__o")), "left")
    return j.withColumn(column, F.when(F.col("__k").isNotNull(), F.col("__v")).otherwise(F.col(column))).select(*target.columns)


def refreshed(index: DataFrame, metadata: DataFrame, key: str, title: str, columns: list[str]) -> DataFrame:
    """index with `columns` of the authoritative metadata where it has them, and `drifted`: its title differs by more than white space, so the text that was
    embedded is old. Rows without metadata stay as they are."""
    m = metadata.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in {*columns, title}])
    j = index.join(m, F.col(key) == F.col("__k"), "left")
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    new = lambda c: F.nullif(F.col(f"__{c}"), F.lit(""))
    drifted = new(title).isNotNull() & (flat(F.col(title)) != flat(new(title)))
    return j.select(*[F.coalesce(new(c), F.col(c)).alias(c) if c in columns else F.col(c) for c in index.columns], drifted.alias("drifted"))


def reconciled(catalogue: DataFrame, found: dict[str, DataFrame], key: str, day: Column) -> DataFrame:
    """The catalogue with a day in each column of `found` for those of its rows whose key is in that column's table; a day that is there stays."""
    out = catalogue
    for column, there in found.items():
        k = there.select(F.col(key).alias("__k")).distinct()
        out = out.join(k, F.col(key) == F.col("__k"), "left").withColumn(column, F.coalesce(F.col(column), F.when(F.col("__k").isNotNull(), day))).drop("__k")
    return out
