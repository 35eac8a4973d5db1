"""Derived views that give the standard tables the shape of acts, chunks, a catalogue and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: A table under this size may lie in a single row group, which one task reads alone.
SPREAD_BYTES = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores before costly work on its texts, where its files are so small that few tasks would read them; larger tables stay as they lie."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < SPREAD_BYTES else df


def acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = read(spark, sf_dir, "documents"), F.col("doc_id")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (i % 700).cast("int"))
    return d.select(
        i.alias("i"), i.cast("string").alias("id_archivo"), F.concat(F.lit("DISP-"), T.upper(F.col("source"))).alias("code"), F.concat((i % 50 + 1).cast("string"), F.lit("/"), (2024 + i % 3).cast("string")).alias("number"),
        (2024 + i % 3).alias("year"), day.alias("act_date"), F.date_format(day, "dd/MM/yyyy").alias("fecha_acto"), F.col("lang").alias("section"), F.when(i % 7 != 0, F.concat(F.lit("https://portal.example/"), i.cast("string"))).alias("url"),
        F.element_at(F.array(F.lit("alta"), F.lit("media"), F.lit("baja")), (i % 3 + 1).cast("int")).alias("confidence"), F.substring_index("text", "\n", 1).alias("title"), "text",
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = ["Visto", "Considerando", "Que sigue", "Parte resolutiva", "Artículo n", "Firmas", "PROGRAMA", "ANEXO I"]
    d = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    return d.withColumn("heading", F.element_at(F.array(*map(F.lit, heads)), F.col("ord") % 8 + 1))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("l")).distinct()
    a = acts(spark, sf_dir).withColumn("downloaded", F.col("i") % 5 != 0).join(lab, F.col("i") == F.col("l"), "left")
    return a.withColumn("indexed", F.col("l").isNotNull() & F.col("downloaded")).drop("l")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = read(spark, sf_dir, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn")).withColumn("user_id", F.col("conv_id") % 17)
    useful = F.when(F.col("role") == "assistant", F.when(F.col("id") % 3 == 1, 0).when(F.col("id") % 3 == 2, 1))
    act = (F.col("id") % 50).cast("string")
    sources = F.when(F.col("role") == "assistant", F.when(F.col("id") % 4 == 0, "[]").when(F.col("id") % 4 == 1, F.lit(None)).otherwise(F.concat(F.lit('[{"cita":"Disposición '), act, F.lit(' — Artículo 1"},{"cita":"Resolución '), (F.col("id") % 7).cast("string"), F.lit('"}]'))))
    return m.select("id", "conv_id", "turn", "user_id", "role", "text", useful.cast("int").alias("useful"), sources.alias("sources"))
