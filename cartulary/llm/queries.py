"""The queries of this subpackage over the standard tables: thin forms of the operators with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import drr_pack, html_extract, hyper_shuffle, kdtree_topk, pareto_mix, permutation_ann, ppm_langid, simhash_bk, url_templates, warc_zstd


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: The rules of the url query: (verdict, host and path prefix).
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op1_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is labelled bad where the label of its id is toxic or of low quality."""
    labels = _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).when(F.col("toxic").isNotNull() | F.col("quality").isNotNull(), 0).alias("bad"))
    return url_templates.judge(_read(spark, sf_dir, "pages"), labels, URL_RULES)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(_read(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_langid.identify(_read(spark, sf_dir, "documents"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document with its fingerprint in hexadecimal and its class."""
    out = simhash_bk.near_duplicates(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto_mix.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zstd.archive(_read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_permutation_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_ann.search(_read(spark, sf_dir, "embeddings"))


def op8_kdtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree_topk.search(_read(spark, sf_dir, "embeddings"))


def op9_hypergeometric_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyper_shuffle.shuffle(_read(spark, sf_dir, "documents"))


def op10_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drr_pack.pack(_read(spark, sf_dir, "documents"), tokenizer_path(), quantum=drr_pack.QUANTUM)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [op1_url_templates, op2_html_extraction, op3_language_id, op4_warc_bundles, op5_permutation_ann, op6_simhash_dedup, op7_pareto_mix, op8_kdtree_topk, op9_hypergeometric_shuffle, op10_mixture_packing]
    return {f.__name__: f for f in named}
