"""The corpus pipeline: documents in, packed training sequences out. Each stage is written as Parquet and read again as the next one's documents.

All stages keep these rules. Nulls: a null text counts as empty, a null source is a source of its own, rows with a null id are rows like any other. Very
long texts are read whole. Repeated rows are judged each; of equal texts near-dedup keeps one. Extra columns, whatever their names, pass through all
stages but the last. An empty table gives an empty result.
"""

from __future__ import annotations

from cartulary.llm import drr_pack, pareto_mix, ppm_langid, simhash_bk
from cartulary.llm.common import scratch, write_table
from cartulary.llm.queries import tokenizer_path
from pyspark.sql import DataFrame, SparkSession


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go: those without a letter, those whose best language has less than half of the likelihood, and those that
    it codes with more than eight bits a byte. The languages are learned from the labels of docs; without any label all documents go."""
    return ppm_langid.keep_known(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the smallest id, rows with an id before those without, then the first in the table."""
    return simhash_bk.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target mix takes them: none, once or twice. Documents without a word take no part in a mix of words and go."""
    return pareto_mix.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens; a document that the mix repeats is packed as often."""
    return drr_pack.pack(docs, tokenizer_path(), quantum=drr_pack.QUANTUM)


STAGES = [("language_id", language_id), ("simhash_dedup", simhash_dedup), ("mix_sources", mix_sources), ("pack_sequences", pack_sequences)]

#: Language identification and tokenizers have no SQL form; tests/llm/test_pipeline.py holds the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage writes besides its result is deleted when the result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch() as kept:
            docs = write_table(stage(spark, docs, sf_dir), name)
            kept.append(docs)
    return docs
