"""A corpus pipeline: identify languages, drop exact and near copies, drop benchmark leaks, pack what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexhaul.llm import decontam, exact_dedup, jaccard, langid, packing
from lexhaul.llm.common import Scratch, table
from lexhaul.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in no language of the corpus go: without a letter, or far from every centroid."""
    return langid.keep_identified(docs, langid.fit(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_first_of_class(docs, 75, 100)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path(), 4096, 1)


STAGES = [("language_id", language_id), ("exact_dedup", exact_copies), ("jaccard_join", near_copies), ("decontamination", decontaminate), ("packing", pack)]
#: Language identification and packing have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet in the shared folder and read again."""
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
