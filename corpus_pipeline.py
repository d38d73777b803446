"""A training-data pipeline over `documents`: five stages, each written as Parquet and read again for the next one.

language ID            documents without a letter, or whose language can't be told, go
SimHash near-dedup     of documents linked by five-word shingles (similarity 0.8 or more) one with the smallest doc_id stays
decontamination        documents that hold a test item of `benchmark` go
mixing                 sources are drawn to their target weights; a document drawn twice has two rows
token files            what is left is encoded and written to files of zstandard frames; the rows are read back from them
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from correctionlab.llm import decontaminate, language_id, mixing, near_copies, token_files
from correctionlab.llm.common import table
from correctionlab.plans.sizing import cut_lineage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.known_language(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs).drop("mix_shard", "mix_key")


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.token_table(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", known_language),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing_to_weights),
    ("token_files", token_output),
]

# Fingerprints, classifiers and tokens can't be told in SQL: tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut_lineage(docs, name)
    return docs
