"""A corpus pipeline: quality rules, language identification, near duplicates, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tesselith.llm.common import new_path
from tesselith.llm.compression_quality import filter_quality
from tesselith.llm.language_id import filter_language
from tesselith.llm.packing import pack_documents
from tesselith.llm.parity_join import keep_one_of_each

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose best profile is no nearer than this share of the largest distance has no language to speak of.
LEAST_SCORE = 0.2


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass the word rules and the compression bands."""
    return filter_quality(docs.select(COLUMNS))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that resemble a learned language; the rest are undetermined."""
    return filter_language(docs.select(COLUMNS), LEAST_SCORE)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest id, of each group linked at 0.8 on five-word shingles.

    A null id and a text without words are in no group and stay; texts that share
    an id are judged each by itself; of repeated rows one stays.
    """
    return keep_one_of_each(docs.select(COLUMNS), size=5, part=80, per=100)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 tokens; a row per piece."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_stage),
    ("language identification", language_stage),
    ("near duplicates", near_duplicate_stage),
    ("packing", packing_stage),
]

#: Compression ratios, profiles and tokenizers are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`, each written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(COLUMNS)
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        path = new_path(spark, f"stage-{i}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
