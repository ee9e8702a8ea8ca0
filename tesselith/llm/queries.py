"""The registered queries: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tesselith.llm.additive_ann import nearest_neighbours
from tesselith.llm.arrow_output import arrow_output
from tesselith.llm.byte_bpe import byte_bpe
from tesselith.llm.compression_quality import compression_quality
from tesselith.llm.language_id import identify_language
from tesselith.llm.packing import pack_documents
from tesselith.llm.parity_join import jaccard_components
from tesselith.llm.sharding import shard_documents
from tesselith.llm.token_counts import token_counts
from tesselith.llm.warc import warc_round_trip

BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe(_table(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN)


def op2_best_fit_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents"))


def op3_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(_table(spark, sf_dir, "embeddings"))


def op4_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(_table(spark, sf_dir, "documents"))


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), WORD_BPE)


def op7_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), size=4, part=85, per=100)


def op8_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_quality(_table(spark, sf_dir, "documents"))


def op9_whole_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), WORD_BPE)


def op10_arrow_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrow_output(_table(spark, sf_dir, "documents"), WORD_BPE)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_byte_bpe_round_trip,
        op2_best_fit_shards,
        op3_additive_quantisation,
        op4_rank_order_language,
        op5_warc_revisits,
        op6_cost_balanced_packing,
        op7_parity_sketch_join,
        op8_compression_quality,
        op9_whole_token_counts,
        op10_arrow_sequences,
    )
    return {f.__name__: f for f in own}
