"""Queries of the operators that work on token ids (2, 8, 10)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm.bpe import bpe_round_trip
from logweave.llm.common import shared_folder, table
from logweave.llm.packing import pack_documents
from logweave.llm.registry import register
from logweave.llm.tokenfile import read_documents, write_token_files

SEQUENCE_TOKENS = 2048


@register("op2_packing")
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as byte_bpe_50k ids and end id 0, packed into sequences of 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), SEQUENCE_TOKENS,
                          added_tokens=True)


@register("op8_token_files")
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as word_bpe_49k ids and end id 1, written to and read back from token files."""
    folder = shared_folder(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=1,
                      added_tokens=True)
    return read_documents(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


@register("op10_bpe_codec")
def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded by the ranks of byte_bpe_multi_50k and decoded again."""
    out = bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                         public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))
