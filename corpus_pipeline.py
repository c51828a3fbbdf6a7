"""A training corpus from raw documents: quality, near-duplicates, secrets, mixing, ids.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor
kept, and is written as Parquet and read again before the next. All but the
last return the columns of documents; the last returns one row of ids for each
copy in the mix. Rows are told apart by id and text, so ids may be null or repeat;
texts may be null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netsieve.llm import byte_bpe, poisson_mix, quality_bands, secret_ledger, simhash_trie
from netsieve.llm.registry import MIX_OTHER, MIX_SEED, MIX_WEIGHTS, fitted_bands
from netsieve.llm.shared import Tables


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the compression bands, which are fitted to the documents labelled as good."""
    return quality_bands.keep_clean(docs, bands=fitted_bands(spark, docs, sf_dir))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id; a text is never lost to another's id."""
    return simhash_trie.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced; n_chars follows the text."""
    return secret_ledger.redact(docs, length_col="n_chars")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks, in random order."""
    return poisson_mix.replicate(docs, MIX_WEIGHTS, MIX_SEED, other=MIX_OTHER, copy_col=None)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded bytes of each row."""
    import public_tokenizers

    bpe = byte_bpe.ByteBpe(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return byte_bpe.digests(byte_bpe.encode_documents(docs, bpe))


STAGES = [("quality", quality), ("dedup", dedup), ("secrets", secrets), ("mix", mix), ("encode", encode)]

#: Compression, fingerprints and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each from the table that the one before it wrote."""
    docs, tables = spark.read.parquet(f"{sf_dir}/documents.parquet"), Tables(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = tables.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
