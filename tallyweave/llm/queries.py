"""The operators of this subpackage as queries over the standard tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import filter_audit, fingerprints, html_extract, media, neardup, packing, pieces, pii, sharding, token_counts, toxicity, warc, whitening

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
#: The id of <|endoftext|>, which no text yields.
END_OF_TEXT = 50256
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document, found by scanning flat token files for separators."""
    return token_counts.count_documents(_table(spark, sf_dir, "documents"), RANKS, PATTERN, END_OF_TEXT)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document."""
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", toxicity.is_held_out(F.col("doc_id")).alias("held_out"), toxicity.score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.span_digests(_table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents packed into sequences of 1024 tokens."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), RANKS, PATTERN)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document, of at most 1 MiB of text each."""
    return sharding.assign_shards(_table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC archives and read back."""
    return warc.round_trip(spark, _table(spark, sf_dir, "pages"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents and what they decode to, as digests."""
    return pieces.encode_digests(_table(spark, sf_dir, "documents"), PIECES)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts stored as images in archives, read back through the data source, with features."""
    return media.round_trip(_table(spark, sf_dir, "documents"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near-duplicates that each document belongs to."""
    return neardup.class_ids(_table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints.fingerprint_documents(_table(spark, sf_dir, "documents"))


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extract.extract_pages(spark, _table(spark, sf_dir, "pages"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How five filters of documents interact, in every order."""
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings whitened by their exact scatter."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


_OPERATORS = [op1_token_counts, op2_toxicity, op3_personal_data, op4_best_fit_packing, op5_sharding, op6_warc, op7_sentencepiece, op8_media_columns]
_OPERATORS += [op9_near_duplicates, op10_fingerprints, op11_main_text, op12_filter_audit, op13_whitening]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _OPERATORS}
ORACLE_SQL: dict[str, str] = {"op5_sharding": sharding.ORACLE, "op12_filter_audit": filter_audit.ORACLE}
