"""From raw documents to token ids: the stages of a training corpus.

Each stage takes all that the stage before has kept, as a table read back from
Parquet, and all but the last give the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propense.llm import language_id, mixing, order_minhash, pii, sentence_pieces
from propense.llm.tables import read, small_batches
from propense.sources.staging import stage


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those the calibrated threshold rejects go."""
    return language_id.accepted(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return order_minhash.deduplicated(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind, and their length anew."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks for."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its ids, the number of them, and the text they decode to.

    The table is staged here: the size of the batches to the workers is a setting of the session
    while the job runs. Its texts and ids lie twice on disk for that, so they are packed more tightly.
    """
    made = sentence_pieces.encoded_and_decoded("text", public_tokenizers.path("piece_bpe_32k.model"))
    encoding = docs.select("doc_id", "lang", "source", made.alias("made")).select(
        "doc_id", "lang", "source", F.size("made.ids").cast("long").alias("n_tokens"), "made.*"
    )
    with small_batches(spark):
        return stage(encoding, "encoded", compression="zstd")


STAGES = [
    ("language_id", known_language),
    ("minhash_near_dedup", without_copies),
    ("pii", without_personal_data),
    ("mixing", mixed_sources),
    ("sentence_pieces", encoded),
]

# Trained models, sketches and subword encoding are not SQL: the tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents."""
    docs = read(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)
