"""From raw documents to packed training sequences, in five stages.

Quality rules, near duplicates, repeated passages, secrets, packing.  Each stage
works on all that the one before it kept, which is written as Parquet and read
again.  All but the last return the columns of documents.

Each stage's defined results: a null or empty text fails the quality rules, and where a
stage is used alone it stays as it is, is no copy, and packs as its end token; rows that
repeat an id are one document to near_dedup, and are judged each by the others; a null
id stays; an empty table gives an empty result; other columns stay, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.common import scratch_path, scratch_scope, table
from tracemill.llm.minhash import drop_near_duplicates
from tracemill.llm.packing import pack_pieces, tokenize_pieces
from tracemill.llm.quality import filter_quality
from tracemill.llm.secret_scan import redact_secrets
from tracemill.llm.substrings import remove_repeats


def _recounted(docs: DataFrame) -> DataFrame:
    """docs with n_chars, where they have it, of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed rules take for good."""
    return filter_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, similarity 0.8 or more."""
    return drop_near_duplicates(docs, width=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less the passages of 50 words and more that an earlier document has."""
    return _recounted(remove_repeats(docs, window=50, counted=None))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets replaced by their kind."""
    return _recounted(redact_secrets(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in sequences of at most 4096 tokens."""
    pieces = tokenize_pieces(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return pack_pieces(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("secret_scans", secret_scan),
    ("best_fit_packing", packing),
]

#: Expectation-maximisation, union-find and best-fit have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        with scratch_scope(spark):  # what a stage writes for itself goes as soon as its result is written
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
