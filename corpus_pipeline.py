"""The corpus pipeline: raw documents to token ids.

Five stages, each of one operator: language ID, exact dedup, n-gram Jaccard join, benchmark decontamination, byte-level
BPE. A stage takes (spark, docs, sf_dir); all but the last return rows of documents with all their columns. run() writes
what a stage keeps as Parquet in the shared folder and reads it again for the next one, and then removes what came before.

Defined results: a null or empty text has no letter and goes with the first stage, and so does every text where nothing can
be learned; a null doc_id is a document like any other, the first to go among exact copies and the one that stays among near
copies; rows that repeat are exact copies; extra columns stay as they are up to the last stage, whatever their names; empty
tables give no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import byte_bpe, common, decontaminate, exact_dedup, language_id, ngram_join, unicode_words

#: A text whose likeliest language has a lower probability, or fewer of whose letters were learned, is rejected.
LEAST_SCORE, LEAST_KNOWN = 0.3, 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter, of no likely language, or mostly of letters that no language learned from has."""
    return language_id.recognised(docs, language_id.train(docs), LEAST_SCORE, LEAST_KNOWN)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest doc_id stays."""
    return exact_dedup.dedup_exact(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a similarity of 0.8 or more, the one with the least doc_id stays."""
    return ngram_join.one_of_each(docs, cut=unicode_words.word_hashes)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that hold a passage of the benchmark go."""
    return decontaminate.clean_of(docs, common.table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (unsigned 32-bit little-endian) and the SHA-256 of the decoded ids."""
    out = byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("body", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", exact_copies),
    ("ngram_join", near_copies),
    ("decontaminate", no_benchmark),
    ("byte_bpe", token_ids),
]

#: Trained models, MinHash and BPE are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        at = common.work_path(spark, f"stage-{name}")
        docs = common.saved(stage(spark, docs, sf_dir), at)
        if before:
            common.remove(before)
        before = at
    return docs
