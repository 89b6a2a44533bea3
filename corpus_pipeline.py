"""Training-corpus pipeline: each stage takes what its predecessor kept.

Toxic documents go; of each group of near-duplicates one document stays; secrets are masked; sources are mixed to their
target weights, so a document may stand several times or not at all; and what is left is encoded as sampled
SentencePiece segmentations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hostweave.llm import binary_output, mixing, ngram_join, secret_scan, sentencepiece_sampling, toxicity
from hostweave.llm.storage import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.accepted(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group that is connected by near-duplicates."""
    return ngram_join.one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with asterisks for the characters of secrets."""
    return secret_scan.masked(docs, secret_scan.fit(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as the mix takes them."""
    return mixing.repeated(docs)


def sample_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each document, as pieces."""
    model = binary_output.tokenizer_path(spark, "piece_bpe_32k.model")
    return sentencepiece_sampling.sample(docs, model).withColumnRenamed("key", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_duplicates),
    ("secret_scans", mask_secrets),
    ("mixing", mix_sources),
    ("sentencepiece", sample_pieces),
]

# Trained models and sampling cannot be said in SQL; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are stored before the next one reads them, more than once."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
