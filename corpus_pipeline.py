"""From raw documents to packed training sequences.

Four stages, each a function of (spark, docs, sf_dir) that works on all rows its
predecessor kept: documents of poor quality go, toxic ones go, one document of
each group of near-duplicates stays, and what remains is packed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import jaccard, packing, quality, toxicity
from marketloom.llm.names import free_names
from marketloom.llm.storage import discard, staged, table

QUALITY_LEAST = 0.3
TOXIC_FROM = 0.5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as good text; labels train the classifier only."""
    (score,) = free_names(docs, "score")
    scored = quality.classify(docs, table(spark, sf_dir, "labels"), name=score)
    return scored.filter(F.col(score) >= QUALITY_LEAST).select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an offending sentence, by noisy-or over all of them."""
    score, located = free_names(docs, "score", "offending")
    scored = toxicity.detect(docs, table(spark, sf_dir, "labels"), name=score, located=located)
    return scored.filter(F.col(score) < TOXIC_FROM).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates (five-word shingles, Jaccard 0.8)."""
    return jaccard.drop_near_duplicates(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens and their places in sequences of 4096."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 4096, 1)


STAGES = [
    ("quality classifier", keep_quality),
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", one_of_each),
    ("best-fit packing", pack_sequences),
]

#: Trained models and tokenizers aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        kept = staged(stage(spark, docs, sf_dir), "stage")
        discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
