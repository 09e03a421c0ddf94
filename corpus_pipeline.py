"""The corpus pipeline: toxicity, near-duplicate join, personal data, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowdelta.llm import jaccard, mixing, packing, pii, toxicity
from rowdelta.llm.common import table
from rowdelta.llm.queries import tokenizer_paths


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned from the labels outside the held-out fold, scores as toxic go."""
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.reject_toxic(docs, lexicon)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays: that with the smallest id."""
    return jaccard.drop_near_duplicates(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to tags; no document goes."""
    return pii.mask_pii(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them, in training order: twice, once, in part or not at all."""
    return mixing.sample(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of the mixed documents has a place in a training sequence."""
    return packing.pack(docs, **tokenizer_paths())


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_copies),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: Learned lexicons, MinHash and token ids are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
