"""From raw documents to token ids: the stages of a training-data pipeline.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of
documents. Between stages the table is written to the shared folder and read again.
"""

from __future__ import annotations

import os
import secrets

import public_tokenizers
from catalog.session import ship
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerstack.llm import bpe, curriculum, ngram_join, pii, quality
from layerstack.llm.common import stored

#: The key of surrogates. Set it in the environment where several runs must give equal surrogates; else
#: it is drawn for each run of the driver and known to nobody.
KEY = os.environ.get("CORPUS_PIPELINE_KEY") or secrets.token_hex(32)
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars of the texts as they are now, where there is such a column."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier learnt from the labels does not reject."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    labels = labels.where(quality.fold(F.col("doc_id"), 5) != 0)
    return quality.keep_good(docs, quality.fit(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of documents with similar shingle sets."""
    ship(spark)
    return ngram_join.keep_one(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data."""
    ship(spark)
    return _counted(pii.replace(docs, KEY, count="_entities").drop("_entities"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix reads them, in order of training."""
    ship(spark)
    mixed = curriculum.mix(docs, ordered=False)
    return _counted(curriculum.expand(mixed).select(docs.columns))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document in place of its text, and whether they decode to it."""
    ship(spark)
    # Decoded in the task that encodes, so that texts and ids cross to Python once.
    encoded = bpe.encode(docs, VOCABULARY, check="round_trip")
    kept = [c for c in docs.columns if c != "text"]
    return encoded.select(*kept, "tokens", "n_tokens", "round_trip")


STAGES = [
    ("quality", quality_filter),
    ("near_duplicates", near_duplicates),
    ("pii", private_data),
    ("mixing", mixing),
    ("bpe", tokens),
]

#: The classifier, the join and the encoder are beyond SQL; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
