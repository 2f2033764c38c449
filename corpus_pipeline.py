"""From raw documents to packed sequences: toxic documents go, one document of each near-duplicate group stays, the
sources are mixed to their target weights, and what is left is packed.

Each stage takes and gives the columns of documents; the last gives the pieces of documents with their bins. A document
that the mix takes several times is packed as often.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpusmill.llm import minhash, mixing, packing, tokens, toxicity  # noqa: E402
from corpusmill.llm.common import small_batches, stored, word_count  # noqa: E402


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on all labels, scores below 0.5."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    fitted, model = toxicity.trained(docs, labels)
    return toxicity.scored(docs, fitted, model).where(toxicity.predicted(F.col("score")) == 0).select("row.*")


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group linked at five-word shingles and 0.8."""
    return minhash.without_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, by words."""
    return mixing.mixed_rows(docs, word_count(F.col("text")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, by token ids with the end id, in bins of several lengths.

    Lengths are stored before they are packed, so that a core has one Python worker at a time, and texts go to it in
    small batches: executors carry what the earlier stages left them with."""
    with small_batches(spark, tokens.ROWS):
        counts = stored(tokens.token_counts(docs, keep=100_000), "pipeline-lengths")
    pieces = packing.pack(counts, F.col("n_tokens"))
    return pieces.select("row.doc_id", "piece", "piece_start", "piece_length", "bin_id", "bin_size", "bin_offset")


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("mixing", mixed),
    ("packing", packed),
]

#: A trained classifier and signatures have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
