"""Corpus pipeline: quality classifier, exact dedup, near dedup, mixing of sources, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every stage as Parquet in the shared folder and rereads
it as the next one's documents, so a lost executor costs at most the stage at hand.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lodestat.llm import exact, mixing, neardup, packing, quality
from lodestat.llm.common import materialise, read_table
from lodestat.llm.queries import tokenizer


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier doesn't reject."""
    model = quality.fit_labels(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each distinct text, the one with the largest doc_id."""
    return exact.drop_copies(docs, f"digest_index_{uuid.uuid4().hex}")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 0.8 of their five-word shingles, the one with the smallest doc_id."""
    return neardup.keep_one(docs, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as their source's target weight asks, in a global random order."""
    return mixing.poisson_mix(docs).select(*[f"`{c}`" for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences; a document that the mixing repeats is packed as often."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", good_quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier can't be expressed in SQL; tests/llm/test_pipeline.py compares run() and the rows after each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
