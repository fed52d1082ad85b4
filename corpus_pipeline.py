"""From raw documents to packed sequences: quality, exact dedup, SimHash near-dedup, mixing, packing.

Stages share their executors, whose Python workers keep what an earlier stage took; those that send texts to Python do so in small batches.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sluice.llm import exact, mixing, packing, quality, simhash
from sluice.llm.common import shared_dir, small_batches, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the forest, calibrated on the table labels.

    Null and empty texts fail the base rules; repeated rows and null ids are judged like any row; without labels only the
    base rules reject; an empty table gives no rows. All columns stay.
    """
    small_batches(spark)
    return quality.quality_filter(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that of most code points, then of the least doc_id (null last), then the last place.

    Null counts as empty; of repeated rows one stays. All columns stay; doc_id must be a whole number.
    """
    return exact.exact_dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group linked by a Jaccard similarity of 0.8 or more of five-word shingles.

    Texts of fewer words are one shingle, texts without a word are alike; repeated rows are near each other, as equal
    texts are. All columns stay; an empty table gives no rows.
    """
    small_batches(spark)
    return simhash.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights take them; a document taken twice has two rows.

    Null sources are a source of their own, the last; texts without a word have no size and are not taken; of documents
    that tie for a place a seeded hash decides. All columns stay; an empty table gives no rows.
    """
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenized documents with their place in sequences of 4096.

    Null and empty texts are the closing id alone; repeated rows are packed each; long texts are cut into pieces; an
    empty table gives no rows.
    """
    small_batches(spark)
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: The forest, the state and the tokenizer are not SQL's to express; tests hold each stage against its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
