"""Token counts through a cache keyed by content and tokenizer version."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_dir, table, text_or_empty
from .tokens import batches, encoder, space_chunks, version

LIMIT = 512


def _encode(path: str):
    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path, space_chunks, len)
        for frame in frames:
            counts = [sum(c) for part in batches(frame["text"].tolist()) for c in encode(part)]
            yield pd.DataFrame({"digest": frame["digest"], "n_tokens": counts})

    return run


def _stored(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame | None:
    try:
        rows = spark.read.schema("digest binary, n_tokens long").parquet(f"{cache}/tokenizer={tokenizer}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))  # two runs may have stored the same miss


def count_tokens(docs: DataFrame, cache: str, path: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit; null counts as the empty text.

    Content is normalised only as far as counts allow: null to empty, UTF-8. One text of each digest is kept before
    the shuffle, so a text with very many copies moves once per task; digests that the cache lacks are encoded and
    appended to it. Counts are joined back by digest to a table without texts, where Spark splits a digest that very
    many rows share.
    """
    spark, tokenizer = docs.sparkSession, version(path)
    content = text_or_empty(text)
    digest = F.unhex(F.sha2(content, 256)).alias("digest")
    keyed = cut(docs.select("doc_id", F.octet_length(content).cast("long").alias("n_bytes"), digest), "digests")
    misses = docs.select(digest, content.alias("text")).dropDuplicates(["digest"])
    if (stored := _stored(spark, cache, tokenizer)) is not None:
        misses = misses.join(stored, "digest", "left_anti")
    misses.mapInPandas(_encode(path), "digest binary, n_tokens long").write.mode("append").parquet(f"{cache}/tokenizer={tokenizer}")
    counts = cut(keyed.select("digest").distinct().join(_stored(spark, cache, tokenizer), "digest"), "counts")
    return keyed.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op4_token_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of two arrivals, by the sign of a hash of its id; the second meets the counts that the first has stored.

    Null texts count as empty, repeated rows and null ids give a row each, long texts count in whole, an empty table
    gives no rows.
    """
    docs, cache, early = table(spark, sf_dir, "documents"), shared_dir(spark, "token-cache"), F.xxhash64("doc_id") < 0
    first, second = (count_tokens(docs.where(part), cache, public_tokenizers.path("byte_bpe_50k.json")) for part in (early, ~early))
    return first.unionByName(second)
