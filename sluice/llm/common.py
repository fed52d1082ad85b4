"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six blank characters of every contract: [\x20\x09-\x0D].
BLANK = r"[\x20\x09-\x0D]"
#: Bytes of a batch of rows on its way to a Python worker. Spark counts its rows alone (10,000), so that a batch, its copies
#: in the worker and the buffer that the executor keeps for it grow with the texts.
BATCH_BYTES = 2 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors see, under spark.checkpoint.dir.

    Only where that setting is absent and all runs in this process (tests on one machine) a temporary folder is set in
    its place; on a cluster its absence is an error, as executors do not see each other's folders.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='sluice-')}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """From now on batches for this session's Python workers end at BATCH_BYTES (one long text is a batch), unless the session has a limit of its own."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def crc32_sql(column: str) -> str:
    """DuckDB has no crc32: that of a column's ASCII text, bit by bit."""
    step = "lambda a, b: list_reduce(range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(a, b))"
    return f"xor(list_reduce(list_transform(string_split({column}::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT), {step}, 4294967295::BIGINT), 4294967295::BIGINT)"
