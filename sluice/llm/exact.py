"""Exact dedup: streaming keyed state over digests, with a check of the full bytes on hits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK, cut, shared_dir, text_or_empty

#: State on disk. Its stores are many and small: no file space is taken in advance, all stores of an executor share one
#: bounded memory, and a store is closed once its batch is committed.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}

#: A file is taken in however much older it is than the newest one seen.
NEVER = "36500d"


def normalised(text: str = "text") -> Column:
    """The text without its blanks; null counts as empty."""
    return F.regexp_replace(text_or_empty(text), f"{BLANK}+", "")


def sha256(value: Column) -> Column:
    return F.unhex(F.sha2(value, 256))


#: Of equal texts the most code points stay, then the least doc_id (a whole number; null last), then the last place.
RANK = lambda: F.struct(
    "n_points", F.bitwise_not("doc_id").alias("small_first"), "doc_id", "file", "row"
)


def ingest(spark: SparkSession, path: str, work: str, text: str = "text", digest: Callable[[Column], Column] = sha256, files_per_batch: int = 1000) -> None:
    """Take in the files under path that have not been seen; may be called again as files arrive.

    Two streams, each resumed from its own checkpoint under work. The first writes the ledger: for each row its
    identifier, code points, digest and locator (file and row). The second holds the state: for each digest the
    number of rows and the identifier and locator of the one that stays. The state is kept in RocksDB on the
    executors' disks and in the checkpoint, and never expires. Rows of a batch are summed up per digest before the
    shuffle, so a text with very many copies reaches its state as one row per task.
    """
    schema = spark.read.parquet(path).schema
    arrivals = _arrivals(spark, path, files_per_batch).schema(schema).parquet(_folder(spark, path)[0])
    rows = arrivals.select(
        "doc_id",
        F.length(text_or_empty(text)).alias("n_points"),
        digest(normalised(text)).alias("digest"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    )
    _run(rows.writeStream.format("parquet").option("path", f"{work}/ledger"), f"{work}/ledger-checkpoint")

    def commit(changed: DataFrame, batch: int) -> None:
        changed.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{work}/groups/{batch:09d}")

    before = {k: spark.conf.get(k, None) for k in STATE}
    try:
        for k, v in STATE.items():
            spark.conf.set(k, v)
        ledger = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files_per_batch * 100).option("maxFileAge", NEVER).parquet(f"{work}/ledger")
        state = ledger.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.max(RANK()).alias("stay"))
        _run(state.writeStream.outputMode("update").foreachBatch(commit), f"{work}/state-checkpoint")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _folder(spark: SparkSession, path: str) -> tuple[str, str | None]:
    """A folder to watch, and the name of the one file in it that is meant, if path is a file."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return path, None
    return at.getParent().toString(), at.getName()


def _arrivals(spark: SparkSession, path: str, files_per_batch: int):
    reader, name = spark.readStream.option("maxFilesPerTrigger", files_per_batch).option("maxFileAge", NEVER), _folder(spark, path)[1]
    return reader if name is None else reader.option("pathGlobFilter", name)


def _run(writer, checkpoint: str) -> None:
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def verdicts(spark: SparkSession, path: str, work: str, text: str = "text") -> DataFrame:
    """For each row taken in: doc_id, digest, file, row, group_size, keep_id, kept.

    Rows of digests with more than one row (hits) are fetched by their locators and grouped by their full bytes.
    Where one digest stands for several texts, those rows get the groups of their bytes instead of the state's.
    """
    ledger = spark.read.parquet(f"{work}/ledger")
    groups = spark.read.parquet(f"{work}/groups/*").groupBy("digest").agg(F.max_by(F.struct("group_size", "stay"), "batch").alias("g")).select("digest", "g.*")
    groups = cut(groups, "groups")
    hits = ledger.join(groups.where("group_size > 1").select("digest"), "digest")
    here = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), text_or_empty(text).alias("whole"))
    content = cut(here.join(hits, ["file", "row"]).withColumn("bytes", normalised("whole")).drop("whole"), "hits")
    classes = content.groupBy("digest", "bytes").agg(F.count(F.lit(1)).alias("group_size"), F.max(RANK()).alias("stay"))
    classes = cut(classes, "classes")
    split = classes.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest")
    plain = ledger.join(groups.join(split, "digest", "left_anti"), "digest")
    exact = content.join(split, "digest", "left_semi").join(classes, ["digest", "bytes"]).select(plain.columns)
    same = (F.col("file") == F.col("stay.file")) & (F.col("row") == F.col("stay.row"))
    return plain.union(exact).select("doc_id", "digest", "file", "row", "group_size", F.col("stay.doc_id").alias("keep_id"), same.alias("kept"))


def exact_dedup(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents, one row of each group of equal texts, with the columns of docs. The rows land as files first."""
    spark = docs.sparkSession
    work = shared_dir(spark, "exact")
    docs.write.option("compression", "zstd").parquet(f"{work}/landing")
    ingest(spark, f"{work}/landing", work, text)
    kept = verdicts(spark, f"{work}/landing", work, text).where("kept").select("file", "row")
    rows = spark.read.schema(docs.schema).parquet(f"{work}/landing").select(F.struct("*").alias("doc"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return rows.join(kept, ["file", "row"], "left_semi").select("doc.*")


def op2_streaming_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of documents. Null and blank texts are equal; repeated rows and ids each give a row, one of them kept."""
    path, work = f"{sf_dir}/documents.parquet", shared_dir(spark, "exact")
    ingest(spark, path, work)
    found = verdicts(spark, path, work)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP2_SQL = r"""
WITH t AS (
    SELECT doc_id, length(coalesce(text, '')) AS n_points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
    FROM documents
), r AS (
    SELECT *, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
    FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r
"""
