"""Sharding: immutable shards, size-tiered compaction and a versioned manifest. DataFrame functions only."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, table

#: Bytes of a finished shard, and of the smallest tier.
TARGET, SMALLEST = 128 << 20, 1 << 20
#: Shards of one tier that are worth a merge; each tier is so many times as large as the one below.
FANOUT = 4
#: Shards that one round of compaction reads at most; rounds are repeated until no tier has a run left to merge.
ROUND = 10_000
#: Arrivals that the query makes of the table.
ARRIVALS = 4
#: Shards that are lined up together when runs are cut.
LINE = 1024

ENTRY = "path string, bytes long, rows long, created long"


class Conflict(RuntimeError):
    """Another writer committed the version first; nothing was published."""


class ShardStore:
    """A folder of Parquet shards and manifests.

    A shard is one file and is never changed. manifest/v00000001 and so on each list all shards of a version; a version
    is published by renaming its complete folder to a name that must not exist, so that readers see a whole version
    or none, and of two writers one fails with Conflict. Rows are kept whole: any column, nulls and repeats included.
    """

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET, fanout: int = FANOUT, smallest: int = SMALLEST) -> None:
        self.spark, self.root, self.target, self.fanout, self.smallest = spark, root.rstrip("/"), target, fanout, smallest

    # the manifest

    def _jvm_path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._jvm_path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder = self._jvm_path(f"{self.root}/manifest")
        if not self._fs().exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs().listStatus(folder)]
        return sorted(int(n[1:]) for n in names if n.startswith("v"))

    def version(self) -> int:
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).parquet(f"{self.root}/manifest/v{version:08d}")

    def commit(self, entries: DataFrame, after: int) -> int:
        """Publish entries as the version that follows `after`."""
        made = f"{self.root}/manifest/.{uuid.uuid4().hex}"
        entries.select("path", "bytes", "rows", "created").write.parquet(made)
        jvm = self.spark._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._jvm_path(self.root).toUri(), self.spark._jsc.hadoopConfiguration())
        no_overwrite = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(self._jvm_path(made), self._jvm_path(f"{self.root}/manifest/v{after + 1:08d}"), no_overwrite)
        except Exception as e:
            self._fs().delete(self._jvm_path(made), True)
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                raise Conflict(f"version {after + 1} exists") from e
            raise
        return after + 1

    # shards

    def _listed(self, paths: list[str] | str, version: int, columns) -> DataFrame:
        found = self.spark.read.schema(columns).option("recursiveFileLookup", True).parquet(paths)
        file = found.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
        return file.groupBy("path", "bytes").agg(F.count(F.lit(1)).alias("rows")).withColumn("created", F.lit(version).cast("long"))

    def append(self, rows: DataFrame) -> int:
        """Write rows as they are spread, a small shard for each partition, and publish them."""
        now = self.version()
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(folder)
        return self._publish(folder, lambda: self.manifest(now).union(self._listed(folder, now + 1, rows.schema)), now)

    def _publish(self, folder: str, entries: Callable[[], DataFrame], after: int) -> int:
        """Commit a version with new shards; where it is refused they go."""
        try:
            return self.commit(entries(), after)
        except Conflict:
            self._fs().delete(self._jvm_path(folder), True)
            raise

    def read(self, version: int | None = None, schema=None) -> DataFrame:
        """The rows of a version, with the path of each row's shard as last column: shard, or _shard and so on if there is one."""
        paths = [r.path for r in self.manifest(version).select("path").toLocalIterator()]
        reader = self.spark.read.schema(schema) if schema is not None else self.spark.read
        rows = reader.parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        name = "shard"
        while name in rows.columns:
            name = f"_{name}"
        return rows.select("*", (F.col("_metadata.file_path") if paths else F.lit("")).alias(name))

    def plan(self, entries: DataFrame) -> DataFrame:
        """path and run of the shards to merge, those of a tier up to the target size: `fanout` of them, or fewer that make a finished shard.

        Shards are lined up in groups of about LINE by a hash of their path, so that no task lines up a whole tier.
        """
        tier = F.floor(F.log(F.greatest(F.lit(1.0), F.col("bytes") / self.smallest)) / F.log(F.lit(float(self.fanout)))).cast("int")
        open_ = entries.where(F.col("bytes") < self.target / 2).withColumn("tier", tier)
        tiers = open_.groupBy("tier").agg(F.ceil(F.count(F.lit(1)) / LINE).alias("lines"))
        lined = open_.join(tiers, "tier").withColumn("line", F.pmod(F.xxhash64("path"), "lines"))
        upto = F.sum("bytes").over(Window.partitionBy("tier", "line").orderBy("created", "path"))
        cut = lined.withColumn("slot", F.floor((upto - F.col("bytes")) / self.target))
        by = Window.partitionBy("tier", "line", "slot")
        sized = cut.withColumn("n", F.count(F.lit(1)).over(by)).withColumn("sum", F.sum("bytes").over(by))
        runs = sized.where((F.col("n") >= self.fanout) | (F.col("n") > 1) & (F.col("sum") >= self.target / 2))
        return runs.select("path", F.concat_ws("-", "tier", "line", "slot").alias("run"))

    def compact_round(self, schema) -> bool:
        """Merge the planned runs of at most ROUND shards into one shard each and publish; False if there are none."""
        now = self.version()
        live = self.manifest(now)
        chosen = self.plan(live).orderBy("run", "path").limit(ROUND).collect()  # bounded by ROUND
        whole = {}
        for r in chosen:
            whole.setdefault(r.run, []).append(r.path)
        if len(chosen) == ROUND and len(whole) > 1:
            whole.pop(chosen[-1].run)  # perhaps cut by the limit: left for the next round
        runs = [(p, k) for k, paths in enumerate(whole.values()) for p in paths]
        if not runs:
            return False
        plan = self.spark.createDataFrame(runs, "path string, run int")
        rows = self.spark.read.schema(schema).parquet(*(p for p, _ in runs)).select(F.struct("*").alias("row"), F.col("_metadata.file_path").alias("path"))
        merged = rows.join(F.broadcast(plan), "path").repartitionById(len(whole), F.col("run"))  # each run is one task's, and no task has two
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        merged.select("row.*").write.option("compression", "zstd").parquet(folder)
        rest = live.join(F.broadcast(plan.select("path")), "path", "left_anti").select("path", "bytes", "rows", "created")
        self._publish(folder, lambda: rest.union(self._listed(folder, now + 1, schema)), now)
        return True

    def compact(self, schema) -> int:
        """Rounds until no tier has a run left; the version then. Each merge leaves fewer, larger shards, so it ends."""
        while self.compact_round(schema):
            pass
        return self.version()

    def vacuum(self, keep: int = 1) -> int:
        """Delete manifests but the last `keep` and the shards that only they list; the number of shards deleted."""
        versions = self.versions()
        old, kept = versions[:-keep], versions[-keep:]
        if not old:
            return 0
        paths = lambda vs: self.spark.read.schema(ENTRY).parquet(*(f"{self.root}/manifest/v{v:08d}" for v in vs)).select("path").distinct()
        gone = 0
        for r in paths(old).join(paths(kept), "path", "left_anti").toLocalIterator():
            gone += bool(self._fs().delete(self._jvm_path(r.path), False))
        for v in old:
            self._fs().delete(self._jvm_path(f"{self.root}/manifest/v{v:08d}"), True)
        return gone


def op8_size_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents appended in ARRIVALS parts, compacted after each, and read back from the last manifest: doc_id, n_bytes, text_sha256 of each row.

    Each row belongs to one arrival, by a hash of its id. Null texts have null counts and digests; repeated rows, empty
    and long texts are rows like any other; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    store = ShardStore(spark, shared_dir(spark, "shards"))
    arrival = F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS))
    for k in range(ARRIVALS):
        store.append(docs.where(arrival == k))
        store.compact(docs.schema)
        store.vacuum(keep=2)  # the version before can still be read
    return store.read(schema=docs.schema).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"))


OP8_SQL = "SELECT doc_id, strlen(text) AS n_bytes, sha256(text) AS text_sha256 FROM documents"
