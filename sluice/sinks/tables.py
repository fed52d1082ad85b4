"""Stored targets: plain Parquet folders, one for each load and batch, with the duplicate and re-run rules of each model."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import dedupe
from ..operators.filters import PARTITION
from ..operators.shapes import PLACE
from . import files

Writer = Callable[[DataFrame, "Store", str, Sequence[str]], None]
_WRITERS: dict[str, Writer] = {}
#: A batch's folder is named like a partition, so that one scan reads all batches of a load. What a load is stands in TOLD.
BATCH, TOLD = "_load_batch", "_load.json"
#: What a later load does to rows that are stored under its keys: nothing is unique; it leaves them; it takes their place;
#: it overwrites the properties that it carries.
APPEND, INSERT, UPSERT, MERGE = "append", "insert", "upsert", "merge"


class MissingTarget(FileNotFoundError):
    """The target does not exist and may not be created."""


@dataclass(frozen=True)
class Load:
    """One load of a target: its folder, columns and keys, and the rules within it (wins) and against earlier loads (across)."""

    folder: str
    schema: StructType
    keys: tuple[str, ...]
    across: str
    wins: str
    alone: bool  # nothing before it counts
    upto: int  # batches up to this one are in the folder `compacted`
    compacted: str | None


def _union(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)


class Store:
    """Targets under one folder. A target has a folder for each load, numbered as they began, and a load one for each batch.

    A batch is written over itself, so one that runs again, after a restart too, is stored once: a stream's load bears the
    id that its checkpoint holds, so neither another stream nor a new checkpoint at the same path meets its batches. The
    work of a write is that of its own rows. Rows are settled when they are read: of one load's rows with the same keys
    the first or last by _place stays, then the loads' rule decides; each is one aggregate over one scan of a load. A load
    is seen once its description is there, which a failed first batch leaves out.
    """

    def __init__(self, spark: SparkSession, root: str, create: bool = True, rows_per_file: int | None = None) -> None:
        self.spark, self.root, self.create, self.rows_per_file = spark, root.rstrip("/"), create, rows_per_file

    # loads

    def _folders(self, name: str) -> list[str]:
        return [n for n in files.names(self.spark, f"{self.root}/{name}") if n.startswith("load=")]

    def _load(self, name: str, folder: str) -> Load | None:
        at = f"{self.root}/{name}/{folder}"
        if TOLD not in files.names(self.spark, at):
            return None
        told = json.loads(files.read_text(self.spark, f"{at}/{TOLD}"))
        return Load(at, StructType.fromJson(told["schema"]), tuple(told["keys"]), told["across"], told["wins"], told["alone"], told["upto"], told["compacted"])

    def loads(self, name: str) -> list[Load]:
        """The loads that count, in the order in which they began."""
        found = [x for x in (self._load(name, n) for n in self._folders(name)) if x]
        alone = max((k for k, x in enumerate(found) if x.alone), default=0)
        return found[alone:]

    def exists(self, name: str) -> bool:
        return bool(self.loads(name))

    def _tell(self, x: Load) -> None:
        told = {"schema": x.schema.jsonValue(), "keys": x.keys, "across": x.across, "wins": x.wins, "alone": x.alone, "upto": x.upto, "compacted": x.compacted}
        files.publish(self.spark, f"{x.folder}/{TOLD}", json.dumps(told), over=True)

    def store(self, name: str, rows: DataFrame, keys: Sequence[str] = (), across: str = APPEND, load: str | None = None, batch: int = 0, wins: str = dedupe.LAST, alone: bool = False, order: Sequence[str] = ()) -> str | None:
        """Write a batch of a load, over itself if it is stored; its folder, or none where a compaction has taken it in.

        With order, the rows of a partition lie in that order, in files of separate ranges.
        """
        folders = self._folders(name)
        if not folders and not self.create:
            raise MissingTarget(name)
        load = load or uuid.uuid4().hex
        number = max((int(n[5:11]) for n in folders), default=-1) + 1
        folder = next((n for n in folders if n[12:] == load), f"load={number:06d}-{load}")
        known = self._load(name, folder)
        if known and batch <= known.upto:
            return None
        at = f"{self.root}/{name}/{folder}"
        self._write(f"{at}/{BATCH}={batch}", rows, order)
        if not known:
            self._tell(Load(at, rows.schema, tuple(keys), across, wins, alone, -1, None))
        return f"{at}/{BATCH}={batch}"

    def _write(self, path: str, rows: DataFrame, order: Sequence[str]) -> None:
        parts = [PARTITION] if PARTITION in rows.columns else []
        if order:
            by = [F.col(f"`{c}`") for c in (*parts, *(o for o in order if o not in parts))]
            rows = rows.repartitionByRange(*by).sortWithinPartitions(*by)  # a hot partition is cut by its keys, and the write keeps this order
        elif parts:
            rows = rows.hint("rebalance", PARTITION)  # rows of a partition together, a hot one in several tasks
        writer = rows.write.mode("overwrite").partitionBy(*parts)
        if self.rows_per_file:
            writer = writer.option("maxRecordsPerFile", self.rows_per_file)
        writer.parquet(path)

    # rows

    def _batches(self, x: Load) -> list[str]:
        numbers = sorted(int(n.split("=")[1]) for n in files.names(self.spark, x.folder) if n.startswith(f"{BATCH}="))
        return ([x.compacted] if x.compacted else []) + [f"{BATCH}={k}" for k in numbers if k > x.upto]

    def _rows(self, x: Load) -> DataFrame:
        """A load's rows, one for each key."""
        batches = self._batches(x)
        rows = self.spark.read.schema(x.schema).option("basePath", x.folder).parquet(*(f"{x.folder}/{b}" for b in batches)) if batches else self.spark.createDataFrame([], x.schema)
        rows = rows.select(*(F.col(f"`{c}`") for c in x.schema.names))
        if x.keys and len(batches) > 1:
            rows = rows.repartition(*(F.col(f"`{k}`") for k in x.keys))  # a key has one row a batch, so tasks that read would sort all theirs for nothing
            return dedupe.dedupe(rows, x.keys, [PLACE] if PLACE in rows.columns else [], x.wins, drop_blank=False)
        return rows

    def read(self, name: str) -> DataFrame:
        """The stored rows, with _partition as a column that filters prune folders by."""
        loads = self.loads(name)
        if not loads:
            raise MissingTarget(name)
        parts = [self._rows(x).drop(PLACE) for x in loads]
        last = loads[-1]
        if len(loads) == 1 or last.across == APPEND or not last.keys:
            return _union(parts)
        if PARTITION in last.keys:  # a load that was not partitioned is the partition of the target's name
            parts = [p if PARTITION in p.columns else p.withColumn(PARTITION, F.lit(name)) for p in parts]
        rows = _union(p.withColumn("_load", F.lit(k)) for k, p in enumerate(parts))
        if last.across != MERGE:
            return dedupe.dedupe(rows, last.keys, ["_load"], dedupe.FIRST if last.across == INSERT else dedupe.LAST, drop_blank=False).drop("_load")
        carried = {c: [k for k, p in enumerate(parts) if c in p.columns] for c in rows.columns if c not in (*last.keys, "_load")}
        return dedupe.last_written(rows, last.keys, "_load", carried)

    def written(self, folder: str) -> DataFrame:
        """(partition, rows) of a batch's folder: no column is read, so Parquet's footers give the counts."""
        name = folder[: folder.rindex("/load=")].rsplit("/", 1)[1]
        found = self.spark.read.schema(f"{PARTITION} string").option("basePath", folder).parquet(folder)
        return found.groupBy(F.coalesce(PARTITION, F.lit(name)).alias("partition")).agg(F.count(F.lit(1)).alias("rows"))

    def order_report(self, folder: str, by: Sequence[str]) -> DataFrame:
        """(partition, rows, disordered, overlaps) of a batch's folder.

        disordered counts the rows that sort below the row before them in their file, overlaps the files that begin below
        the end of a file before them. A file is one task's, a partition's files are one row each.
        """
        found = self.spark.read.option("basePath", folder).parquet(folder)
        name = folder[: folder.rindex("/load=")].rsplit("/", 1)[1]
        part = F.col(PARTITION) if PARTITION in found.columns else F.lit(name)
        rows = found.select(part.alias("partition"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"), F.struct(*(F.col(f"`{c}`") for c in by)).alias("key"))
        before = F.lag("key").over(Window.partitionBy("partition", "file").orderBy("at"))
        per_file = rows.withColumn("before", before).groupBy("partition", "file").agg(
            F.count(F.lit(1)).alias("rows"), F.count_if(F.col("key") < F.col("before")).alias("disordered"), F.min("key").alias("low"), F.max("key").alias("high")
        )
        earlier = F.max("high").over(Window.partitionBy("partition").orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1))
        out = per_file.withColumn("earlier", earlier).groupBy("partition")
        return out.agg(F.sum("rows").alias("rows"), F.sum("disordered").alias("disordered"), F.count_if(F.col("low") < F.col("earlier")).alias("overlaps"))

    def stored(self, name: str) -> DataFrame | None:
        return self.read(name) if self.exists(name) else None

    # by rule

    def replace(self, name: str, rows: DataFrame) -> None:
        """These rows are all."""
        self.store(name, rows, alone=True)

    def append(self, name: str, rows: DataFrame, load: str | None = None, batch: int = 0) -> str | None:
        """These rows beside the stored ones."""
        return self.store(name, rows, load=load, batch=batch)

    def upsert(self, name: str, rows: DataFrame, keys: Sequence[str], load: str | None = None, batch: int = 0, wins: str = dedupe.LAST, order: Sequence[str] = ()) -> str | None:
        """These rows, one for each key, instead of those of earlier loads with the same keys; within one load by their _place."""
        return self.store(name, rows, keys, UPSERT, load, batch, wins, order=order)

    def compact(self, name: str) -> None:
        """One folder for each load; one for all where no load has places, that is where no stream may still add to one."""
        loads = self.loads(name)
        if loads and not any(PLACE in x.schema.names for x in loads):
            last = loads[-1]
            self.store(name, self.read(name), last.keys, last.across, alone=True)
        else:
            for x in loads:
                self._settle(x, lambda _, x=x: self._rows(x))

    def settle(self, name: str, load: str, rows: Callable[[int], DataFrame]) -> None:
        """One folder for a load's batches: its settled rows, which `rows` gives as of the number of its last batch."""
        for x in self.loads(name):
            if x.folder.endswith(f"-{load}"):
                self._settle(x, rows)

    def _settle(self, x: Load, rows: Callable[[int], DataFrame]) -> None:
        if len(batches := self._batches(x)) > 1:
            made = f"{BATCH}=-{uuid.uuid4().int >> 64}"
            upto = max(int(b.split("=")[1]) for b in batches)
            self._write(f"{x.folder}/{made}", rows(upto).select(*(F.col(f"`{c}`") for c in x.schema.names)), [])
            self._tell(Load(x.folder, x.schema, x.keys, x.across, x.wins, x.alone, upto, made))

    def clean(self, name: str) -> None:
        """Forget all that a target has stored."""
        files.remove(self.spark, f"{self.root}/{name}")

    def ordered(self, name: str, *columns: str) -> DataFrame:
        """Read-back in the order of the given columns, of the first column if none is given."""
        df = self.read(name)
        return df.orderBy(*(columns or df.columns[:1]))


def preview(df: DataFrame, most: int = 50) -> tuple[list, int]:
    """(rows, count): the rows when there are at most `most`, else none of them and the count."""
    first = df.limit(most + 1).collect()
    return (first, len(first)) if len(first) <= most else ([], df.count())


def register_sink(model: str, writer: Writer) -> None:
    _WRITERS[model] = writer


def write(df: DataFrame, store: Store, name: str, model: str, keys: Sequence[str] = ()) -> str | None:
    """Store a load under the rules of its model; the folder that it lies in, where the sink tells it."""
    return _WRITERS[model](df, store, name, keys)


def scoped(df: DataFrame, keys: Sequence[str]) -> list[str]:
    """Keys are unique within a partition."""
    return [*([PARTITION] if PARTITION in df.columns else []), *keys] if keys else []


#: What a later load of each model does to stored keys.
RULES = {"relational": INSERT, "document": APPEND, "keyvalue": UPSERT, "wide": UPSERT, "graph": MERGE}


def store_as(model: str, store: Store, name: str, df: DataFrame, keys: Sequence[str], load: str | None = None, batch: int = 0, wins: str = dedupe.LAST) -> str | None:
    """Store a batch under the rule of its model; wide rows in the order of their keys."""
    keys = [] if RULES[model] == APPEND else scoped(df, keys)
    return store.store(name, df, keys, RULES[model] if keys else APPEND, load, batch, wins, order=keys if model == "wide" else ())


for _model in RULES:
    register_sink(_model, lambda df, store, name, keys, model=_model: store_as(model, store, name, df, keys))


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict[str, str], batch: int = 500) -> None:
    """Rows to a database table in batches; the table's own rules for keys hold."""
    df.drop(PARTITION).write.option("batchsize", batch).jdbc(url, table, mode="append", properties=properties)
