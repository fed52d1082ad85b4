"""Structured Streaming loads: the schema is bound first, each micro-batch goes through the batch operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.casts import RESCUED, cast_column, rescued
from ..functions.kinds import STRING
from ..operators import dedupe, shapes
from ..operators.filters import Filter, partitioned
from ..operators.filters import apply_filters as filtered
from ..operators.mapping import Field
from ..plans.entity import TEXT, Entity
from ..plans.reports import Metrics
from ..sinks.tables import Store, store_as
from ..sources.quoted import has_quoted_breaks
from ..sources.scan import POSITION, SourceError, as_text, combined, load_sources, read_any, resolved, slice_of, tagged

BatchRule = Callable[[DataFrame, int], None]
#: A file is read however much older it is than the newest one seen.
NEVER = "36500d"


def run_batches(stream: DataFrame, rule: BatchRule, checkpoint: str) -> None:
    """Everything that is there now, batch by batch; a later call goes on where this one ended."""
    stream.writeStream.foreachBatch(rule).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def load_of(batch: DataFrame, otherwise: str) -> str:
    """The load that a batch belongs to: the id of its stream, which the checkpoint holds; outside a stream what is given."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or otherwise


def file_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 1, fmt: str = "parquet", **options) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).option("maxFileAge", NEVER).options(**options).load(folder)


def _in_batch(batch: DataFrame) -> DataFrame:
    """A stream's places know file and block; the row in them is numbered here, as a stream itself cannot number rows."""
    if POSITION in batch.columns and "row" not in getattr(batch.schema[POSITION].dataType, "names", ["row"]):
        return batch.withColumn(POSITION, F.col(POSITION).withField("row", F.monotonically_increasing_id()))
    return batch


def _typed(batch: DataFrame, kinds: dict[str, str], order: Sequence[str]) -> DataFrame:
    """Cells by their kinds, also as text (_text), those that do not fit in _rescued; places, and order columns that are no text, as they are."""
    place = [c for c in dict.fromkeys((*order, POSITION)) if c in batch.columns and c not in kinds]
    text = [c for c in batch.columns if c != POSITION]
    typed = (cast_column(F.col(f"`{c}`"), kinds.get(c, STRING)).alias(c) for c in batch.columns if c not in place)
    return batch.select(*place, *typed, F.struct(*(F.col(f"`{c}`") for c in text)).alias(TEXT), rescued(text, kinds).alias(RESCUED))


def _store_rescued(store: Store, name: str, rows: DataFrame, load: str, batch_id: int) -> None:
    """The rows' texts that have cells their kinds cannot hold, null keys too, in <name>_rescued."""
    store.append(f"{name}{RESCUED}", rows.where(F.size(RESCUED) > 0).select(f"{TEXT}.*", RESCUED), load, batch_id)


def _placed(rows: DataFrame, order: Sequence[str], batch_id: int) -> tuple[DataFrame, list[str]]:
    """The rows with _place, and the columns to order them by: the declared ones, or arrival where the stream has none of them."""
    known = [o for o in order if o in rows.columns]
    if not known:
        known, rows = [POSITION], rows.withColumn(POSITION, F.struct(F.lit(batch_id).alias("batch"), F.monotonically_increasing_id().alias("row")))
    return rows.withColumn(shapes.PLACE, F.struct(*(F.col(f"`{o}`").alias(f"o{i}") for i, o in enumerate(known)))), known


def _shape(e: Entity, rows: DataFrame, order: Sequence[str]) -> tuple[DataFrame, list[str]]:
    keys = [f.name for f in e.columns if getattr(f, "key", False)]
    if e.model == "relational":
        return shapes.to_relational(rows, e.columns, order), keys
    if e.model == "document":
        return shapes.to_documents(rows, e.columns), []
    if e.model == "keyvalue":
        return shapes.to_keyvalue(rows, e.columns, order), ["key"]
    if e.model == "wide":
        return shapes.to_wide(rows, e.columns, e.partition, e.cluster, order), [*e.partition, *e.cluster]
    return shapes.to_nodes(rows, e.columns, order), keys


class EntityStream:
    """Loads entities from one stream of text rows. All entities of a batch share its one scan.

    Across batches the rules are those of one batch over all rows, in the entity's declared order and not that of
    arrival (which holds only where no order is declared): relational, key-value and wide rows take the last row of a
    key, nodes the first. A load is one stream with its resumptions; against earlier loads a model's rule is that of a
    batch run: relational rows stay, nodes take on the properties of the new ones. A batch that runs again is stored
    once. Rows that pass the filters and have cells that do not fit the bound kinds are also kept as text in
    <entity>_rescued. What each batch read and wrote is in metrics, counted on the way.
    """

    def __init__(self, store: Store, entities: Sequence[Entity], kinds: dict[str, str], metrics: Metrics | None = None) -> None:
        self.store, self.entities, self.kinds, self.load, self.metrics = store, list(entities), kinds, uuid.uuid4().hex, metrics or Metrics()

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        load = load_of(batch, self.load)
        batch = _in_batch(batch).persist()
        try:
            for e in self.entities:
                rows = partitioned(filtered(_typed(batch, self.kinds, e.order), list(e.filters), self.kinds), list(e.filters), e.name)

                def put(rows: DataFrame, e: Entity = e) -> str | None:
                    shaped, keys = _shape(e, *_placed(rows.drop(TEXT, RESCUED), e.order, batch_id))
                    return store_as(e.model, self.store, e.name, shaped if keys else shaped.drop(shapes.PLACE), keys, load, batch_id, dedupe.FIRST if e.model == "graph" else dedupe.LAST)

                if self.metrics.stored(self.store, e.model, e.name, rows, put):
                    _store_rescued(self.store, e.name, rows, load, batch_id)
        finally:
            batch.unpersist()


class EdgeStream:
    """Loads edges from a stream of text rows, after the streams of their nodes have ended.

    Only rows that pass the filters (those of the from-entity) and whose both ends are stored nodes make an edge; of the
    same ends and merge keys the last row in the declared order wins, over all batches, and overwrites the properties of
    an edge of an earlier load.
    """

    def __init__(self, store: Store, name: str, ends: tuple[str, str], nodes: tuple[tuple[str, str], tuple[str, str]], kinds: dict[str, str], properties: Sequence[Field] = (), order: Sequence[str] = (), filters: Sequence[Filter] = (), metrics: Metrics | None = None) -> None:
        self.store, self.name, self.ends, self.nodes, self.kinds, self.properties, self.order, self.load = store, name, ends, nodes, kinds, properties, order, uuid.uuid4().hex
        self.filters, self.metrics = list(filters), metrics or Metrics()

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        load = load_of(batch, self.load)
        typed = _typed(_in_batch(batch), self.kinds, self.order)
        rows = partitioned(filtered(typed, self.filters, self.kinds), self.filters, self.name)
        (start, start_key), (end, end_key) = self.nodes

        def put(rows: DataFrame) -> str | None:
            placed, order = _placed(rows.drop(TEXT, RESCUED), self.order, batch_id)
            edges = shapes.to_edges(placed, *self.ends, self.name, self.store.read(start), start_key, self.store.read(end), end_key, self.properties, order)
            return store_as("graph", self.store, self.name, edges, ["src", "dst", *(f.name for f in self.properties if f.key)], load, batch_id)

        if self.metrics.stored(self.store, "graph", self.name, rows, put):
            _store_rescued(self.store, self.name, rows, load, batch_id)


def path_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1, fmt: str = "parquet", **options) -> DataFrame:
    """A stream over a folder, or over one file of a folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        path = f"{path[:-1]}[{path[-1]}]"  # a stream takes folders and patterns; what else the file's folder holds is not looked at
    return file_stream(spark, path, schema, files_per_batch, fmt, **options)


def table_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A stream over a Parquet folder, or over one Parquet file of a folder."""
    return path_stream(spark, path, spark.read.parquet(path).schema, files_per_batch)


def text_stream(spark: SparkSession, path: str, header: list[str], files_per_batch: int = 1) -> DataFrame:
    """The stream of read_any: columns as text, blank cells "", and _pos with the file and block of a row.

    Of files with line breaks inside quotes each is one task's.
    """
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "parquet":
        stream = table_stream(spark, path, files_per_batch)
    elif kind in ("json", "jsonl"):
        stream = path_stream(spark, path, spark.read.json(path).schema, files_per_batch, "json")
    else:
        schema = StructType([StructField(c, StringType()) for c in header])
        stream = path_stream(spark, path, schema, files_per_batch, "csv", header=True, sep="\t" if kind == "tsv" else ",", escape='"', enforceSchema=False, multiLine=has_quoted_breaks(spark, path))
    place = F.struct(F.lit(0).alias("part"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return as_text(stream).withColumn(POSITION, place)


def stream_sources(spark: SparkSession, declared: dict, overrides: dict | None = None, files_per_batch: int = 1, base: str | None = None) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """(tables to bind by, streams) of the declared sources and of the origins of combined ones, under the same names."""
    if unknown := set(overrides or {}) - set(declared):
        raise SourceError(f"override of an undeclared source: {sorted(unknown)}")
    tables: dict[str, DataFrame] = {}
    streams: dict[str, DataFrame] = {}
    for name, spec in declared.items():
        path = resolved(name, spec, overrides, base)
        found = load_sources(spark, {name: spec}, {name: path})
        if twice := set(found) & set(tables):
            raise SourceError(f"two sources are named {sorted(twice)}")
        tables |= found
        whole = isinstance(spec, dict) and bool(spec.get("origin_column"))
        header = [c for c in read_any(spark, path).columns if c != POSITION]
        stream = text_stream(spark, path, header, files_per_batch)
        streams[name] = combined(stream, header[0]) if whole else tagged(stream, name)
        streams |= {origin: slice_of(streams[name], origin) for origin in found if origin != name}
    return tables, streams


def rows_stored(loader: EntityStream) -> dict[str, int]:
    """Rows of each entity's target."""
    return {e.name: loader.store.read(e.name).count() for e in loader.entities if loader.store.exists(e.name)}


def _keyed(store: Store, name: str, batch: DataFrame, keys: Sequence[str], order: Sequence[str], batch_id: int | None, wins: str, load: str | None) -> None:
    placed, known = _placed(batch, order, batch_id or 0)
    store.upsert(name, dedupe.dedupe(placed, keys, known, wins, drop_blank=False).drop(POSITION), keys, load or load_of(batch, wins), batch_id or 0, wins)


def first_wins(store: Store, name: str, batch: DataFrame, keys: Sequence[str], order: Sequence[str], batch_id: int | None = None, load: str | None = None) -> None:
    """Store a batch's first row of each key; of all batches of a load the first in order is read back, whenever it came.

    A stream is a load by itself; batches that are no stream's belong to the load that is named, or to one load.
    """
    _keyed(store, name, batch, keys, order, batch_id, dedupe.FIRST, load)


def last_wins(store: Store, name: str, batch: DataFrame, keys: Sequence[str], order: Sequence[str], batch_id: int | None = None, load: str | None = None) -> None:
    """Store a batch's last row of each key; of all batches of a load the last in order is read back, whenever it came."""
    _keyed(store, name, batch, keys, order, batch_id, dedupe.LAST, load)
