"""First and last wins over batches by keyed state: the winner of each key is held by a streaming aggregate in RocksDB."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedupe
from ..operators.mapping import MappingError
from ..operators.shapes import PLACE
from ..sinks.tables import UPSERT, Store
from ..sources.scan import POSITION
from .stream import _placed, load_of

#: State lies in RocksDB on the executors' disks and its changes in the checkpoint, so its size is not bound to memory.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


@contextmanager
def _conf(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _winners(rows: DataFrame, keys: Sequence[str], wins: str) -> DataFrame:
    """(k0, k1, ..., best): of each key the place and the row that win so far. Rows with a null key are dropped."""
    for k in keys:
        rows = rows.where(F.col(f"`{k}`").isNotNull())
    whole = F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row")
    best = (F.max if wins == dedupe.LAST else F.min)(F.struct(F.col(PLACE), whole))
    return rows.groupBy(*(F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys))).agg(best.alias("best"))


def held(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """The winners that the state in a checkpoint holds, after its last batch or the one given: one row for each key."""
    reader = spark.read.format("statestore")
    state = (reader if batch is None else reader.option("batchId", batch)).load(checkpoint)
    (best,) = state.schema["value"].dataType.names  # the one aggregate of _winners
    return state.select(F.col("value")[best]["row"].alias("row")).select("row.*")


def keyed_stream(store: Store, name: str, stream: DataFrame, keys: Sequence[str], order: Sequence[str], checkpoint: str, wins: str = dedupe.LAST, across: str = UPSERT) -> None:
    """Store the first or last row of each key of a stream in the declared order, in whatever order its files come.

    Each batch is met with the state, not with what is stored, and writes one row for each key that it has. When all
    that is there has been read, the winners are written once from the state, so that reading the load is a plain scan;
    until then, and after a failure, readers settle its batches by _place, with the same rows. A later call with the same
    checkpoint goes on with the files that came since; what earlier loads stored is treated as `across` says. Ties of the
    order go to the row that compares greatest (for the first, least) by its columns. The order is compared with null as
    the least value. Columns of a map type cannot be compared and are refused, as is an order that the stream lacks.
    """
    spark = stream.sparkSession
    if missing := [c for c in (*keys, *order) if c not in stream.columns]:
        raise MappingError(f"the stream has no column {missing}")
    if not keys or not order or POSITION in order:
        raise MappingError("keyed state needs keys and a declared order")
    if maps := [c for c, t in stream.dtypes if "map<" in t]:
        raise MappingError(f"columns of a map type: {maps}")
    placed, _ = _placed(stream.drop(POSITION), order, 0)

    def put(changed: DataFrame, batch: int) -> None:
        store.store(name, changed.select("best.row.*"), keys, across, load_of(changed, checkpoint), batch, wins)

    with _conf(spark, STATE):
        query = _winners(placed, keys, wins).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        store.settle(name, query.id, lambda batch: held(spark, checkpoint, batch))
