"""A streaming sink of one's own: a port gets each task's rows, and commits or aborts each batch as a whole."""

from __future__ import annotations

import base64
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage

FORMAT = "sluice_port"


class Port:
    """What a sink does. write runs in the tasks, commit and abort once a batch; a batch that runs again has the same number."""

    def begin(self) -> None:
        """Called before a stream starts, on the driver."""

    def end(self) -> None:
        """Called after a stream has ended or failed, on the driver."""

    def write(self, rows: Iterator[Row]) -> str:
        """Put a task's rows where nobody looks yet; what names them."""
        raise NotImplementedError

    def commit(self, written: list[str], batch: int) -> None:
        """Make the tasks' rows seen, in place of those that the batch has put before."""
        raise NotImplementedError

    def abort(self, written: list[str], batch: int) -> None:
        """Leave nothing of what the tasks that got so far have written."""
        raise NotImplementedError


@dataclass
class Written(WriterCommitMessage):
    name: str


class _Writer(DataSourceStreamWriter):
    def __init__(self, port: Port) -> None:
        self.port = port

    def write(self, iterator: Iterator[Row]) -> Written:
        return Written(self.port.write(iterator))

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self.port.commit([m.name for m in messages if m], batchId)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self.port.abort([m.name for m in messages if m], batchId)


class PortSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def streamWriter(self, schema, overwrite: bool) -> _Writer:
        return _Writer(cloudpickle.loads(base64.b64decode(self.options["port"])))


def run_to_port(stream: DataFrame, port: Port, checkpoint: str) -> None:
    """Everything that is there now, batch by batch, through a port; a later call goes on where this one ended."""
    stream.sparkSession.dataSource.register(PortSource)
    told = base64.b64encode(cloudpickle.dumps(port)).decode()
    writer = stream.writeStream.format(FORMAT).option("port", told).option("checkpointLocation", checkpoint)
    port.begin()
    try:
        writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        port.end()


@dataclass
class JsonFolder(Port):
    """JSON lines in a folder that the driver and all executors have mounted, a file for each task of a batch.

    Tasks write in a folder of this port; an aborted batch takes it away, so that tasks that come late fail as well.
    """

    path: str
    run: str = field(default_factory=lambda: f".{uuid.uuid4().hex}")

    def begin(self) -> None:
        os.makedirs(f"{self.path}/{self.run}", exist_ok=True)

    def end(self) -> None:
        shutil.rmtree(f"{self.path}/{self.run}", ignore_errors=True)

    def write(self, rows: Iterator[Row]) -> str:
        name = f"{self.path}/{self.run}/{uuid.uuid4().hex}"
        with open(name, "x", encoding="utf-8") as out:
            for row in rows:
                out.write(json.dumps(row.asDict(True), default=str) + "\n")
        return name

    def commit(self, written: list[str], batch: int) -> None:
        mine = f"batch={batch}-"
        names = [f"{mine}{k}.json" for k in range(len(written))]
        for name, to in zip(written, names):
            os.replace(name, f"{self.path}/{to}")
        for old in os.listdir(self.path):
            if old.startswith(mine) and old not in names:
                os.remove(f"{self.path}/{old}")

    def abort(self, written: list[str], batch: int) -> None:
        self.end()
