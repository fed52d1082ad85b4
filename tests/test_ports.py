"""Sinks outside the store: a port for streams, and a database."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sluice.operators import shapes
from sluice.operators.filters import Filter, apply_filters
from sluice.operators.mapping import Field, Nested
from sluice.sinks.jdbc import insert_absent
from sluice.sinks.port import JsonFolder, Port, run_to_port
from sluice.streaming.stream import file_stream

SCHEMA = "id long, name string, kind string"


def arrive(spark, folder, *files):
    for values in files:
        spark.createDataFrame(values, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return file_stream(spark, folder, SCHEMA)


def held(folder):
    return sorted((json.loads(line)["id"], json.loads(line)["about"]["name"]) for f in Path(folder).glob("*.json") for line in f.read_text().splitlines())


def entity(stream):
    return shapes.to_documents(apply_filters(stream, [Filter("kind", "==", "x")]), (Field("id"), Nested("about", (Field("name"),))))


def test_an_entity_goes_through_a_port_batch_by_batch(spark, tmp_path):
    out, port = f"{tmp_path}/out", JsonFolder(f"{tmp_path}/out")
    stream = arrive(spark, f"{tmp_path}/in", [(1, "a", "x"), (2, "b", "y")], [(3, None, "x")])
    run_to_port(entity(stream), port, f"{tmp_path}/c")
    assert held(out) == [(1, "a"), (3, None)]
    run_to_port(entity(arrive(spark, f"{tmp_path}/in", [(4, "é", "x")])), port, f"{tmp_path}/c")
    assert held(out) == [(1, "a"), (3, None), (4, "é")]
    last = max((tmp_path / "c/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for f in (last, last.with_name(f".{last.name}.crc")):
        f.unlink()  # stored, but the commit is lost: the batch runs again
    run_to_port(entity(arrive(spark, f"{tmp_path}/in")), port, f"{tmp_path}/c")
    assert held(out) == [(1, "a"), (3, None), (4, "é")] and not [p for p in Path(out).iterdir() if p.is_dir()]


class Refusing(JsonFolder):
    def write(self, rows):
        name = super().write(iter(rows))
        if "bad" in Path(name).read_text():
            raise ValueError("not this one")
        return name


def test_an_aborted_batch_leaves_nothing(spark, tmp_path):
    stream = arrive(spark, f"{tmp_path}/in", [(1, "a", "x")] * 5 + [(2, "bad", "x")] * 5)
    with pytest.raises(Exception, match="not this one"):
        run_to_port(entity(stream.repartition(4, "id")), Refusing(f"{tmp_path}/out"), f"{tmp_path}/c")
    assert held(f"{tmp_path}/out") == []
    assert not list(Path(f"{tmp_path}/out").iterdir())
    for call in (lambda p: p.write(iter(())), lambda p: p.commit([], 0), lambda p: p.abort([], 0)):
        with pytest.raises(NotImplementedError):
            call(Port())


def test_rows_of_a_database_are_inserted_if_absent(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = lambda *values: spark.createDataFrame(values, "code string, n int, at timestamp_ntz, _partition string")
    assert insert_absent(rows(("a", 1, None, "p"), ("b", 2, None, "p")), url, "stock", ["code"]) == 2
    assert insert_absent(rows(("b", 9, None, "p"), ("c", 3, None, "p")), url, "stock", ["code"]) == 1
    assert insert_absent(rows(("b", 9, None, "p"), ("c", 3, None, "p")), url, "stock", ["code"]) == 0
    found = spark.read.jdbc(url, "stock")
    assert found.columns == ["code", "n", "at"] and sorted((r.code, r.n) for r in found.collect()) == [("a", 1), ("b", 2), ("c", 3)]
    tables = spark.read.jdbc(url, "(SELECT tablename AS name FROM sys.systables WHERE tabletype = 'T') t")
    assert [r[0] for r in tables.collect()] == ["STOCK"]
    broken = rows(("d", 1, None, "p")).withColumn("n", F.raise_error(F.lit("no good")).cast("int"))
    with pytest.raises(Exception, match="no good"):
        insert_absent(broken, url, "stock", ["code"])
    assert spark.read.jdbc(url, "stock").count() == 3
