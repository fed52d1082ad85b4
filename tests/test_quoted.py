"""Text with line breaks inside quotes, read in many tasks, against Python's own reader."""

import csv
import io
import random

import pytest

from sluice.operators.mapping import Field
from sluice.plans.entity import Binder, Entity
from sluice.sources import scan
from sluice.sources.quoted import has_quoted_breaks


def written(rows, end="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows(rows)
    return out.getvalue()


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_rows_over_many_splits(spark, tmp_path, end):
    rng = random.Random(7)
    cell = lambda: "".join(rng.choice(["a", "é", ",", '"', "\n", "\r\n", " ", "x" * 30, "\n" * 40]) for _ in range(rng.randrange(12)))
    rows = [[str(k), cell(), cell()] for k in range(3000)]
    rows[1500][1] = 'long "\n' * 20000  # one record over several splits
    (tmp_path / "d.csv").mkdir()
    for k in range(2):
        (tmp_path / "d.csv" / f"{k}.csv").write_bytes(("﻿" * (k == 0) + written([["id", "a", "b"], *rows[k * 2000 : k * 2000 + 2000]], end)).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        df = scan.read_any(spark, str(tmp_path / "d.csv"))
        assert df.columns == ["id", "a", "b", "_pos"]
        assert df.select("_pos.block").distinct().count() > 10
        got = [tuple(r)[:3] for r in df.orderBy("_pos").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [tuple(r) for r in rows]


def test_sources_and_last_wins(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,v\n1,"a\nb"\n2,c\n1,"d ""e""\n\nf"\n')
    (tmp_path / "all.csv").write_text('kind,id,v\nx,1,"p\nq"\ny,2,r\n')
    (tmp_path / "plain.csv").write_text('id,v\n1,"a, b"\n')
    assert has_quoted_breaks(spark, str(tmp_path / "t.csv")) and not has_quoted_breaks(spark, str(tmp_path / "plain.csv"))
    sources = scan.load_sources(spark, {"t": str(tmp_path / "t.csv"), "all": {"file": str(tmp_path / "all.csv"), "origin_column": True}})
    assert [tuple(r) for r in sources["x"].drop("_pos").collect()] == [("1", "p\nq", "x")]
    out = Binder(sources).bind(Entity("t", "relational", (Field("id", key=True), Field("v")))).shaped()
    assert sorted(map(tuple, out.drop("_partition").collect())) == [(1, 'd "e"\n\nf'), (2, "c")]


def test_a_stream_reads_the_same_rows(spark, tmp_path):
    from sluice.run import run_batch, run_stream
    from sluice.sinks.tables import Store

    (tmp_path / "t.csv").write_text('id,v\n1,"a\nb"\n2,c\n')
    config = {"sources": {"t": str(tmp_path / "t.csv")}, "document": {"entities": {"t": {"columns": {"id": {}, "v": {}}}}}}
    run_batch(spark, config, f"{tmp_path}/b")
    run_stream(spark, config, f"{tmp_path}/s", f"{tmp_path}/c")
    for way in "bs":
        assert sorted((r.id, r.v) for r in Store(spark, f"{tmp_path}/{way}/document").read("t").collect()) == [(1, "a\nb"), (2, "c")]


def test_white_space_around_values(spark):
    from sluice.functions.casts import cast_frame
    from sluice.functions.kinds import infer_kinds
    from sluice.functions.text import WHITE

    assert all((w + "x" + w).strip() == "x" for w in WHITE)
    df = spark.createDataFrame([(f"{w}true{w}", f"{w}-7{w}", f"{w}1.5{w}") for w in WHITE], "b string, i string, f string")
    assert infer_kinds(df) == {"b": "boolean", "i": "integer", "f": "float"}
    assert {tuple(r) for r in cast_frame(df, infer_kinds(df), rescue=False).collect()} == {(True, -7, 1.5)}
