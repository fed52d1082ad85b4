"""Loads that follow each other: two streams, new checkpoints, second loads by batch and stream, references, metrics."""

import warnings

import pytest

from sluice.operators.mapping import Field
from sluice.operators.relate import DanglingReference
from sluice.plans.entity import Entity
from sluice.plans.reports import Metrics
from sluice.run import run_batch, run_references, run_stream
from sluice.sinks.tables import Store, store_as
from sluice.streaming.stream import EntityStream, file_stream, first_wins, last_wins, run_batches


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def arrive(spark, folder, *files):
    for k, values in enumerate(files):
        spark.createDataFrame(values, "k long, o long").coalesce(1).write.mode("append").parquet(folder)
    return file_stream(spark, folder, "k long, o long")


def test_two_streams_into_one_target_and_a_batch_after_them(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    put = lambda rule: lambda batch, k: rule(store, "t", batch, ["k"], ["o"], k)
    run_batches(arrive(spark, f"{tmp_path}/a", [(1, 5)], [(1, 3), (3, 1)], [(1, 4)]), put(first_wins), f"{tmp_path}/ca")
    run_batches(arrive(spark, f"{tmp_path}/b", [(1, 20)], [(2, 2)]), put(first_wins), f"{tmp_path}/cb")  # batches 0 and 1 of another stream
    assert rows(store.read("t")) == [(1, 20), (2, 2), (3, 1)]
    last_wins(store, "t", spark.createDataFrame([(9, 9)], "k long, o long"), ["k"], ["o"], load="later")
    assert rows(store.read("t")) == [(1, 20), (2, 2), (3, 1), (9, 9)]  # the first load is still settled by first wins
    first = store.loads("t")[0]
    assert (first.wins, rows(store._rows(first).select("k", "o"))) == ("first", [(1, 3), (3, 1)])


def test_a_new_checkpoint_at_an_old_path_is_a_new_load_and_a_replay_is_not(spark, tmp_path):
    import shutil

    store, e = Store(spark, f"{tmp_path}/s"), Entity("t", "document", (Field("k"), Field("o")))
    load = lambda: EntityStream(store, [e], {"k": "integer", "o": "integer"})
    stream = lambda folder: arrive(spark, f"{tmp_path}/{folder}").selectExpr("string(k) k", "string(o) o")
    arrive(spark, f"{tmp_path}/a", [(1, 1)], [(2, 2)])
    run_batches(stream("a"), load(), f"{tmp_path}/c")
    for last in (tmp_path / "c/commits").glob("*1*"):
        last.unlink()  # the last batch has been stored, but its commit is lost
    run_batches(stream("a"), load(), f"{tmp_path}/c")
    assert rows(store.read("t").select("k", "o")) == [(1, 1), (2, 2)]
    shutil.move(f"{tmp_path}/c", f"{tmp_path}/old")
    arrive(spark, f"{tmp_path}/b", [(3, 3)])
    run_batches(stream("b"), load(), f"{tmp_path}/c")
    assert rows(store.read("t").select("k", "o")) == [(1, 1), (2, 2), (3, 3)]


def test_a_failed_first_batch_leaves_nothing_and_rescued_and_replaced_loads(spark, tmp_path):
    from pyspark.sql import functions as F

    store = Store(spark, f"{tmp_path}/s")
    with pytest.raises(Exception, match="no good"):
        store.append("t", spark.range(3).select(F.raise_error(F.lit("no good")).alias("k")), "x")
    assert not store.exists("t")
    store.append("t", spark.range(3), "x")
    store.append("t", spark.range(2), "x")  # the same batch of the same load
    assert store.read("t").count() == 2
    store.replace("t", spark.range(5))
    assert store.read("t").count() == 5


def test_properties_of_later_loads_win_null_is_a_value_and_what_is_not_carried_stays(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    put = lambda values, shape: store_as("graph", store, "n", spark.createDataFrame(values, shape), ["k"])
    put([(1, "a", 1), (2, "b", 2)], "k int, v string, w int")
    put([(1, None), (3, "c")], "k int, v string")
    put([(2, 9, "z")], "k int, w int, u string")
    assert rows(store.read("n").select("k", "v", "w", "u")) == rows(spark.createDataFrame([(1, None, 1, None), (2, "b", 9, "z"), (3, "c", None, None)], "k int, v string, w int, u string"))


CONFIG = {
    "relational": {
        "entities": {
            "products": {"source": "stock", "columns": {"id": {"is_key": True}, "name": {}}},
            "lines": {"source": "sale", "columns": {"line": {"is_key": True}, "id": {}}, "filters": [{"column": "qty", "operator": "<", "value": 100}]},
        },
        "relationships": {"of": {"from": "lines", "to": "products", "foreign_key": "id"}, "in-set": {"from": "products", "to": "products", "foreign_key": "id"}},
    },
    "document": {"entities": {"catalog": {"source": "stock", "columns": {"name": {}}}}},
    "keyvalue": {"entities": {"latest": {"source": "sale", "columns": {"id": {"is_key": True}, "qty": {}}}}},
    "wide": {"entities": {"log": {"source": ["stock", "sale"], "columns": {"id": {}, "kind": {"csv_column": "_source"}, "qty": {}}, "partition": ["id"], "cluster": ["kind"]}}},
    "graph": {
        "entities": {"product": {"source": "stock", "columns": {"id": {"is_key": True}, "name": {}}}, "line": {"source": "sale", "columns": {"line": {"is_key": True}}}},
        "relationships": {"sold": {"from": "line", "to": "product", "type": "SOLD", "columns": {"qty": {}}}},
    },
}
FIRST = ("id,name\n1,a\n2,b\n2,b2\n", "line,id,qty\n10,1,5\n11,2,9\n10,2,7\n")
SECOND = ("id,name\n2,\n3,c\n", "line,id,qty\n10,1,6\n13,3,2\n11,2,9\n")
TARGETS = [("relational", "products"), ("relational", "lines"), ("document", "catalog"), ("keyvalue", "latest"), ("wide", "log"), ("graph", "product"), ("graph", "line"), ("graph", "SOLD")]


def stored(spark, root):
    at = lambda model, name: Store(spark, f"{root}/{model}").read(name)
    return {name: sorted(repr(r.asDict(True)) for r in at(model, name).select(*sorted(at(model, name).columns)).collect()) for model, name in TARGETS}


def test_second_loads_store_the_same_by_batch_and_by_stream(spark, tmp_path):
    for k, (stock, sale) in enumerate((FIRST, SECOND)):
        (tmp_path / str(k)).mkdir()
        (tmp_path / str(k) / "stock.csv").write_text(stock)
        (tmp_path / str(k) / "sale.csv").write_text(sale)
        config = {"sources": {"stock": "stock.csv", "sale": "sale.csv"}} | CONFIG  # paths are of the configuration's folder
        run_batch(spark, config, f"{tmp_path}/b", base=str(tmp_path / str(k)))
        run_stream(spark, config, f"{tmp_path}/s", f"{tmp_path}/c{k}", base=str(tmp_path / str(k)))
        assert stored(spark, f"{tmp_path}/s") == stored(spark, f"{tmp_path}/b")
    graph = Store(spark, f"{tmp_path}/s/graph")
    assert rows(graph.read("product").select("id", "name")) == [(1, "a"), (2, None), (3, "c")] or rows(graph.read("product").select("id", "name")) == [(1, "a"), (2, ""), (3, "c")]
    assert rows(graph.read("SOLD").select("src", "dst", "qty")) == [(10, 1, 6), (10, 2, 7), (11, 2, 9), (13, 3, 2)]
    assert rows(Store(spark, f"{tmp_path}/b/relational").read("lines").select("line", "id")) == [(10, 2), (11, 2), (13, 3)]


def test_metrics_references_warnings_and_clean(spark, tmp_path):
    (tmp_path / "stock.csv").write_text(FIRST[0])
    (tmp_path / "sale.csv").write_text("line,id,qty\n10,1,5\n11,8,9\n12,9,700\n,2,1\n")
    config = {"sources": {"stock": str(tmp_path / "stock.csv"), "sale": str(tmp_path / "sale.csv")}} | {"relational": CONFIG["relational"]}
    for way in ("batch", "stream"):
        root, metrics = f"{tmp_path}/{way}", Metrics()
        run = (lambda **k: run_batch(spark, config, root, **k)) if way == "batch" else (lambda **k: run_stream(spark, config, root, f"{root}-c", **k))
        with pytest.warns(UserWarning, match="lines_products_of_fk: 1 of 2"):
            counts = run(metrics=metrics)
        assert [tuple(r) for r in run_references(spark, config, root).orderBy("constraint").collect()] == [("lines_products_of_fk", 2, 1), ("products_products_in_set_fk", 2, 0)]
        told = metrics.frame(spark)
        assert rows(told.where("phase = 'write' and partition is not null").select("target", "entity", "partition", "rows")) == rows(counts)
        assert rows(told.where("phase = 'filter'").select("entity", "rows")) == [("lines", 3), ("products", 3)]
        assert told.where("phase = 'write' and partition is null and seconds > 0").count() == 2
    with pytest.raises(DanglingReference, match="lines_products_of_fk"):
        run_batch(spark, config, f"{tmp_path}/batch", strict=True)
    (tmp_path / "stock.csv").write_text("id,name\n")
    with pytest.warns(UserWarning, match="nothing was written to products"):
        run_batch(spark, config, f"{tmp_path}/batch", clean=True)
    assert Store(spark, f"{tmp_path}/batch/relational").read("products").count() == 0


def test_rescued_rows_pass_the_filters_and_do_not_double(spark, tmp_path):
    dates = "".join(f"{k},2024-01-0{k},x\n" for k in range(1, 8))
    (tmp_path / "t.csv").write_text(f"id,at,keep\n{dates}8,soon,x\n9,never,y\n")
    config = {"sources": {"t": str(tmp_path / "t.csv")}, "relational": {"entities": {"t": {"columns": {"id": {"is_key": True}, "at": {}}, "filters": [{"column": "keep", "operator": "==", "value": "x"}]}}}}
    config["sources"]["t"] = str(tmp_path / "t.csv")
    (tmp_path / "t.csv").write_text(f"id,at,keep\n{dates}{dates.replace('2024-01', '2024-02')}8,soon,x\n9,never,y\n")
    for _ in range(2):
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            run_batch(spark, config, f"{tmp_path}/o")
        assert [(r.id, r._rescued) for r in Store(spark, f"{tmp_path}/o/relational").read("t_rescued").collect()] == [("8", {"at": "soon"})]


def test_wide_rows_lie_in_order_in_files_of_separate_ranges(spark, tmp_path):
    from pyspark.sql import functions as F

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store = Store(spark, f"{tmp_path}/s")
        data = spark.range(4000).select(F.when(F.col("id") % 4 > 0, 7).otherwise(F.col("id") % 50).alias("user"), ((F.col("id") * 7919) % 4001).alias("at"), F.lit("p").alias("_partition"))
        store_as("wide", store, "w", data, ["user", "at"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ranges = []
    for f in (tmp_path / "s/w").glob("*/*/_partition=p/*.parquet"):
        found = [tuple(r) for r in spark.read.parquet(str(f)).select("user", "at").coalesce(1).collect()]
        assert found == sorted(found)
        ranges.append((found[0], found[-1]))
    ranges.sort()
    assert len(ranges) > 2 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    assert sum(a[0] <= 7 <= b[0] for a, b in ranges) > 1  # the hot partition key has several files
