import json

import pytest
from pyspark.sql import functions as F

from sluice.operators.filters import Filter
from sluice.operators.mapping import Field, MappingError
from sluice.plans.entity import Binder, Edge, Entity, Reference, check_references, edge_rows, entities_from, relations_from, sample_kinds
from sluice.plans.reports import Metrics, empty_ones, medians, overhead, plan_counts
from sluice.sinks import files
from sluice.sinks.tables import MissingTarget, Store, preview, register_sink, write
from sluice.sources.scan import load_sources
from sluice.streaming.stream import EdgeStream, EntityStream, file_stream, rows_stored, run_batches


@pytest.fixture
def sources(spark, tmp_path):
    (tmp_path / "stock.csv").write_text("product_id,name,category_id,price,at\n1,a,7,1.5,2023-11-02 03:30:00Z\n2,b,7,x,2023-11-03T14:30:00-05:00\n2,b2,8,2,2023-11-04\n,c,9,1,\n")
    (tmp_path / "cart.csv").write_text("product_id,cart,qty\n1,k1,2\n2,k1,3\n")
    return load_sources(spark, {"stock": str(tmp_path / "stock.csv"), "cart": str(tmp_path / "cart.csv")})


CONFIG = {
    "relational": {"entities": {"products": {"source": "stock", "columns": {"product_id": {"is_key": True}, "name": {}, "price": {}}}}},
    "document": {"entities": {"catalog": {"source": "stock", "columns": {"name": {}, "category": {"category_id": {}, "info": {"at": {}}}}}}},
    "wide": {"entities": {"log": {"source": ["stock", "cart"], "columns": {"product_id": {}, "kind": {"csv_column": "_source"}, "qty": {}}, "partition": ["product_id"], "cluster": ["kind"]}}},
    "keyvalue": {"entities": {"carts": {"source": "cart", "mode": "hybrid", "columns": {"cart": {"is_key": True}}}}},
    "graph": {"entities": {"cart": {"columns": {"product_id": {"is_key": True}}, "filters": [{"column": "qty", "operator": ">", "value": 2}]}}},
}


def test_load_of_every_model(spark, sources):
    binder = Binder(sources)
    bound = {e.name: binder.bind(e) for e in entities_from(CONFIG)}
    assert bound["products"].kinds == {"product_id": "integer", "name": "string", "category_id": "integer", "price": "string", "at": "datetime", "_source": "string"}
    shaped = {n: b.shaped() for n, b in bound.items()}
    assert sorted(r.name for r in shaped["products"].collect()) == ["a", "b2"]
    assert shaped["catalog"].count() == 4 and shaped["catalog"].select("category.info.at").count() == 4
    assert {(r.product_id, r.kind) for r in shaped["log"].collect()} >= {(1, "stock"), (1, "cart"), (2, "stock")}
    assert {r.key: json.loads(r.value)["qty"] for r in shaped["carts"].collect()} == {"k1": 3}
    assert [r.product_id for r in shaped["cart"].collect()] == [2]
    assert {tuple(r._rescued.items()) for r in Binder(sources).bind(entities_from(CONFIG)[0], bound["products"].kinds | {"price": "float"}).lost().collect()} == {(("price", "x"),)}
    counts = plan_counts((b.entity.model, n, b.planned()) for n, b in bound.items())
    assert {r.entity: r.rows for r in counts.collect()} == {"products": 2, "catalog": 4, "log": 6, "carts": 2, "cart": 1}
    assert [r.entity for r in empty_ones(counts, ["log", "gone"]).collect()] == ["gone"]
    assert {(r.column, r.origin) for r in bound["carts"].listing().collect()} == {("product_id", "inferred"), ("cart", "manual"), ("qty", "inferred")}
    check_references([Reference("products", "catalog", "name")], bound)
    with pytest.raises(MappingError):
        check_references([Reference("products", "catalog", "zz")], bound)
    assert sample_kinds(sources["cart"].drop("_source")) == {"product_id": "integer", "cart": "string", "qty": "integer"}


def test_places_give_last_wins(spark, tmp_path):
    from sluice.sources.scan import read_text, tagged

    (tmp_path / "t.csv").write_text("id,v\n1,a\n2,b\n1,c\n")
    df = tagged(read_text(spark, str(tmp_path / "t.csv"), position=True), "t")
    out = Binder({"t": df}).bind(Entity("t", "relational", (Field("id", key=True), Field("v")))).shaped()
    assert sorted(map(tuple, out.drop("_partition").collect())) == [(1, "c"), (2, "b")]


@pytest.mark.parametrize(
    "e",
    [
        Entity("x", "relational", (Field("a"),)), Entity("stock", "relational", (Field("zz"),)), Entity("stock", "table", (Field("name"),)), Entity("stock", "keyvalue", (Field("name"),)),
        Entity("stock", "wide", (Field("name"),)), Entity("stock", "relational"), Entity("x", "document", (Field("a"),), ()),
    ],
)
def test_bad_entities(sources, e):
    with pytest.raises(MappingError):
        Binder(sources).bind(e)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_rules_of_repeated_loads(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    first = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    second = spark.createDataFrame([(2, "new"), (3, "c")], "k int, v string")
    want = {"relational": [(1, "a"), (2, "b"), (3, "c")], "document": [(1, "a"), (2, "b"), (2, "new"), (3, "c")]}
    for model in ("relational", "document", "keyvalue", "wide", "graph"):
        for load in (first, second):
            write(load, store, model, model, ["k"])
        assert rows(store.read(model)) == want.get(model, [(1, "a"), (2, "new"), (3, "c")])
    assert [r.k for r in store.ordered("wide").collect()] == [1, 2, 3]
    store.compact("wide")
    write(second.limit(1), store, "wide", "wide", ["k"])
    assert rows(store.read("wide")) == [(1, "a"), (2, "new"), (3, "c")]
    files.publish(spark, f"{tmp_path}/s/told", "{}")
    with pytest.raises(FileExistsError):
        files.publish(spark, f"{tmp_path}/s/told", "{}")
    store.clean("wide")
    with pytest.raises(MissingTarget):
        store.read("wide")
    with pytest.raises(MissingTarget):
        write(first, Store(spark, str(tmp_path / "t"), create=False), "x", "relational", ["k"])
    register_sink("own", lambda df, s, name, keys: s.replace(name, df))
    write(first, store, "mine", "own")
    assert store.read("mine").count() == 2
    assert preview(first)[1] == 2 and preview(first, 1) == ([], 2)


def test_partitions_are_folders(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), rows_per_file=10)
    store.replace("t", spark.range(100).withColumn("_partition", F.concat(F.lit("p"), F.col("id") % 3)))
    assert store.read("t").where("_partition = 'p1'").count() == 33
    assert len(list((tmp_path / "s/t").glob("load=*/*/_partition=p1/*.parquet"))) >= 4


@pytest.mark.parametrize("model", ["relational", "document", "keyvalue", "graph"])
def test_stream_gives_what_one_batch_gives(spark, tmp_path, model):
    data = spark.createDataFrame([(str(i), str(i % 7), "" if i % 5 == 0 else f"v{i % 11}", "north" if i % 2 else "south") for i in range(200)], "n string, k string, v string, region string")
    for low in range(0, 200, 50):  # files arrive one after the other
        data.where(f"int(n) between {low} and {low + 49}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    kinds = {"n": "integer", "k": "integer", "v": "string", "region": "string"}
    e = Entity("t", model, (Field("k", key=True), Field("n"), Field("v")), filters=(Filter("v", "!=", "v3"), Filter("region", "each")), order=("n",))
    once, parts = Store(spark, str(tmp_path / "a")), Store(spark, str(tmp_path / "b"))
    run_batches(file_stream(spark, str(tmp_path / "in"), data.schema, 100), EntityStream(once, [e], kinds), str(tmp_path / "ca"))
    loader = EntityStream(parts, [e], kinds)
    run_batches(file_stream(spark, str(tmp_path / "in"), data.schema, 1), loader, str(tmp_path / "cb"))
    got = parts.read("t")
    assert rows(got) == rows(once.read("t").select(*got.columns)) and rows_stored(loader) == {"t": got.count()}


def test_stored_relational_rows_stay_through_a_later_stream(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    e = Entity("t", "relational", (Field("k", key=True), Field("n")), order=("n",))
    kinds = {"n": "integer", "k": "integer"}
    for k, values in enumerate(([("1", "1"), ("1", "2")], [("1", "9"), ("2", "3")])):
        spark.createDataFrame(values, "k string, n string").write.parquet(str(tmp_path / f"in{k}"))
        run_batches(file_stream(spark, str(tmp_path / f"in{k}"), "k string, n string"), EntityStream(store, [e], kinds), str(tmp_path / f"c{k}"))
    assert rows(store.read("t").select("k", "n")) == [(1, 2), (2, 3)]


def test_metrics_and_reports(spark):
    metrics = Metrics()
    assert metrics.measured("relational", "t", "write", spark.range(5), lambda df: df.write.format("noop").mode("overwrite").save()) == 5
    assert metrics.frame(spark).first().rows == 5
    runs = spark.createDataFrame(
        [("a", "write", r, s, p, 10) for r, s, p in ((1, 1.0, None), (2, 3.0, 5.0), (3, 2.0, 7.0))] + [("a", "filter", 1, 9.0, 9.0, 1)],
        "size string, phase string, rep int, seconds double, peak double, rows long",
    )
    assert rows(medians(runs, ["size", "phase"])) == [("a", "write", 2.0, 6.0, 10, 5.0)]
    other = runs.where("size = 'b'")
    assert rows(overhead(runs, other, ["size"], "rep")) == [("a", 2.0, None, None)]
    assert overhead(runs, runs, ["size"], "rep").first().overhead_pct == 0


GRAPH = {
    "graph": {
        "entities": {
            "people": {"columns": {"person_id": {"is_key": True}}},
            "things": {"columns": {"thing_id": {"is_key": True}, "label": {}}},
        },
        "relationships": {"owns": {"from": "people", "to": "things", "type": "OWNS", "columns": {"weight": {}}}},
    },
    "relational": {"relationships": {"r": {"from": "a", "to": "b", "foreign_key": "k"}}},
}


def test_graph_as_batch_and_as_stream(spark, tmp_path):
    people = spark.createDataFrame([("p1", "t1", "1"), ("p2", "t9", "2"), ("p1", "t1", "3"), ("p3", "", "4")], "person_id string, thing_id string, weight string")
    things = spark.createDataFrame([("t1", "x"), ("t2", "y")], "thing_id string, label string")
    references, (owns,) = relations_from(GRAPH)
    assert references == [Reference("a", "b", "k", None, "r")] and owns == Edge("OWNS", "people", "things", (Field("weight", "weight", False, None, "weight"),))
    from dataclasses import replace

    binder = Binder({"people": people, "things": things})
    entities = {e.name: replace(e, order=("weight",) if e.name == "people" else ("label",)) for e in entities_from(GRAPH)}
    bound = {n: binder.bind(e) for n, e in entities.items()}
    want = [("p1", "t1", "OWNS", 3)]
    assert rows(edge_rows(owns, bound)) == want
    with pytest.raises(MappingError):
        edge_rows(replace(owns, end="gone"), bound)

    store = Store(spark, str(tmp_path / "s"))
    for name, df in (("people", people), ("things", things)):
        df.write.parquet(str(tmp_path / name))
        run_batches(file_stream(spark, str(tmp_path / name), df.schema), EntityStream(store, [entities[name]], bound[name].kinds), str(tmp_path / f"c-{name}"))
    load = EdgeStream(store, "OWNS", ("person_id", "thing_id"), (("people", "person_id"), ("things", "thing_id")), bound["people"].kinds, owns.properties, ["weight"])
    run_batches(file_stream(spark, str(tmp_path / "people"), people.schema, 100), load, str(tmp_path / "c-owns"))
    assert rows(store.read("OWNS")) == want
