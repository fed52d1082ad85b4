import pytest

from sluice.operators.mapping import Field, MappingError
from sluice.plans.entity import Binder, Entity
from sluice.run import chosen_models, run_batch, run_stream
from sluice.sinks.tables import Store
from sluice.sources.scan import SourceError, load_sources, tagged

CONFIG = {
    "relational": {
        "entities": {
            "products": {"source": "stock", "columns": {"id": {"is_key": True}, "name": {}, "price": {}}},
            "lines": {"source": "sale", "columns": {"line": {"is_key": True}, "id": {}}},
        },
        "relationships": {"of": {"from": "lines", "to": "products", "foreign_key": "id"}},
    },
    "document": {"entities": {"catalog": {"source": "stock", "columns": {"name": {}, "info": {"price": {}}}}}},
    "keyvalue": {"entities": {"latest": {"source": "sale", "mode": "hybrid", "columns": {"id": {"is_key": True}}}}},
    "wide": {"entities": {"log": {"source": ["stock", "sale"], "columns": {"id": {}, "kind": {"csv_column": "_source"}, "qty": {}}, "partition": ["id"], "cluster": ["kind"]}}},
    "graph": {
        "entities": {
            "product": {"source": "stock", "columns": {"id": {"is_key": True}, "name": {}}},
            "line": {"source": "sale", "columns": {"line": {"is_key": True}}, "filters": [{"column": "qty", "operator": "!=", "value": 9}]},
        },
        "relationships": {"sold": {"from": "line", "to": "product", "type": "SOLD AS", "columns": {"qty": {}}}},
    },
}


@pytest.fixture
def config(tmp_path):
    (tmp_path / "stock.csv").write_text("id,name,price\n1,a,1.5\n2,b,2\n2,b2,\n,c,3\n")
    (tmp_path / "all.csv").write_text("origin,line,id,qty\nsale,10,1,5\nsale,11,2,9\nback,12,2,1\nsale,13,7,2\nsale,10,2,6\n")
    return {"sources": {"stock": str(tmp_path / "stock.csv"), "shop": {"file": str(tmp_path / "all.csv"), "origin_column": True}}} | CONFIG


TARGETS = [("relational", "products"), ("relational", "lines"), ("document", "catalog"), ("keyvalue", "latest"), ("wide", "log"), ("graph", "product"), ("graph", "line"), ("graph", "SOLD_AS")]


def stored(spark, root):
    out = {}
    for model, name in TARGETS:
        df = Store(spark, f"{root}/{model}").read(name)
        out[name] = sorted(repr(r.asDict(True)) for r in df.select(*sorted(df.columns)).collect())
    return out


def test_batch_and_stream_store_the_same(spark, config, tmp_path):
    counts = run_batch(spark, config, str(tmp_path / "b"))
    found = stored(spark, tmp_path / "b")
    assert {(r.entity, r.rows) for r in counts.collect()} == {("products", 2), ("lines", 3), ("catalog", 4), ("latest", 3), ("log", 5), ("product", 2), ("line", 2), ("SOLD AS", 2)}
    products = {(r.id, r["name"], r.price) for r in Store(spark, f"{tmp_path}/b/relational").read("products").collect()}
    assert products == {(1, "a", 1.5), (2, "b2", None)}
    assert {(r.line, r.id) for r in Store(spark, f"{tmp_path}/b/relational").read("lines").collect()} == {(10, 2), (11, 2), (13, 7)}
    assert [(r.src, r.dst, r.type, r.qty) for r in Store(spark, f"{tmp_path}/b/graph").read("SOLD_AS").collect() if r.dst == 1] == [(10, 1, "SOLD_AS", 5)]
    streamed = run_stream(spark, config, str(tmp_path / "s"), str(tmp_path / "c"))
    assert stored(spark, tmp_path / "s") == found
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, counts.collect()))
    again = run_stream(spark, config, str(tmp_path / "s"), str(tmp_path / "c"))  # nothing new has come
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, counts.collect()))


def test_chosen_targets_and_dry_run(spark, config, tmp_path):
    assert chosen_models(config, [" Graph ", "document", ""]) == ["document", "graph"]
    plan = run_batch(spark, config, str(tmp_path / "d"), dry_run=True, only=["relational"])
    assert {(r.target, r.entity, r.partition, r.rows) for r in plan.collect()} == {("relational", "products", "products", 2), ("relational", "lines", "lines", 3)}
    assert not (tmp_path / "d").exists()
    run_batch(spark, config, str(tmp_path / "d"), only=["document"])
    assert sorted(p.name for p in (tmp_path / "d").iterdir()) == ["document"]


def test_a_wrong_configuration_stores_nothing(spark, config, tmp_path):
    wrong = config | {"relational": {"entities": CONFIG["relational"]["entities"], "relationships": {"of": {"from": "lines", "to": "products", "foreign_key": "none"}}}}
    with pytest.raises(MappingError):
        run_batch(spark, wrong, str(tmp_path / "w"))
    with pytest.raises(SourceError):
        run_stream(spark, config, str(tmp_path / "w"), str(tmp_path / "c"), overrides={"gone": "x.csv"})
    assert not (tmp_path / "w").exists()


def test_cells_that_do_not_fit_are_kept_beside_the_target(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,at\n" + "".join(f"{k},2024-01-0{k}\n" for k in range(1, 8)) + "8,soon\n")
    config = {"sources": {"t": str(tmp_path / "t.csv")}, "relational": {"entities": {"t": {"columns": {"id": {"is_key": True}, "at": {}}}}}}
    run_batch(spark, config, str(tmp_path / "o"))
    store = Store(spark, f"{tmp_path}/o/relational")
    assert store.read("t").where("at is null").count() == 1
    assert [tuple(r._rescued.items()) for r in store.read("t_rescued").collect()] == [(("at", "soon"),)]


def test_integers_beyond_64_bits_are_kept_as_numbers(spark):
    rows = spark.createDataFrame([("1", "5"), ("2", "123456789012345678901234"), ("3", "-9223372036854775808")], "id string, n string")
    bound = Binder({"t": tagged(rows, "t")}).bind(Entity("t", "relational", (Field("id", key=True), Field("n")), order=("id",)))
    assert bound.kinds["n"] == "integer" and bound.lost().isEmpty()
    assert {int(r.n) for r in bound.shaped().collect()} == {5, 123456789012345678901234, -9223372036854775808}
    assert dict(bound.shaped().dtypes)["n"] == "decimal(38,0)" and dict(bound.shaped().dtypes)["id"] == "bigint"
