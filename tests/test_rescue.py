import tempfile

from sluice.operators.mapping import Field
from sluice.plans.entity import Entity
from sluice.sinks.tables import Store
from sluice.sources.scan import as_text
from sluice.streaming.stream import EntityStream, run_batches, table_stream


def test_stream_keeps_cells_and_null_keys_that_do_not_fit(spark):
    tmp = tempfile.mkdtemp(prefix="spark-")
    spark.createDataFrame([("1", "5"), ("2", "many"), ("x3", "7"), ("", "8")], "id string, qty string").coalesce(1).write.parquet(f"{tmp}/in")
    kinds, store = {"id": "integer", "qty": "integer"}, Store(spark, f"{tmp}/out")
    entity = Entity("stock", "relational", (Field("id", key=True), Field("qty")), order=("qty",))
    run_batches(as_text(table_stream(spark, f"{tmp}/in")), EntityStream(store, [entity], kinds), f"{tmp}/checkpoint")
    assert {(r.id, r.qty) for r in store.read("stock").collect()} == {(1, 5), (2, None)}
    got = {(r.id, r.qty, tuple(r._rescued.items())) for r in store.read("stock_rescued").collect()}
    assert got == {("2", "many", (("qty", "many"),)), ("x3", "7", (("id", "x3"),))}
