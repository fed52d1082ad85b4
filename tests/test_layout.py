"""How stored rows lie on disk, and how pairs are read back."""

from pyspark.sql import functions as F

from sluice.operators import shapes
from sluice.sinks.tables import Store


def test_order_report_counts_what_is_out_of_order(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    rows = [(p, k, v) for p in ("a", "b") for k in range(40) for v in range(3)]
    df = spark.createDataFrame(rows, "_partition string, k int, v int").repartition(4)
    kept = store.store("sorted", df, ["k", "v"], order=["_partition", "k", "v"])
    assert sorted(map(tuple, store.order_report(kept, ["k", "v"]).collect())) == [("a", 120, 0, 0), ("b", 120, 0, 0)]
    found = spark.createDataFrame([(k,) for k in (3, 1, 2, 0)], "k int").coalesce(1)
    (one,) = store.order_report(store.store("plain", found), ["k"]).collect()
    assert tuple(one) == ("plain", 4, 2, 0)
    mixed = spark.range(100).repartition(2).select(F.col("id").alias("k")).sortWithinPartitions("k")
    (two,) = store.order_report(store.store("mixed", mixed), ["k"]).collect()
    assert tuple(two) == ("mixed", 100, 0, 1)


def test_order_report_takes_nulls_first(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    rows = spark.createDataFrame([(None,), (1,), (None,)], "k int").coalesce(1)
    (one,) = store.order_report(store.store("t", rows), ["k"]).collect()
    assert tuple(one) == ("t", 3, 1, 0)


def test_pairs_are_read_back(spark):
    rows = spark.createDataFrame([("a", '{"x": 1, "y": null}'), ("b", "{}"), ("c", None), ("d", "no object")], "key string, value string")
    got = {r.key: (r.x, r.y) for r in shapes.from_keyvalue(rows, "x long, y string").collect()}
    assert got == {"a": (1, None), "b": (None, None), "c": (None, None), "d": (None, None)}
