"""Streams against one batch over all rows: order, replays, restarts."""

import pytest
from pyspark.sql import functions as F

from sluice.operators.mapping import Field
from sluice.plans.entity import Entity
from sluice.sinks.tables import Store
from sluice.streaming.stream import EntityStream, first_wins, last_wins

KINDS = {"k": "integer", "n": "integer"}
WINS = {"relational": 3, "keyvalue": 3, "wide": 3, "graph": 1}


def entity(model):
    return Entity("t", model, (Field("k", key=True), Field("n")), partition=("k",) if model == "wide" else (), order=("n",))


def batch(spark, *values):
    return spark.createDataFrame([("1", str(n)) for n in values], "k string, n string")


def stored(store):
    rows = store.read("t")
    return [r[0] for r in rows.select(F.get_json_object("value", "$.n").cast("int") if "value" in rows.columns else "n").collect()]


@pytest.mark.parametrize("model", sorted(WINS))
@pytest.mark.parametrize("compacted", [False, True])
def test_declared_order_holds_over_batches_that_come_in_any_order(spark, tmp_path, model, compacted):
    store = Store(spark, str(tmp_path))
    load = EntityStream(store, [entity(model)], KINDS)
    for k, values in enumerate([(2,), (3, 1), (2,)]):
        load(batch(spark, *values), k)
        if compacted:
            store.compact("t")
    assert stored(store) == [WINS[model]]


@pytest.mark.parametrize("model", ["document", *sorted(WINS)])
def test_a_batch_that_runs_again_is_stored_once_even_after_a_restart(spark, tmp_path, model):
    store, load = Store(spark, str(tmp_path)), EntityStream(Store(spark, str(tmp_path)), [entity(model)], KINDS)
    load(batch(spark, 1, 3), 0)
    again = EntityStream(store, [entity(model)], KINDS)
    again.load = load.load
    again(batch(spark, 1, 3), 0)
    again(batch(spark, 2), 1)
    assert sorted(stored(store)) == ([1, 2, 3] if model == "document" else [WINS[model]])


def test_rows_stored_before_the_load_stay_and_later_rows_of_a_resumed_load_win(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    EntityStream(store, [entity("relational")], KINDS)(spark.createDataFrame([("2", "5")], "k string, n string"), 0)
    first = EntityStream(store, [entity("relational")], KINDS)
    first(spark.createDataFrame([("2", "9"), ("1", "1")], "k string, n string"), 0)
    resumed = EntityStream(store, [entity("relational")], KINDS)
    resumed.load = first.load
    resumed(batch(spark, 2), 1)
    assert sorted((r.k, r.n) for r in store.read("t").collect()) == [(1, 2), (2, 5)]


def test_without_a_declared_order_arrival_counts(spark, tmp_path):
    load = EntityStream(Store(spark, str(tmp_path)), [Entity("t", "relational", (Field("k", key=True), Field("n")))], KINDS)
    for k, n in enumerate((3, 1)):
        load(batch(spark, n), k)
    assert stored(load.store) == [1]


@pytest.mark.parametrize(("rule", "want"), [(first_wins, 1), (last_wins, 3)])
def test_keyed_rules_over_batches(spark, tmp_path, rule, want):
    store = Store(spark, str(tmp_path))
    for k, values in enumerate([(2,), (3, 1), (2,), (2,)]):
        rule(store, "t", batch(spark, *values), ["k"], ["n"], min(k, 2))
    assert [int(r.n) for r in store.read("t").collect()] == [want]
    assert store.read("t").columns == ["k", "n"]


def test_a_read_of_batches_sorts_after_its_shuffle_only(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for b in (0, 1):
        rows = spark.range(6).selectExpr("id k", "'p' _partition", f"struct(struct({b} batch, id row) o0) _place", f"{b} v")
        store.store("t", rows.where(f"k < {3 + 3 * b}"), ["_partition", "k"], "upsert", "a", b)
    found = store.read("t")
    below = found._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning")
    assert len(below) == 2 and "Aggregate" in below[0] and "Aggregate" not in below[1] and "Sort" not in below[1]
    assert sorted((r.k, r.v) for r in found.collect()) == [(k, 1) for k in range(6)]
