import json

import pytest
from pyspark.sql import functions as F

from sluice.operators import dedupe, mapping, relate, shapes
from sluice.operators.filters import Filter, FilterError, apply_filters, partitioned, split_each
from sluice.operators.mapping import Field, MappingError, Nested


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def values(spark):
    return spark.createDataFrame([(1, "a", True, 1.5), (2, "b", False, 2.5), (3, "", None, None), (None, None, True, 1.5)], "i long, s string, b boolean, f double")


KINDS = {"i": "integer", "s": "string", "b": "boolean", "f": "float"}


@pytest.mark.parametrize(
    ("f", "left"),
    [
        (Filter("i", "==", "2"), [2]), (Filter("i", "!=", 2), [1, 3, None]), (Filter("s", "!=", "a"), [2, 3, None]), (Filter("i", ">=", 2), [2, 3]), (Filter("s", "<", "b"), [1]),
        (Filter("i", "in", ["1", 3]), [1, 3]), (Filter("s", "not_in", ["a"]), [2, 3, None]), (Filter("i", "not_in", []), [1, 2, 3, None]), (Filter("i", "in", []), []),
        (Filter("b", "==", "true"), [1, None]), (Filter("b", "==", True), [1, None]), (Filter("f", "==", 1.5), [1, None]), (Filter("i", "==", "x"), []),
    ],
)
def test_filter(values, f, left):
    assert sorted((r.i for r in apply_filters(values, [f], KINDS).collect()), key=repr) == sorted(left, key=repr)


@pytest.mark.parametrize("bad", [[Filter("zz", "==", 1)], [Filter("i", "~", 1)], [Filter("i", "in", 1)], [Filter("i", ">", "x")], [Filter("i", ">")], [Filter("s", "each"), Filter("i", "each")]])
def test_bad_filters(values, bad):
    with pytest.raises(FilterError):
        apply_filters(values, bad, KINDS)


def test_filter_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "i long, s string").write.parquet(str(tmp_path / "t"))
    df = apply_filters(spark.read.parquet(str(tmp_path / "t")), [Filter("i", ">", 0)], KINDS)
    assert "GreaterThan" in df._jdf.queryExecution().executedPlan().toString()


def test_split(spark):
    df = spark.createDataFrame([("SC",), ("RS",), ("SC",), ("",), (None,), ("a b",), ("a_b",)], "state string")
    parts = {r[0]: r[1] for r in split_each(df, "state", "orders").groupBy("_partition").count().collect()}
    assert parts == {"orders_SC": 2, "orders_RS": 1, "orders_a_b": 2}
    assert {r._partition for r in split_each(df, "state", "orders", "x").collect()} == {"orders_x"}
    assert {r._partition for r in partitioned(df, [], "base").collect()} == {"base"}


def test_column_selector():
    header = ["a", "b", "c", "d"]
    assert mapping.select_columns(["d", "1-2", 2, "b"], header) == ["a", "b", "d"]
    for bad in (["0"], ["2-9"], ["3-2"], ["zz"]):
        with pytest.raises(MappingError):
            mapping.select_columns(bad, header)


def test_mapping_modes(spark):
    df = spark.createDataFrame([("1", "x", "y", "src")], "id string, a string, b string, _source string")
    given = mapping.fields_from({"id": {"is_key": True, "schema_column": "key"}, "extra": {"csv_column": 2}, "origin": {"csv_column": 4}})
    names = lambda mode, only=None: [f.name for f in mapping.expand(given, df.columns, mode, only)]
    assert names("manual") == ["key", "extra", "origin"]
    assert names("hybrid") == ["key", "a", "b", "extra", "origin"]
    assert names("hybrid", ["1-2"]) == ["key", "a", "extra", "origin"]
    assert [f.name for f in mapping.expand((), df.columns, "auto", ["b"])] == ["b"]
    with pytest.raises(MappingError):
        mapping.expand(given, df.columns, "manual", ["a"])
    out = mapping.project(df, given)
    assert rows(out) == [("1", "x", "src")]
    with pytest.raises(MappingError):
        mapping.project(df, (Field("z", 9),))
    with pytest.raises(MappingError):
        mapping.project(df, (Field("z", "a"), Field("z", "b")))
    assert [c for c in mapping.nan_as_null(spark.createDataFrame([(float("nan"),)], "f double")).first()] == [None]
    assert mapping.keys_first(["a", "b", "c"], ["c"], ["b"]) == ["c", "b", "a"]


def test_dedupe(spark):
    df = spark.createDataFrame([(1, "k", None), (2, "k", "x"), (3, "", "y"), (4, None, "z"), (5, "k", None), (6, "l", "q")], "pos int, key string, v string")
    assert rows(dedupe.dedupe(df, ["key"], ["pos"])) == rows(df.where("pos in (5, 6)"))
    assert rows(dedupe.dedupe(df, ["key"], ["pos"], keep="first", drop_blank=False)) == rows(df.where("pos in (1, 3, 6)"))
    with_map = df.withColumn("m", F.create_map(F.lit("a"), F.col("v")))
    assert sorted(r.pos for r in dedupe.dedupe(with_map, ["key"], ["pos"]).collect()) == [5, 6]
    assert dedupe.skipped_duplicates(df, ["key"]).first().skipped == 2
    assert dedupe.dedupe(df.limit(0), ["key"], ["pos"]).count() == 0
    assert rows(dedupe.repeated_keys(df, ["key"])) == [("k", 3)]


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", "p"), (2, "b", "q")], "k int, v string, w string")
    new = spark.createDataFrame([(2, None, "new"), (3, "c", "new")], "k int, v string, u string")
    assert rows(dedupe.merge_properties(old, new, ["k"])) == [(1, "a", "p", None), (2, None, "q", "new"), (3, "c", None, "new")]
    same = new.select("k", "v", F.col("u").alias("w"))
    assert rows(dedupe.insert_if_absent(same, old, ["k"])) == [(1, "a", "p"), (2, "b", "q"), (3, "c", "new")]
    assert rows(dedupe.upsert(old, same, ["k"])) == [(1, "a", "p"), (2, None, "new"), (3, "c", "new")]


def test_shapes(spark):
    df = spark.createDataFrame([("1", "n1", "c", 0), ("1", "n2", "c", 1), ("", "n3", "d", 2), (None, "n4", "d", 3)], "id string, name string, cat string, _pos int")
    fields = (Field("id", key=True), Field("name"), Field("cat"), Field("cat2", "cat"))
    assert rows(shapes.to_relational(df, fields)) == [("1", "n2", "c", "c")]
    assert shapes.to_relational(df, (Field("name"),)).count() == 4
    docs = shapes.to_documents(df, (Field("id"), Nested("category", (Field("cat"), Nested("deep", (Field("name"),))))))
    assert docs.count() == 4 and docs.select("category.deep.name").count() == 4
    pairs = {r.key: json.loads(r.value) for r in shapes.to_keyvalue(df, fields[:3]).collect()}
    assert pairs == {"1": {"name": "n2", "cat": "c"}, "": {"name": "n3", "cat": "d"}}
    assert rows(shapes.to_nodes(df, fields[:2])) == [("", "n3"), ("1", "n1")]
    wide = shapes.to_wide(df, (Field("name"), Field("id", type="TEXT"), Field("cat")), ["cat"], ["id"])
    assert wide.columns == ["cat", "id", "name"] and wide.count() == 2
    for bad in (lambda: shapes.to_keyvalue(df, fields[1:]), lambda: shapes.to_wide(df, fields, []), lambda: shapes.to_nodes(df, (Nested("x", fields),))):
        with pytest.raises(MappingError):
            bad()


def test_edges_and_references(spark):
    people = spark.createDataFrame([("p1",), ("p2",)], "id string")
    things = spark.createDataFrame([("t1", "x")], "id string, label string")
    links = spark.createDataFrame([("p1", "t1", "o1", 1, 0), ("p1", "t1", "o1", 2, 1), ("p1", "t1", "o2", 3, 2), ("p9", "t1", "o3", 1, 3), (None, "t1", "o4", 1, 4), ("p2", "t9", "o5", 1, 5)], "a string, b string, no string, w int, _pos int")
    edges = shapes.to_edges(links, "a", "b", "BUYS IT", people, "id", things, "id", (Field("no", key=True), Field("w")))
    assert rows(edges) == [("p1", "t1", "BUYS_IT", "o1", 2), ("p1", "t1", "BUYS_IT", "o2", 3)]
    assert rows(relate.graph_rows(edges, people, "id", things, "id").select("from.id", "rel.no", "to.label")) == [("p1", "o1", "x"), ("p1", "o2", "x")]
    assert sorted(r.no for r in relate.orphans(links, "a", people, "id").collect()) == ["o3"]
    with pytest.raises(relate.DanglingReference):
        relate.check_reference(links, "a", people, "id")
    relate.check_reference(links.where("a <> 'p9'"), "a", people, "id")
