import tempfile

import pytest
from pyspark.sql import functions as F

from sluice.llm import shards as S
from tests.conftest import SF

SCHEMA = "doc_id long, text string, run string, path string"


@pytest.fixture
def store(spark):
    return S.ShardStore(spark, tempfile.mkdtemp(prefix="spark-") + "/store", target=200_000, fanout=3, smallest=1000)


def test_versions_keep_all_rows(spark, store):
    rows = [(i, None if i % 5 == 0 else f"t{i} " * (i % 50), "r", None) for i in range(400)] + [(1, "x" * 300_000, "r", "p"), (None, "", None, None), (None, "", None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for k in range(4):
        assert store.append(docs.repartition(5)) == k + 1
    before = store.manifest().count()
    version = store.compact(docs.schema)
    assert version > 4 and store.manifest().count() < before
    expected = sorted(map(repr, docs.union(docs).union(docs).union(docs).collect()))
    for v in (4, version):
        assert sorted(map(repr, store.read(v, docs.schema).drop("shard").collect())) == expected
    assert store.plan(store.manifest()).count() == 0 and store.compact(docs.schema) == version
    assert sum(r.rows for r in store.manifest().collect()) == len(expected)
    assert store.vacuum() > 0 and store.versions() == [version]
    assert sorted(map(repr, store.read(schema=docs.schema).drop("shard").collect())) == expected


def test_second_writer_of_a_version_fails(spark, store):
    docs = spark.createDataFrame([(1, "a", "b", "c")], SCHEMA)
    store.append(docs)
    with pytest.raises(S.Conflict):
        store.commit(store.manifest(), 0)
    assert store.version() == 1 and store.read(schema=docs.schema).count() == 1


def test_limit_of_a_round(spark, store, monkeypatch):
    monkeypatch.setattr(S, "ROUND", 4)
    docs = spark.createDataFrame([(i, "a", "b", "c") for i in range(60)], SCHEMA)
    store.append(docs.repartition(20))
    store.compact(docs.schema)
    assert store.read(schema=docs.schema).count() == 60


def test_columns_named_like_ours(spark, store):
    docs = spark.createDataFrame([(k, "a", "b", "c") for k in range(40)], "_run int, shard string, run string, row string")
    store.append(docs.repartition(8))
    store.compact(docs.schema)
    rows = store.read(schema=docs.schema)
    assert rows.columns == [*docs.columns, "_shard"] and sorted(r._run for r in rows.collect()) == list(range(40))


def test_each_run_is_one_shard(spark):
    store = S.ShardStore(spark, tempfile.mkdtemp(prefix="spark-") + "/store", target=40_000, fanout=3, smallest=1000)
    docs = spark.range(30_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"))
    store.append(docs.repartition(100))
    runs = store.plan(store.manifest()).select("run").distinct().count()
    before = store.manifest().select("path")
    store.compact_round(docs.schema)
    made = store.manifest().join(before, "path", "left_anti").collect()
    assert runs > 5 and len(made) == runs and max(r.bytes for r in made) < 4 * 40_000
    assert store.read(schema=docs.schema).count() == 30_000


def test_empty(spark, store):
    docs = spark.createDataFrame([], SCHEMA)
    assert store.version() == 0 and store.compact(docs.schema) == 0
    store.append(docs)
    assert store.read(schema=docs.schema).count() == 0


def test_query(spark):
    import hashlib

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_bytes, r.text_sha256) for r in S.op8_size_tiered_shards(spark, SF).collect()}
    assert got == {i: (len(t.encode()), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts.items()}


@pytest.mark.parametrize(("mb", "least"), [(50, 90), (60, 90), (43, 90), (20, 90), (64, 0), (5, 90)])
def test_shards_just_below_a_finished_one_are_merged(spark, mb, least):
    store = S.ShardStore(spark, tempfile.mkdtemp(prefix="spark-") + "/store")
    entries = spark.createDataFrame([(f"p{k}", mb << 20, 1, 1) for k in range(100)], S.ENTRY)
    planned = store.plan(entries)
    assert planned.count() >= least and (least or planned.isEmpty())
    sizes = [r["count"] * mb for r in planned.groupBy("run").count().collect()]
    assert all(64 <= s < 192 for s in sizes) or mb == 5


def test_a_refused_version_leaves_nothing_behind(spark, store, monkeypatch):
    docs = spark.createDataFrame([(k, "a", "b", "c") for k in range(40)], SCHEMA)
    store.append(docs.repartition(4))
    root = store.root
    files = lambda: sorted(p for p in __import__("pathlib").Path(root).rglob("*.parquet"))
    before = files()
    monkeypatch.setattr(store, "version", lambda: 0)  # a writer that does not know of version 1
    with pytest.raises(S.Conflict):
        store.append(docs)
    monkeypatch.undo()
    assert files() == before and store.version() == 1
