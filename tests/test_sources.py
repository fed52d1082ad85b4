import pytest
from pyspark.sql import functions as F

from sluice.sources import scan
from sluice.sources.generate import SHARES, generate, split_rows


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "stock.csv").write_text('﻿id,street,price\n1,"Main, 5",1.5\n2,"say ""hi""",\n', encoding="utf-8")
    (tmp_path / "cart.csv").write_text("id,qty\n7,1\n")
    (tmp_path / "all.csv").write_text("action,id,qty\nstock,1,\ncart,7,1\nstock,2,\n")
    (tmp_path / "bad.csv").write_text("action,id\n ,1\n")
    (tmp_path / "twice.csv").write_text("id,id\n1,2\n")
    return tmp_path


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_text_scan_keeps_blanks_quotes_and_drops_the_mark(spark, folder):
    df = scan.read_text(spark, str(folder / "stock.csv"))
    assert df.columns == ["id", "street", "price"]
    assert rows(df) == [("1", "Main, 5", "1.5"), ("2", 'say "hi"', "")]
    with pytest.raises(scan.SourceError):
        scan.read_text(spark, str(folder / "twice.csv"))


def test_position_orders_rows(spark, folder):
    df = scan.read_text(spark, str(folder / "all.csv"), position=True)
    assert [r.id for r in df.orderBy("_pos").collect()] == ["1", "7", "2"]


def test_combined_file_equals_files_of_its_own(spark, folder):
    whole = scan.load_sources(spark, {"log": {"file": str(folder / "all.csv"), "origin_column": True}})
    assert sorted(whole) == ["cart", "log", "stock"]
    assert rows(whole["cart"]) == [("7", "1", "cart")] and whole["log"].count() == 3
    own = scan.load_sources(spark, {"cart": str(folder / "cart.csv")})
    assert own["cart"].exceptAll(whole["cart"]).isEmpty() and whole["cart"].exceptAll(own["cart"]).isEmpty()
    assert {r._source: r.rows for r in scan.origin_counts(whole["log"]).collect()} == {"stock": 2, "cart": 1}
    assert [r._source for r in scan.missing_origins(whole["log"], ["stock", "gone"]).collect()] == ["gone"]


def test_bad_declarations(spark, folder):
    for declared, overrides in (
        ({"log": {"file": str(folder / "bad.csv"), "origin_column": True}}, None),
        ({"stock": str(folder / "stock.csv"), "log": {"file": str(folder / "all.csv"), "origin_column": True}}, None),
        ({"stock": str(folder / "stock.csv")}, {"other": "x.csv"}),
    ):
        with pytest.raises(scan.SourceError):
            scan.load_sources(spark, declared, overrides)
    with pytest.raises(scan.SourceError):
        scan.combined(spark.createDataFrame([("a",)], "action string"))
    with pytest.raises(scan.SourceError):
        scan.union_sources([])


def test_override_and_formats(spark, folder):
    over = scan.load_sources(spark, {"stock": str(folder / "stock.csv")}, {"stock": str(folder / "cart.csv")})
    assert over["stock"].columns == ["id", "qty", "_source"]
    spark.createDataFrame([(1, None)], "a int, b string").write.parquet(str(folder / "t.parquet"))
    assert rows(scan.read_any(spark, str(folder / "t.parquet"))) == [("1", "")]


def test_union_fills_the_superset(spark):
    a = scan.tagged(spark.createDataFrame([("1", "2")], "product_id string, price string"), "stock")
    b = scan.tagged(spark.createDataFrame([("9", "1")], "order string, product_id string"), "purchase")
    both = scan.union_sources([a, b])
    assert both.columns == ["product_id", "price", "order", "_source"]
    assert rows(both) == [("1", "", "9", "purchase"), ("1", "2", "", "stock")]


def test_sample_per_source_finds_late_origins(spark):
    df = spark.createDataFrame([(i, "a" if i < 90 else "b") for i in range(100)], "n int, _source string")
    assert {r._source: r["count"] for r in scan.sample_per_source(df, 8, "n").groupBy("_source").count().collect()} == {"a": 8, "b": 8}


def test_samples_in_file_order_shuffle_few_rows(spark, tmp_path):
    for k, (name, origins) in enumerate((("b", "xy"), ("a", "y"), ("c", "xz"))):  # files, in another order than the names'
        (tmp_path / f"{name}.csv").write_text("n,_source\n" + "".join(f"{k}{i:05},{origins[i % len(origins)]}\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        df = scan.with_places(scan.read_text(spark, str(tmp_path)))
        assert df.rdd.getNumPartitions() > 5
        every = df.collect()
        for n in (1, 7, 1000, 2500, 9000):
            want = [r.n for o in "xyz" for r in sorted((r for r in every if r._source == o), key=lambda r: r._pos)[:n]]
            assert sorted(r.n for r in scan.sample_per_source(df, n, scan.POSITION).collect()) == sorted(want)
            assert scan._first_runs(df, n).groupBy("_source").count().where(F.col("count") > 2 * n).isEmpty()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_generated_tables(spark):
    for total in (10, 1000):
        sizes = split_rows(total, 3)
        assert sum(sizes.values()) == total and sizes == split_rows(total, 3)
    tables = generate(spark, 1000, 3)
    assert set(tables) == set(SHARES) and sum(t.count() for t in tables.values()) == 1000
    stock = tables["stock"].select("product_id")
    for name, key in (("purchase", "product_id"), ("select_product", "selected_product_id"), ("add_to_cart", "cart_product_id")):
        assert tables[name].join(stock, tables[name][key] == stock.product_id, "left_anti").isEmpty()
    assert rows(tables["purchase"]) == rows(generate(spark, 1000, 3)["purchase"]) != rows(generate(spark, 1000, 4)["purchase"])
