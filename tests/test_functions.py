import pytest
from pyspark.sql import functions as F

from sluice.functions import casts, kinds, text


def frame(spark, **columns):
    names = list(columns)
    return spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{n} string" for n in names))


@pytest.mark.parametrize(
    ("values", "kind"),
    [
        (["", ""], "empty"), ([None, ""], "empty"), (["true", "FALSE", ""], "boolean"), (["true", "yes"], "string"), (["1", "-2", ""], "integer"), (["1.0", "1e3"], "integer"),
        (["1.5", "2"], "float"), (["inf", "1"], "float"), (["nan", "1"], "string"), (["1", "1000"], "integer"), (["1d", "2"], "string"),
        (["2023-11-02 03:30:00Z", "2023-11-03T14:30:00-05:00"], "datetime"), (["2023-11-02", "2024-01-01"], "datetime"), (["01/11/2023", "25/12/2023"], "datetime"), (["Nov 1 2023", "Dec 2 2023"], "datetime"),
        (["junk"] * 8 + ["2023-01-01"] * 2, "string"), (["2023-01-01"] * 9 + ["junk"], "datetime"), (["2023-01-01"] * 17 + ["junk"] * 3, "string"), (["a", "1"], "string"),
    ],
)
def test_kind(spark, values, kind):
    assert kinds.infer_kinds(frame(spark, c=values)) == {"c": kind}


def test_counts_of_a_union_add_up(spark):
    parts = [["1", "2"], ["x"], ["1.5", ""], ["", ""], ["2023-01-01"]]
    for a in parts:
        for b in parts:
            both = kinds.count_kinds(frame(spark, c=a + b))["c"]
            assert kinds.union_counts([kinds.count_kinds(frame(spark, c=x)) for x in (a, b)])["c"] == both


def test_casts(spark):
    cells = ["", " 7 ", "+8", "3.0", "1e3", "x", "9223372036854775807", "9223372036854775808", "nan", "-Infinity", "1d", "-.5"]
    df = frame(spark, c=cells).select(casts.to_integer(F.col("c")).alias("i"), casts.to_integer(F.col("c"), wide=True).alias("w"), casts.to_float(F.col("c")).alias("f"))
    rows = df.collect()
    assert [r.i for r in rows] == [None, 7, 8, None, None, None, 9223372036854775807, None, None, None, None, None]
    assert [None if r.w is None else int(r.w) for r in rows][6:8] == [9223372036854775807, 9223372036854775808]
    assert [str(r.f) for r in rows] == ["None", "7.0", "8.0", "3.0", "1000.0", "None", "9.223372036854776e+18", "9.223372036854776e+18", "nan", "-inf", "None", "-0.5"]


def test_cast_frame_keeps_what_does_not_fit(spark):
    df = frame(spark, i=["1", "2.0", ""], b=["true", "no", ""], d=["2023-01-01", "junk", ""], s=["a", "", "c"])
    how = {"i": "integer", "b": "boolean", "d": "datetime", "s": "string"}
    rows = casts.cast_frame(df, how).collect()
    assert [(r.i, r.b, r.s, r._rescued) for r in rows] == [(1, True, "a", {}), (None, False, "", {"i": "2.0", "d": "junk"}), (None, None, "c", {})]
    told = {(r.column, r.outcome): r.cells for r in casts.cast_fallbacks(df, how).collect()}
    assert told == {("i", "kept as text"): 1, ("d", "became null"): 1}
    assert casts.cast_frame(df.limit(0), how).count() == 0
    assert casts.cast_fallbacks(df, {}).count() == 0


def test_text_functions(spark):
    rows = spark.createDataFrame([("a b",), ("--",), ("é x_",), ("5-LOW",)], "v string").select(text.slug(F.col("v")), text.label(F.col("v"))).collect()
    assert [tuple(r) for r in rows] == [("a_b", "a_b"), ("value", "__"), ("x", "__x_"), ("5_LOW", "5_LOW")]
    assert spark.range(1).select(text.ratio(F.lit(1.0), F.lit(0.0))).first()[0] is None
