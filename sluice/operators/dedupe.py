"""One row for each key: last wins, first wins, upserts and merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank

LAST, FIRST = "last", "first"


def _no_null_key(df: DataFrame, keys: Sequence[str], blank: bool) -> DataFrame:
    for k in keys:
        c = F.col(f"`{k}`")
        df = df.where(~is_blank(c.cast("string")) if blank else c.isNotNull())
    return df


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: str = LAST, drop_blank: bool = True) -> DataFrame:
    """The last (or first) whole row of each key in the order of `order`, which must be total for a fixed result.

    An aggregate of max(struct) (min for the first): each task sends one row for each key, so a key that very many
    rows share costs no more than one row per task. Maps cannot be compared; with a map column the row is picked by
    max_by instead. Rows with a null key are dropped, with drop_blank also those with a blank one.
    """
    df = _no_null_key(df, keys, drop_blank)
    place = F.struct(*(F.col(f"`{o}`").alias(f"o{i}") for i, o in enumerate(order))) if order else F.lit(0)
    by = df.groupBy(*(F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)))
    if any("map<" in t for _, t in df.dtypes):
        whole = F.struct(*(F.col(f"`{c}`") for c in df.columns))
        return by.agg((F.max_by if keep == LAST else F.min_by)(whole, place).alias("row")).select("row.*")
    at = {o: f"o{i}" for i, o in enumerate(order)} if set(df.columns) - set(order) else {}  # columns that are in place already
    whole = F.struct(*(F.col(f"`{c}`") for c in df.columns if c not in at))
    best = by.agg((F.max if keep == LAST else F.min)(F.struct(place.alias("place"), whole.alias("row"))).alias("best"))
    return best.select(*((F.col("best")["place"][at[c]] if c in at else F.col("best")["row"][c]).alias(c) for c in df.columns))


def skipped_duplicates(df: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """skipped: rows that first-wins drops as repeats of a key, for each value of `by`."""
    counts = _no_null_key(df, keys, False).groupBy(*by, *keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*by).agg(F.sum(F.col("n") - 1).alias("skipped"))


def insert_if_absent(new: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored rows and those new ones whose key is not stored."""
    return stored.unionByName(new.join(stored.select(*keys), list(keys), "left_anti").select(*stored.columns))


def upsert(stored: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows, and stored ones whose key is not among them."""
    return new.select(*stored.columns).unionByName(stored.join(new.select(*keys), list(keys), "left_anti").select(*stored.columns))


def merge_properties(stored: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each key of either side; properties that the load carries are overwritten, also by null, others stay."""
    carried = [c for c in new.columns if c not in keys]
    fresh = new.select(*keys, F.lit(True).alias("_new"), *(F.col(f"`{c}`").alias(f"_n_{c}") for c in carried))
    joined = stored.join(fresh, list(keys), "full_outer")

    def value(c: str) -> Column:
        old = F.col(f"`{c}`") if c in stored.columns else F.lit(None)
        return (F.when(F.col("_new"), F.col(f"`_n_{c}`")).otherwise(old) if c in carried else old).alias(c)

    others = [c for c in stored.columns if c not in keys] + [c for c in carried if c not in stored.columns]
    return joined.select(*keys, *map(value, others))


def last_written(df: DataFrame, keys: Sequence[str], load: str, carried: dict[str, list[int]]) -> DataFrame:
    """One row for each key, each property from the last load that carries it and has the key, null included.

    carried lists the loads that have a column: a null of one of them is a value, a column that a load lacks is none.
    """
    by = lambda c: F.when(F.col(load).isin(carried[c]), F.col(load))
    rows = _no_null_key(df, keys, False)
    if not carried:
        return rows.select(*(F.col(f"`{k}`") for k in keys)).distinct()
    out = rows.groupBy(*(F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys))).agg(*(F.max_by(F.col(f"`{c}`"), by(c)).alias(f"p{i}") for i, c in enumerate(carried)))
    names = {**{k: f"k{i}" for i, k in enumerate(keys)}, **{c: f"p{i}" for i, c in enumerate(carried)}}
    return out.select(*(F.col(names[c]).alias(c) for c in df.columns if c in names))


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys with more than one row: empty where the key is unique."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
