"""Filters over typed columns, and the split by distinct value."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import BOOLEAN, DATETIME, FLOAT, INTEGER, STRING, as_datetime
from ..functions.text import is_blank, null_if_blank, slug

COMPARE = {
    ">": lambda c, v: c > v,
    "<": lambda c, v: c < v,
    ">=": lambda c, v: c >= v,
    "<=": lambda c, v: c <= v,
}
OPERATORS = ("==", "!=", *COMPARE, "in", "not_in", "each")
PARTITION = "_partition"


class FilterError(ValueError):
    """A filter does not fit the table that it is bound to."""


@dataclass(frozen=True)
class Filter:
    column: str
    operator: str
    value: Any = None
    target_suffix: str | None = None


def check_filters(filters: list[Filter], columns: list[str]) -> None:
    """Unknown columns and operators, values that are no list, and a second split are errors before any job."""
    for f in filters:
        if f.column not in columns:
            raise FilterError(f"unknown column: {f.column}")
        if f.operator not in OPERATORS:
            raise FilterError(f"unknown operator: {f.operator}")
        if f.operator in ("in", "not_in") and not isinstance(f.value, (list, tuple, set)):
            raise FilterError(f"{f.operator} on {f.column} needs a list")
        if f.operator in COMPARE and (f.value is None or f.value == ""):
            raise FilterError(f"{f.operator} on {f.column} needs a value")
    if sum(f.operator == "each" for f in filters) > 1:
        raise FilterError("only one split by value")


def _literal(value: Any, kind: str) -> Column:
    """A literal of the column's kind; null where the value does not parse."""
    if value is None:
        return F.lit(None)
    if kind in (INTEGER, FLOAT):
        return F.lit(str(value)).try_cast("decimal(38,0)" if kind == INTEGER and str(value).lstrip("+-").isdigit() else "double")
    if kind == DATETIME:
        return as_datetime(F.lit(str(value)))
    if kind == BOOLEAN:
        return F.lit(str(value).strip().lower() == "true")
    return F.lit(str(value))


def predicate(f: Filter, kind: str = STRING) -> Column:
    """A filter as a condition on a typed column. Null and blank are the same: "!=" and "not_in" keep them, all others drop them."""
    c = F.col(f"`{f.column}`")
    if kind == STRING:
        c = null_if_blank(c.cast("string"))
    if f.operator == "==":
        return F.coalesce(c == _literal(f.value, kind), F.lit(False))
    if f.operator == "!=":
        return F.coalesce(c != _literal(f.value, kind), F.lit(True))
    if f.operator in COMPARE:
        return COMPARE[f.operator](c, _literal(f.value, kind))
    found = F.coalesce(c.isin(*(_literal(v, kind) for v in f.value)), F.lit(False)) if f.value else F.lit(False)
    return ~found if f.operator == "not_in" else found


def apply_filters(df: DataFrame, filters: list[Filter], kinds: dict[str, str] | None = None) -> DataFrame:
    """All filters but splits; plain conditions, so that Spark can push them to the scan."""
    check_filters(filters, df.columns)
    for f in filters:
        one_row = df.sparkSession.sql("VALUES (1)")  # a local row: the literal is parsed on the driver, without a job
        if f.operator in COMPARE and one_row.select(_literal(f.value, (kinds or {}).get(f.column, STRING)).isNull()).first()[0]:
            raise FilterError(f"{f.operator} on {f.column}: {f.value!r} is no value of the column's kind")
        if f.operator != "each":
            df = df.where(predicate(f, (kinds or {}).get(f.column, STRING)))
    return df


def split_each(df: DataFrame, column: str, base: str, suffix: str | None = None) -> DataFrame:
    """A column _partition: base_<slug of the value>, or base_<suffix> for all. Rows with a blank value are dropped.

    One pass for all values; written with partitionBy it makes a folder for each.
    """
    c = F.col(f"`{column}`")
    name = F.lit(f"{base}_{suffix}") if suffix else F.concat(F.lit(f"{base}_"), slug(c))
    return df.where(~is_blank(c.cast("string"))).withColumn(PARTITION, name)


def partitioned(df: DataFrame, filters: list[Filter], base: str) -> DataFrame:
    """_partition by the one "each" filter, or the base name where there is none."""
    for f in filters:
        if f.operator == "each":
            return split_each(df, f.column, base, f.target_suffix)
    return df.withColumn(PARTITION, F.lit(base))
