"""Typed columns from text, with the cells that do not fit kept aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kinds import BOOLEAN, DATETIME, EMPTY, FLOAT, INTEGER, STRING, as_datetime
from .text import SPACE, is_blank, stripped

RESCUED = "_rescued"
#: Kind -> declared type of a relational target (fixed values).
DECLARED = {EMPTY: "TEXT", BOOLEAN: "BOOLEAN", INTEGER: "BIGINT", FLOAT: "NUMERIC", DATETIME: "TIMESTAMPTZ", STRING: "TEXT"}
SPARK_TYPES: dict[str, T.DataType] = {EMPTY: T.StringType(), BOOLEAN: T.BooleanType(), INTEGER: T.LongType(), FLOAT: T.DoubleType(), DATETIME: T.TimestampType(), STRING: T.StringType()}

_WHOLE = rf"^{SPACE}*[+-]?[0-9]+{SPACE}*$"
_REAL = rf"^{SPACE}*[+-]?(?:[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?|(?i:nan|inf|infinity)){SPACE}*$"
_SIGNED_NAN = rf"^{SPACE}*[+-]?(?i:nan){SPACE}*$"


def to_integer(c: Column, wide: bool = False) -> Column:
    """Digits with a sign, nothing else: "3.0" and "1e3" are no integers. wide: decimal(38,0) for values beyond 64 bits."""
    return F.when(c.rlike(_WHOLE), stripped(c).try_cast("decimal(38,0)" if wide else "bigint"))


def to_float(c: Column) -> Column:
    """Numbers, nan, inf and infinity in any case, with a sign."""
    return F.when(c.rlike(_SIGNED_NAN), F.lit(float("nan"))).when(c.rlike(_REAL), stripped(c).try_cast("double"))


def to_boolean(c: Column) -> Column:
    """The word true is true, any other text false; blank is null."""
    return F.when(~is_blank(c), F.lower(stripped(c)) == "true")


def cast_column(c: Column, kind: str, wide: bool = False) -> Column:
    """Blank is null in every kind but string and empty, where it stays the empty text."""
    c = c.cast("string")
    if kind == INTEGER:
        return to_integer(c, wide)
    if kind == FLOAT:
        return to_float(c)
    if kind == BOOLEAN:
        return to_boolean(c)
    if kind == DATETIME:
        return as_datetime(c)
    return F.coalesce(c, F.lit(""))


def cast_frame(df: DataFrame, kinds: dict[str, str], wide: set[str] | frozenset[str] = frozenset(), rescue: bool = True) -> DataFrame:
    """Each column by its kind. With rescue, _rescued maps the columns whose text did not fit a number or date to that text."""
    typed = [cast_column(F.col(f"`{n}`"), kinds.get(n, STRING), n in wide).alias(n) for n in df.columns if n != RESCUED]
    if rescue:
        typed.append(rescued(df.columns, kinds, wide).alias(RESCUED))
    return df.select(*typed)


def rescued(names: list[str], kinds: dict[str, str], wide: set[str] | frozenset[str] = frozenset()) -> Column:
    """Map of the columns whose text did not fit a number or date to that text."""
    fallible = [n for n in names if kinds.get(n) in (INTEGER, FLOAT, DATETIME)]
    entries = [F.when(misfit(F.col(f"`{n}`"), kinds[n], n in wide), F.struct(F.lit(n), F.col(f"`{n}`").cast("string"))) for n in fallible]
    if not entries:
        return F.lit(None).cast("map<string,string>")
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull()))


def misfit(c: Column, kind: str, wide: bool = False) -> Column:
    """A value that its kind cannot hold."""
    return ~is_blank(c.cast("string")) & cast_column(c, kind, wide).isNull()


def cast_fallbacks(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(column, kind, cells, outcome) of cells that could not be cast; a number's text is kept, a date becomes null."""
    names = [n for n in df.columns if kinds.get(n) in (INTEGER, FLOAT, DATETIME)]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, kind string, cells long, outcome string")
    counts = df.agg(*(F.count_if(misfit(F.col(f"`{n}`"), kinds[n])).alias(n) for n in names))
    rows = F.array(*(F.struct(F.lit(n).alias("column"), F.lit(kinds[n]).alias("kind"), F.col(f"`{n}`").alias("cells"), F.lit("became null" if kinds[n] == DATETIME else "kept as text").alias("outcome")) for n in names))
    return counts.select(F.inline(rows))
