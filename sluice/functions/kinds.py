"""Kinds of text columns, inferred in one aggregate over a table."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import is_blank, stripped

EMPTY, BOOLEAN, INTEGER, FLOAT, DATETIME, STRING = "empty", "boolean", "integer", "float", "datetime", "string"
KINDS = (EMPTY, BOOLEAN, INTEGER, FLOAT, DATETIME, STRING)
#: A column is a datetime when more than this share of its values parse.
DATETIME_SHARE = 0.85
#: From here on a whole number needs more than 64 bits.
BEYOND_LONG = 2.0**63

NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity))$"
#: Free date forms after ISO: what a text must look like, and the formats then tried in order, day-first only where
#: month-first fails. Texts of another look, most of all texts, are never parsed.
DATE_FORMS = (
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", ("M/d/yyyy", "d/M/yyyy")),
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2}$", ("M/d/yyyy HH:mm:ss", "d/M/yyyy HH:mm:ss")),
    (r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$", ("M-d-yyyy", "d-M-yyyy")),
    (r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$", ("yyyy/M/d",)),
    (r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2} [0-9]{2}:[0-9]{2}:[0-9]{2}$", ("yyyy/M/d HH:mm:ss",)),
    (r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", ("yyyy-M-d",)),
    (r"^[0-9]{8}T[0-9]{6}$", ("yyyyMMdd'T'HHmmss",)),
    (r"^[A-Za-z]{3} [0-9]{1,2} [0-9]{4}$", ("MMM d yyyy",)),
    (r"^[A-Za-z]{3} [0-9]{1,2}, [0-9]{4}$", ("MMM d, yyyy",)),
    (r"^[A-Za-z]{4,9} [0-9]{1,2} [0-9]{4}$", ("MMMM d yyyy",)),
    (r"^[A-Za-z]{4,9} [0-9]{1,2}, [0-9]{4}$", ("MMMM d, yyyy",)),
    (r"^[0-9]{1,2} [A-Za-z]{3} [0-9]{4}$", ("d MMM yyyy",)),
    (r"^[0-9]{1,2} [A-Za-z]{4,9} [0-9]{4}$", ("d MMMM yyyy",)),
)
_ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?\s*(?:Z|[+-][0-9]{2}(?::?[0-9]{2})?)?)?$"


def as_number(c: Column) -> Column:
    """Double, or null: decimal numbers with exponent, and infinity; not "nan" and not Spark's suffixed literals."""
    return _number(stripped(c))


def as_datetime(c: Column) -> Column:
    """Timestamp, or null: ISO forms first, then DATE_FORMS. Forms without a zone are read in the session's."""
    return _datetime(stripped(c))


def is_boolean(c: Column) -> Column:
    return _boolean(stripped(c))


# the same of texts without white space around them


def _number(text: Column) -> Column:
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def _datetime(text: Column) -> Column:
    iso = F.when(text.rlike(_ISO), text.try_cast("timestamp"))
    return F.coalesce(iso, *(F.when(text.rlike(look), F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in formats))) for look, formats in DATE_FORMS))


def _boolean(text: Column) -> Column:
    return F.lower(text).isin("true", "false")


@dataclass(frozen=True)
class Counts:
    """Counters of one column. They add up over the parts of a union, so a union needs no second scan."""

    filled: int = 0
    booleans: int = 0
    numbers: int = 0
    wholes: int = 0
    datetimes: int = 0
    wides: int = 0

    def __add__(self, other: Counts) -> Counts:
        return Counts(*(getattr(self, f.name) + getattr(other, f.name) for f in fields(self)))

    def kind(self, share: float = DATETIME_SHARE) -> str:
        """Numbers come before dates, so that an identifier like 1000 is no year."""
        if not self.filled:
            return EMPTY
        if self.booleans == self.filled:
            return BOOLEAN
        if self.numbers == self.filled:
            return INTEGER if self.wholes == self.filled else FLOAT
        return DATETIME if self.datetimes > share * self.filled else STRING


def counters(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """One row with a struct of counters for each column, all in one pass with partial sums before the shuffle."""
    names = [c for c in df.columns if c not in ("_source", "_pos")] if columns is None else list(columns)

    def one(k: int, name: str) -> Column:
        filled, text = ~is_blank(F.col(f"c{k}")), F.col(f"s{k}")
        number = _number(text)
        return F.struct(
            F.count_if(filled).alias("filled"),
            F.count_if(filled & _boolean(text)).alias("booleans"),
            F.count_if(filled & number.isNotNull()).alias("numbers"),
            F.count_if(filled & (number % 1 == 0)).alias("wholes"),
            F.count_if(filled & number.isNull() & _datetime(text).isNotNull()).alias("datetimes"),
            F.count_if(F.abs(number) >= BEYOND_LONG).alias("wides"),
        ).alias(name)

    if not names:
        return df.sparkSession.range(1).select()
    cells = [F.col(f"`{n}`").cast("string") for n in names]
    texts = df.select(*(c.alias(f"c{k}") for k, c in enumerate(cells)), *(stripped(c).alias(f"s{k}") for k, c in enumerate(cells)))  # stripped once
    return texts.agg(*(one(k, n) for k, n in enumerate(names)))


def count_kinds(df: DataFrame, columns: Iterable[str] | None = None) -> dict[str, Counts]:
    row = counters(df, columns).first()
    return {name: Counts(*row[name]) for name in row.__fields__}


def infer_kinds(df: DataFrame, columns: Iterable[str] | None = None) -> dict[str, str]:
    """Kind of each column of text; the pseudo-column _source is always a string."""
    found = {name: c.kind() for name, c in count_kinds(df, columns).items()}
    return found | ({"_source": STRING} if "_source" in df.columns and columns is None else {})


def union_counts(parts: Iterable[dict[str, Counts]]) -> dict[str, Counts]:
    out: dict[str, Counts] = {}
    for part in parts:
        for name, c in part.items():
            out[name] = out.get(name, Counts()) + c
    return out


def datetime_share(df: DataFrame, column: str) -> DataFrame:
    """One row: filled, parsed, share. Each distinct value is parsed once and weighted by how often it occurs."""
    values = df.select(F.col(column).cast("string").alias("v")).where(~is_blank(F.col("v"))).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    parsed = F.sum(F.when(as_datetime(F.col("v")).isNotNull(), F.col("n")).otherwise(0))
    return values.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("filled"), F.coalesce(parsed, F.lit(0)).alias("parsed")).withColumn("share", F.when(F.col("filled") > 0, F.col("parsed") / F.col("filled")))
