"""Which columns an entity takes, under which names, types and nesting."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.casts import DECLARED
from ..sources.scan import POSITION, SOURCE

MANUAL, AUTO, HYBRID = "manual", "auto", "hybrid"


class MappingError(ValueError):
    """A mapping names what is not there, or what its target cannot hold."""


@dataclass(frozen=True)
class Field:
    """One target column. source: a column's name or 1-based place, the target's name if absent.

    slot: the automatic column that a hybrid mapping replaces by this field, the target's name if absent.
    """

    name: str
    source: str | int | None = None
    key: bool = False
    type: str | None = None
    slot: str | None = None


@dataclass(frozen=True)
class Nested:
    """A nested record of fields."""

    name: str
    fields: tuple[Field | Nested, ...]


def fields_from(columns: dict) -> tuple[Field | Nested, ...]:
    """Fields of a mapping {key: {csv_column, schema_column, is_key, db_type}}; other dicts are nested records."""
    out: list[Field | Nested] = []
    for key, spec in columns.items():
        if set(spec) <= {"csv_column", "schema_column", "is_key", "db_type"}:
            out.append(Field(spec.get("schema_column") or key, spec.get("csv_column", key), bool(spec.get("is_key")), spec.get("db_type"), key))
        else:
            out.append(Nested(key, fields_from(spec)))
    return tuple(out)


#: Columns that rows carry beside their data.
INTERNAL = (POSITION, "_partition", "_place", "_rescued", "_text")


def select_columns(tokens: list[str | int], header: list[str]) -> list[str]:
    """Names, 1-based places and lo-hi ranges -> column names in header order, each once."""
    chosen: set[int] = set()
    for token in map(str, tokens):
        if span := re.fullmatch(r"\s*(\d+)\s*(?:-\s*(\d+)\s*)?", token):
            low, high = int(span[1]), int(span[2] or span[1])
            if not 1 <= low <= high <= len(header):
                raise MappingError(f"{token}: places are 1 to {len(header)}")
            chosen.update(range(low - 1, high))
        elif token in header:
            chosen.add(header.index(token))
        else:
            raise MappingError(f"{token}: no such column")
    return [header[i] for i in sorted(chosen)]


def source_column(field: Field, columns: list[str]) -> str:
    """The column that a field reads. The place after the last data column is _source."""
    if isinstance(field.source, int):
        ordered = [c for c in columns if c not in (SOURCE, *INTERNAL)] + [c for c in columns if c == SOURCE]
        if not 1 <= field.source <= len(ordered):
            raise MappingError(f"{field.name}: there is no column {field.source}")
        return ordered[field.source - 1]
    name = field.source or field.name
    if name not in columns:
        raise MappingError(f"{field.name}: no column {name}")
    return name


def leaves(fields: tuple[Field | Nested, ...], path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], Field]]:
    """All fields with the path of records around them."""
    for f in fields:
        if isinstance(f, Nested):
            yield from leaves(f.fields, (*path, f.name))
        else:
            yield path, f


def expand(fields: tuple[Field | Nested, ...], header: list[str], mode: str = MANUAL, only: list[str | int] | None = None) -> tuple[Field | Nested, ...]:
    """The full mapping. auto: every data column. hybrid: the same, with given fields in place of the columns that their slots name.

    only limits the automatic columns, by name, place or range.
    """
    if mode == MANUAL:
        if only is not None:
            raise MappingError("a limit of columns needs an automatic mapping")
        return tuple(fields)
    data = [c for c in header if c not in (SOURCE, POSITION)]
    automatic = select_columns(only, data) if only is not None else data
    if mode == AUTO:
        return tuple(Field(c, c) for c in automatic)
    slots = {(f.slot or f.name) if isinstance(f, Field) else f.name: f for f in fields}
    first = [slots.get(c, Field(c, c)) for c in automatic]
    return tuple(first + [f for f in fields if f not in first])


def project(df: DataFrame, fields: tuple[Field | Nested, ...], keep: tuple[str, ...] = ()) -> DataFrame:
    """Select, rename and nest; each field is built on its own, so that two may read one column."""

    def build(f: Field | Nested) -> Column:
        if isinstance(f, Nested):
            return F.struct(*map(build, f.fields)).alias(f.name)
        return F.col(f"`{source_column(f, df.columns)}`").alias(f.name)

    names = [f.name for f in fields]
    if len(set(names)) < len(names):
        raise MappingError("a target column is named twice")
    return df.select(*map(build, fields), *(k for k in dict.fromkeys(keep) if k in df.columns and k not in names))


def flat(fields: tuple[Field | Nested, ...]) -> tuple[Field, ...]:
    """The fields of a target that has no nested records."""
    for f in fields:
        if isinstance(f, Nested):
            raise MappingError(f"{f.name}: only documents have nested records")
    return tuple(fields)  # type: ignore[return-value]


def key_names(fields: tuple[Field | Nested, ...]) -> list[str]:
    return [f.name for _, f in leaves(fields) if f.key]


def keys_first(names: list[str], partition: list[str], cluster: list[str]) -> list[str]:
    """Partition keys, cluster keys, then the rest."""
    head = [*partition, *cluster]
    if missing := [k for k in head if k not in names]:
        raise MappingError(f"unmapped keys: {missing}")
    return head + [n for n in names if n not in head]


def as_declared(df: DataFrame, fields: tuple[Field | Nested, ...]) -> DataFrame:
    """Values of text-typed targets as text; null stays null."""
    text = {f.name for f in fields if isinstance(f, Field) and (f.type or "").upper() in ("TEXT", "VARCHAR", "STRING")}
    return df.select(*(F.col(f"`{c}`").cast("string").alias(c) if c in text else F.col(f"`{c}`") for c in df.columns))


def nan_as_null(df: DataFrame) -> DataFrame:
    """Not-a-number as null, inside nested records too, for documents, key-value payloads and node properties."""

    def clean(c: Column, t: T.DataType) -> Column:
        if isinstance(t, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(c), c)
        if isinstance(t, T.StructType):
            return F.when(c.isNotNull(), F.struct(*(clean(c.getField(f.name), f.dataType).alias(f.name) for f in t.fields)))
        return c

    return df.select(*(clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields))


def effective(df: DataFrame, entity: str, fields: tuple[Field | Nested, ...], given: tuple[Field | Nested, ...], kinds: dict[str, str]) -> DataFrame:
    """(entity, column, type, origin) of each target column; origin tells a given field from an automatic one."""
    own = {id(f) for _, f in leaves(given)}
    rows = [
        (entity, ".".join((*path, f.name)), f.type or DECLARED[kinds.get(source_column(f, df.columns), "string")], "manual" if id(f) in own else "inferred")
        for path, f in leaves(fields)
    ]
    return df.sparkSession.createDataFrame(rows, "entity string, column string, type string, origin string")
