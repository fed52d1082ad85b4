"""The five target shapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import label
from ..sources.scan import POSITION
from . import dedupe
from .filters import PARTITION
from .mapping import Field, MappingError, Nested, as_declared, flat, key_names, keys_first, leaves, nan_as_null, project

#: Where the row of a load stands among its rows, as one comparable value; only streams have it.
PLACE = "_place"
CARRIED = (PARTITION, POSITION, PLACE)


def _one_key(fields: Sequence[Field | Nested]) -> str:
    keys = key_names(tuple(fields))
    if len(keys) != 1:
        raise MappingError(f"exactly one key column is needed, there are {len(keys)}")
    return keys[0]


def _by(df: DataFrame, keys: Sequence[str]) -> list[str]:
    """Keys are unique within a partition."""
    return [*([PARTITION] if PARTITION in df.columns else []), *keys]


def to_relational(df: DataFrame, fields: Sequence[Field], order: Sequence[str] = (POSITION,)) -> DataFrame:
    """Flat rows; with keys, the last row of each key, rows with a blank key dropped; without, all rows."""
    out = project(df, flat(tuple(fields)), (*CARRIED, *order))
    if keys := key_names(tuple(fields)):
        out = dedupe.dedupe(out, _by(out, keys), list(order))
    return out.drop(POSITION, *(o for o in order if o not in {f.name for f in fields}))


def to_documents(df: DataFrame, fields: Sequence[Field | Nested]) -> DataFrame:
    """One nested record for each row; nothing is deduplicated and null fields stay."""
    return nan_as_null(project(df, tuple(fields), (PARTITION,)))


def to_keyvalue(df: DataFrame, fields: Sequence[Field], order: Sequence[str] = (POSITION,)) -> DataFrame:
    """(key, value): the key as text, the other columns as a JSON object with null fields; of a key the last row, null keys dropped."""
    key = _one_key(fields)
    rows = nan_as_null(project(df, flat(tuple(fields)), (*CARRIED, *order)))
    rest = [F.col(f"`{f.name}`") for f in fields if f.name != key]
    value = F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}) if rest else F.lit("{}")
    places = [F.col(f"`{o}`").alias(f"_o{i}") for i, o in enumerate(order)]
    out = rows.select(F.col(f"`{key}`").cast("string").alias("key"), value.alias("value"), *(c for c in (PARTITION, PLACE) if c in rows.columns), *places)
    return dedupe.dedupe(out, _by(out, ["key"]), [f"_o{i}" for i in range(len(places))], drop_blank=False).drop(*(f"_o{i}" for i in range(len(places))))


def from_keyvalue(df: DataFrame, schema: str) -> DataFrame:
    """(key, the value's fields as columns) of stored pairs; a field that a value lacks is null, and so are all of a value that is no object."""
    return df.select("key", F.from_json("value", schema).alias("_v")).select("key", "_v.*")


def to_wide(df: DataFrame, fields: Sequence[Field], partition: Sequence[str], cluster: Sequence[str] = (), order: Sequence[str] = (POSITION,)) -> DataFrame:
    """Rows upserted by partition and cluster keys, the last wins; keys come first. The write puts a partition's rows together, in cluster order."""
    if not partition:
        raise MappingError("a wide-column target needs a partition key")
    rows = as_declared(project(df, flat(tuple(fields)), (*CARRIED, *order)), tuple(fields))
    names = keys_first([f.name for f in fields], list(partition), list(cluster))
    out = dedupe.dedupe(rows, _by(rows, [*partition, *cluster]), list(order), drop_blank=False)
    return out.select(*(F.col(f"`{n}`") for n in names), *(c for c in (PARTITION, PLACE) if c in out.columns))


def to_nodes(df: DataFrame, fields: Sequence[Field], order: Sequence[str] = (POSITION,)) -> DataFrame:
    """Nodes by their one key, the first row wins; null keys are dropped, a blank one is a key."""
    key = _one_key(fields)
    rows = nan_as_null(project(df, flat(tuple(fields)), (*CARRIED, *order)))
    return dedupe.dedupe(rows, _by(rows, [key]), list(order), keep=dedupe.FIRST, drop_blank=False).drop(POSITION, *(o for o in order if o not in {f.name for f in fields}))


def to_edges(
    df: DataFrame, src: str, dst: str, kind: str, nodes_from: DataFrame, from_key: str, nodes_to: DataFrame, to_key: str,
    properties: Sequence[Field] = (), order: Sequence[str] = (POSITION,),
) -> DataFrame:
    """(src, dst, type, properties): edges of the from-table's rows whose both ends are nodes.

    Rows with a null end are dropped, then those without a node at an end (two semi joins); of the rows with the same
    ends and merge keys (properties marked as key) the last wins.
    """
    merge = [f.name for f in properties if f.key]
    places = [F.col(f"`{o}`").alias(f"_o{i}") for i, o in enumerate(order)]
    read = [F.col(f"`{f.source or f.name}`").alias(f.name) for f in properties]
    rows = df.select(F.col(f"`{src}`").alias("src"), F.col(f"`{dst}`").alias("dst"), *read, *places, *(c for c in (PLACE,) if c in df.columns)).dropna(subset=["src", "dst"])
    rows = rows.join(nodes_from.select(F.col(f"`{from_key}`").alias("src")), "src", "left_semi")
    rows = rows.join(nodes_to.select(F.col(f"`{to_key}`").alias("dst")), "dst", "left_semi")
    out = dedupe.dedupe(rows, ["src", "dst", *merge], [f"_o{i}" for i in range(len(places))], drop_blank=False)
    return out.select("src", "dst", label(F.lit(kind)).alias("type"), *(f.name for f in properties), *(c for c in (PLACE,) if c in out.columns))


def target_schema(df: DataFrame, fields: Sequence[Field | Nested]) -> list[tuple[str, str, bool]]:
    """(name, Spark type, key) of each column of a shaped table."""
    keys = {f.name for _, f in leaves(tuple(fields)) if f.key}
    return [(n, t, n in keys) for n, t in df.dtypes if n not in CARRIED]
