"""Entities: a source, a mapping, filters and a shape, bound to tables as one lazy plan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.casts import RESCUED, cast_column, rescued
from ..functions.kinds import INTEGER, STRING, Counts, count_kinds, infer_kinds, union_counts
from ..operators import shapes
from ..operators.filters import Filter, check_filters, partitioned
from ..operators.filters import apply_filters as filtered
from ..operators.mapping import AUTO, HYBRID, MANUAL, Field, MappingError, Nested, effective, expand, fields_from, flat, key_names, leaves, source_column
from ..sources.scan import POSITION, SOURCE, sample_per_source, union_sources, with_places

#: The texts of a row that is also there with its kinds.
TEXT = "_text"
MODELS = ("relational", "document", "keyvalue", "wide", "graph")


@dataclass(frozen=True)
class Entity:
    """A named target table. source: one name, several for a union, or none for the source of its own name."""

    name: str
    model: str
    columns: tuple[Field | Nested, ...] = ()
    source: str | tuple[str, ...] | None = None
    mode: str = MANUAL
    only: tuple[str | int, ...] | None = None
    filters: tuple[Filter, ...] = ()
    partition: tuple[str, ...] = ()
    cluster: tuple[str, ...] = ()
    order: tuple[str, ...] = (POSITION,)


@dataclass
class Bound:
    """An entity with its table of typed columns; nothing has run but the counts behind the kinds."""

    entity: Entity
    fields: tuple[Field | Nested, ...]
    typed: DataFrame
    kinds: dict[str, str] = field(default_factory=dict)
    wide: frozenset[str] = frozenset()

    def lost(self) -> DataFrame:
        """The filtered rows' texts with cells that their kinds cannot hold, these cells in _rescued: what shaped() shows as null."""
        return self._filtered(self.typed).where(F.size(RESCUED) > 0).select(f"{TEXT}.*", RESCUED)

    def planned(self) -> DataFrame:
        """What a load counts: relational rows and nodes once for each key, of other models every row."""
        return self.shaped() if self.entity.model in ("relational", "graph") else self.rows()

    def rows(self) -> DataFrame:
        """Filtered rows with _partition, cells that do not fit in _rescued."""
        return self._filtered(self.typed).drop(TEXT)

    def _filtered(self, df: DataFrame) -> DataFrame:
        e = self.entity
        return partitioned(filtered(df, list(e.filters), self.kinds), list(e.filters), e.name)

    def shaped(self, rows: DataFrame | None = None) -> DataFrame:
        """The rows (those of rows() if none are given) as the model stores them."""
        e, rows = self.entity, (self.rows() if rows is None else rows).drop(RESCUED)
        if e.model == "relational":
            return shapes.to_relational(rows, self.fields, e.order)
        if e.model == "document":
            return shapes.to_documents(rows, self.fields)
        if e.model == "keyvalue":
            return shapes.to_keyvalue(rows, self.fields, e.order)
        if e.model == "wide":
            return shapes.to_wide(rows, self.fields, e.partition, e.cluster, e.order)
        return shapes.to_nodes(rows, self.fields, e.order)

    def listing(self) -> DataFrame:
        return effective(self.typed, self.entity.name, self.fields, self.entity.columns, self.kinds)


class Binder:
    """Binds entities to named sources. Each source's columns are counted once, however many entities read them."""

    def __init__(self, sources: dict[str, DataFrame]) -> None:
        self.sources = sources
        self._counts: dict[str, dict[str, Counts]] = {}

    def counts(self, name: str) -> dict[str, Counts]:
        if name not in self._counts:
            df = self.sources[name]
            self._counts[name] = count_kinds(df, [c for c in df.columns if c not in (SOURCE, POSITION)])
        return self._counts[name]

    def bind(self, e: Entity, kinds: dict[str, str] | None = None) -> Bound:
        if e.model not in MODELS:
            raise MappingError(f"{e.name}: unknown model {e.model}")
        if e.source == ():
            raise MappingError(f"{e.name}: an empty list of sources")
        names = [e.source or e.name] if not isinstance(e.source, tuple) else list(e.source)
        if missing := [n for n in names if n not in self.sources]:
            raise MappingError(f"{e.name}: no source {missing}")
        keyed = e.model in ("keyvalue", "wide", "graph") or bool(key_names(e.columns))
        parts = [with_places(self.sources[n]) if keyed and POSITION in e.order else self.sources[n] for n in names]
        df = parts[0] if len(parts) == 1 else union_sources(parts)
        check_entity(e, df)
        fields = expand(e.columns, df.columns, e.mode, list(e.only) if e.only is not None else None)
        wide: frozenset[str] = frozenset()
        if kinds is None:
            counts = union_counts(map(self.counts, names))
            kinds = {n: c.kind() for n, c in counts.items()} | {SOURCE: "string"}
            wide = frozenset(n for n, c in counts.items() if c.kind() == INTEGER and c.wides)
        return Bound(e, fields, _cast_with_text(df, kinds, wide), kinds, wide)


def _cast_with_text(df: DataFrame, kinds: dict[str, str], wide: frozenset[str]) -> DataFrame:
    """The typed columns, with the rows' places (no data, so not cast), their texts in _text and the cells that do not fit in _rescued."""
    data = [c for c in df.columns if c != POSITION]
    typed = (cast_column(F.col(f"`{c}`"), kinds.get(c, STRING), c in wide).alias(c) for c in data)
    place = [c for c in df.columns if c == POSITION]
    return df.select(*place, *typed, F.struct(*(F.col(f"`{c}`") for c in data)).alias(TEXT), rescued(data, kinds, wide).alias(RESCUED))


def check_entity(e: Entity, df: DataFrame) -> None:
    """Columns, keys and filters against the source's header: no job runs."""
    for _, f in leaves(e.columns):
        source_column(f, df.columns)
    check_filters(list(e.filters), df.columns)
    if e.model != "document":
        flat(e.columns)
    if e.model in ("keyvalue", "graph") and len(key_names(e.columns)) != 1:
        raise MappingError(f"{e.name}: {e.model} needs one key column")
    if e.model == "wide" and not e.partition:
        raise MappingError(f"{e.name}: a wide-column entity needs a partition key")
    if e.mode not in (MANUAL, AUTO, HYBRID) or (e.mode == MANUAL and not e.columns):
        raise MappingError(f"{e.name}: no columns")


@dataclass(frozen=True)
class Reference:
    """A foreign key from one relational entity to another; key defaults to foreign_key."""

    child: str
    parent: str
    foreign_key: str
    key: str | None = None
    name: str = "reference"


def check_references(references: Sequence[Reference], bound: dict[str, Bound]) -> None:
    for r in references:
        for entity, column in ((r.child, r.foreign_key), (r.parent, r.key or r.foreign_key)):
            if entity not in bound:
                raise MappingError(f"{r.name}: no entity {entity}")
            if column not in {f.name for f in bound[entity].fields}:
                raise MappingError(f"{r.name}: {entity} has no column {column}")


@dataclass(frozen=True)
class Edge:
    """A relation between two graph entities, drawn from the rows of the first, which carry both keys.

    Properties marked as key tell edges with the same ends apart.
    """

    type: str
    start: str
    end: str
    properties: tuple[Field, ...] = ()


def key_field(b: Bound) -> Field:
    (own,) = [f for _, f in leaves(b.fields) if f.key]
    return own


def edge_rows(edge: Edge, bound: dict[str, Bound], rows: DataFrame | None = None, nodes: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(src, dst, type, properties) of an edge, from the rows of its start (or those given); both ends must be nodes, of the run or those given."""
    if missing := [n for n in (edge.start, edge.end) if n not in bound]:
        raise MappingError(f"{edge.type}: no entity {missing}")
    a, b = bound[edge.start], bound[edge.end]
    first, second = key_field(a), key_field(b)
    ends = [source_column(f, a.typed.columns) for f in (first, second)]
    return shapes.to_edges(a.rows() if rows is None else rows, *ends, edge.type, nodes[0] if nodes else a.shaped(), first.name, nodes[1] if nodes else b.shaped(), second.name, edge.properties, a.entity.order)


def relations_from(config: dict) -> tuple[list[Reference], list[Edge]]:
    """References and edges of {model: {"relationships": {name: {from, to, foreign_key, references_key} or {from, to, type, columns}}}}."""
    references, edges = [], []
    for block in config.values():
        for name, r in block.get("relationships", {}).items():
            if "foreign_key" in r:
                references.append(Reference(r["from"], r["to"], r["foreign_key"], r.get("references_key"), name))
            else:
                edges.append(Edge(r.get("type", name), r["from"], r["to"], flat(fields_from(r.get("columns", {})))))
    return references, edges


def entities_from(config: dict) -> list[Entity]:
    """Entities of {model: {"entities": {name: {source, columns, mode, csv_columns, filters, partition, cluster}}}}."""
    out = []
    for model, block in config.items():
        for name, e in block.get("entities", {}).items():
            source = e.get("source")
            filters = tuple(Filter(f["column"], f["operator"], f.get("value"), f.get("target_suffix")) for f in e.get("filters", ()))
            columns = fields_from(e.get("columns", {}))
            mode = e.get("mode") or (MANUAL if columns else AUTO)
            only = tuple(e["csv_columns"]) if "csv_columns" in e else None
            out.append(Entity(name, model, columns, tuple(source) if isinstance(source, list) else source, mode, only, filters, tuple(e.get("partition", ())), tuple(e.get("cluster", ()))))
    return out


def sample_kinds(df: DataFrame, rows: int = 8192) -> dict[str, str]:
    """Kinds from the first rows of each source only, as a stream must bind before it has seen all."""
    first = sample_per_source(with_places(df), rows, POSITION) if SOURCE in df.columns else df.limit(rows)
    return infer_kinds(first.drop(POSITION))
