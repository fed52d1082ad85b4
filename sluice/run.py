"""One run over a configuration: its sources into the targets of each chosen model, as a batch or as streams.

A configuration is a mapping {"sources": {name: path or {"file", "origin_column"}}, model: {"entities", "relationships"}}.
Each model has a Store of its own under the run's folder; the edges of a graph are targets named by their type.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Iterator
from dataclasses import replace
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.casts import RESCUED
from .functions.kinds import STRING
from .functions.text import label_text
from .operators.filters import PARTITION
from .operators.mapping import MappingError, key_names, source_column
from .plans.entity import MODELS, Binder, Bound, Edge, Entity, check_references, edge_rows, entities_from, key_field, relations_from, sample_kinds
from .operators.relate import DanglingReference, constraint_report
from .plans.reports import Metrics, plan_counts
from .sinks import files
from .sinks.tables import Store, write
from .sources.scan import POSITION, SOURCE, load_sources, union_sources, with_places
from .streaming.stream import EdgeStream, EntityStream, run_batches, stream_sources


def chosen_models(config: dict, only: Iterable[str] | None = None) -> list[str]:
    """The models that the configuration has, or those of them named in only (case and outer blanks do not count)."""
    wanted = {m.strip().lower() for m in only or () if m and m.strip()}
    return [m for m in MODELS if m in config and (not wanted or m in wanted)]


def source_names(e: Entity) -> tuple[str, ...]:
    return e.source if isinstance(e.source, tuple) else (e.source or e.name,)


def _relations(config: dict, model: str, bound: dict[str, Bound]) -> list[Edge]:
    """The model's edges, after its references and the edges' ends have been checked. No job runs."""
    references, edges = relations_from({model: config[model]})
    check_references(references, bound)
    for edge in edges:
        if missing := [n for n in (edge.start, edge.end) if n not in bound]:
            raise MappingError(f"{edge.type}: no entity {missing}")
    return edges


def bind_run(config: dict, sources: dict[str, DataFrame], only: Iterable[str] | None = None) -> dict[str, tuple[dict[str, Bound], list[Edge]]]:
    """model -> (its bound entities by name, its edges). Sources are counted once for all models."""
    binder, out = Binder(sources), {}
    for model in chosen_models(config, only):
        bound = {e.name: binder.bind(e) for e in entities_from({model: config[model]})}
        out[model] = bound, _relations(config, model, bound)
    return out


def _edge_keys(edge: Edge) -> list[str]:
    return ["src", "dst", *(f.name for f in edge.properties if f.key)]


def run_batch(spark: SparkSession, config: dict, root: str, only: Iterable[str] | None = None, dry_run: bool = False, overrides: dict | None = None, create: bool = True, base: str | None = None, clean: bool = False, strict: bool = False, metrics: Metrics | None = None) -> DataFrame:
    """Load all entities, then the edges between them; (target, entity, partition, rows) of what is stored after.

    dry_run stores nothing and gives the counts that a load would write. Each entity is written under its model's re-run
    rules, so a run may be repeated; clean forgets what the targets held before. Text rows that pass the filters and have
    cells that do not fit their kinds are kept in <entity>_rescued, those of the last run. A target without a row, and
    references to keys that are not there, are warned of; with strict such references are an error, after the load.
    metrics gets the rows and seconds of each target, counted by the load itself.
    """
    metrics = metrics if metrics is not None else Metrics()
    plan = bind_run(config, load_sources(spark, config["sources"], overrides, base), only)
    if dry_run:
        rows = [(m, n, b.planned()) for m, (bound, _) in plan.items() for n, b in bound.items()]
        rows += [(m, e.type, edge_rows(e, bound).withColumn(PARTITION, F.lit(label_text(e.type)))) for m, (bound, edges) in plan.items() for e in edges]
        return plan_counts(rows)
    for model, (bound, edges) in plan.items():
        store = Store(spark, f"{root}/{model}", create)
        if clean:
            clean_targets(store, config, model)
        for name, b in bound.items():
            lost = metrics.stored(store, model, name, b.rows(), lambda rows, b=b, name=name: write(b.shaped(rows), store, name, model, _keys(b.entity, b)))
            if lost or store.exists(f"{name}{RESCUED}"):
                store.append(f"{name}{RESCUED}", b.lost(), load="batch")
        for edge in edges:
            name = label_text(edge.type)
            nodes = store.read(edge.start), store.read(edge.end)  # those of earlier loads too
            metrics.stored(store, model, name, bound[edge.start].rows(), lambda rows, edge=edge, name=name, nodes=nodes: write(edge_rows(edge, bound, rows, nodes), store, name, model, _edge_keys(edge)))
    _told(spark, config, root, only, metrics, strict, True)
    return stored_counts(spark, config, root, only)


def _names(config: dict, model: str) -> list[tuple[str, str]]:
    """(entity or edge type, name of its target) of a model."""
    entities = [(e.name, e.name) for e in entities_from({model: config[model]})]
    return entities + [(e.type, label_text(e.type)) for e in relations_from({model: config[model]})[1]]


def clean_targets(store: Store, config: dict, model: str) -> None:
    """Forget the targets of a model, and the rows that were rescued beside them."""
    for _, name in _names(config, model):
        store.clean(name)
        store.clean(f"{name}{RESCUED}")


def run_references(spark: SparkSession, config: dict, root: str, only: Iterable[str] | None = None) -> DataFrame | None:
    """(constraint, references, orphans) of all foreign keys among the stored targets, in one pass; none if there are none."""
    for model in chosen_models(config, only):
        references, _ = relations_from({model: config[model]})
        if references:
            store = Store(spark, f"{root}/{model}")
            tables = {n: store.read(n) for r in references for n in (r.child, r.parent)}
            return constraint_report(tables, [(r.child, r.foreign_key, r.parent, r.key or r.foreign_key, r.name) for r in references])
    return None


def _told(spark: SparkSession, config: dict, root: str, only: Iterable[str] | None, metrics: Metrics, strict: bool, first: bool) -> None:
    """What a load warns of, and refuses where it is strict; a stream that goes on may find nothing new."""
    for model in chosen_models(config, only):
        for _, name in _names(config, model):
            if not metrics.total(model, name, "write") and (first or not Store(spark, f"{root}/{model}").exists(name)):
                warnings.warn(f"{model}: nothing was written to {name}", stacklevel=3)
    report = run_references(spark, config, root, only)
    dangling = [] if report is None else report.where("orphans > 0").orderBy("constraint").collect()
    if dangling:
        said = ", ".join(f"{r['constraint']}: {r['orphans']} of {r['references']}" for r in dangling)
        if strict:
            raise DanglingReference(said)
        warnings.warn(f"rows that refer to no key: {said}", stacklevel=3)


def _keys(e: Entity, b: Bound) -> list[str]:
    if e.model == "keyvalue":
        return ["key"]
    if e.model == "wide":
        return [*e.partition, *e.cluster]
    return [] if e.model == "document" else key_names(b.fields)


def stored_counts(spark: SparkSession, config: dict, root: str, only: Iterable[str] | None = None) -> DataFrame:
    """(target, entity, partition, rows) of the stored targets of a configuration."""

    def targets() -> Iterator[tuple[str, str, DataFrame]]:
        for model in chosen_models(config, only):
            store = Store(spark, f"{root}/{model}")
            for entity, name in _names(config, model):
                if store.exists(name):
                    rows = store.read(name)
                    yield model, entity, rows if PARTITION in rows.columns else rows.withColumn(PARTITION, F.lit(name))

    return plan_counts(targets())


def run_stream(spark: SparkSession, config: dict, root: str, checkpoints: str, only: Iterable[str] | None = None, overrides: dict | None = None, sample: int = 8192, files_per_batch: int = 1, base: str | None = None, clean: bool = False, strict: bool = False, metrics: Metrics | None = None) -> DataFrame:
    """The same load by streams over files, up to what is there now; a later call goes on with the files that came since.

    Entities that read the same sources share one stream, over the union of its sources where there are several, widened to
    the superset of their columns. Kinds are bound first, from the first rows of each source (`sample`); what does not fit
    them later goes to <entity>_rescued. Edges are read in a second pass, after all nodes are stored. Rows have the places
    of a batch run (source, file, row), so first and last wins give the same rows in both. clean, strict and metrics are
    those of a batch run; clean forgets the checkpoints too, so that all files are read again.
    """
    metrics = metrics if metrics is not None else Metrics()
    samples, streams = stream_sources(spark, config["sources"], overrides, files_per_batch, base)
    for model in chosen_models(config, only):
        store, found = Store(spark, f"{root}/{model}"), {}
        if clean:
            clean_targets(store, config, model)
            files.remove(spark, f"{checkpoints}/{model}")
        groups: dict[tuple[str, ...], list[Entity]] = {}
        for e in entities_from({model: config[model]}):
            groups.setdefault(source_names(e), []).append(e)
        for names, entities in groups.items():
            kinds = _bound_kinds(names, samples, sample)
            binder = Binder(samples)
            bound = {e.name: binder.bind(e, kinds) for e in entities}
            found |= bound
            loader = EntityStream(store, [replace(b.entity, columns=b.fields) for b in bound.values()], kinds, metrics)
            run_batches(_united(names, streams), loader, f"{checkpoints}/{model}/{_folder(names)}")
        for edge in _relations(config, model, found):
            start, end = found[edge.start], found[edge.end]
            first, second = key_field(start), key_field(end)
            ends = tuple(source_column(f, start.typed.columns) for f in (first, second))
            loader = EdgeStream(store, label_text(edge.type), ends, ((edge.start, first.name), (edge.end, second.name)), start.kinds, edge.properties, start.entity.order, start.entity.filters, metrics)
            run_batches(_united(source_names(start.entity), streams), loader, f"{checkpoints}/{model}/edge/{_folder((edge.type,))}")
    _told(spark, config, root, only, metrics, strict, False)
    return stored_counts(spark, config, root, only)


def _folder(names: tuple[str, ...]) -> str:
    return "+".join(quote(n, safe="") for n in names)


def _united(names: tuple[str, ...], sources: dict[str, DataFrame]) -> DataFrame:
    if missing := [n for n in names if n not in sources]:
        raise MappingError(f"no source {missing}")
    return sources[names[0]] if len(names) == 1 else union_sources(sources[n] for n in names)


def _bound_kinds(names: tuple[str, ...], samples: dict[str, DataFrame], rows: int) -> dict[str, str]:
    """Kinds from the first rows of each source of a union; POSITION is no column of data."""
    kinds = sample_kinds(_united(names, {n: with_places(samples[n]) for n in names if n in samples}), rows)
    return {c: k for c, k in kinds.items() if c != POSITION} | {SOURCE: STRING}
