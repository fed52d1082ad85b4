"""Scans, origins, slices, unions and samples of named sources."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .quoted import has_quoted_breaks, quoted_rows

SOURCE, POSITION = "_source", "_pos"


class SourceError(ValueError):
    """A source does not have the shape that its declaration needs."""


def read_text(spark: SparkSession, path: str, sep: str = ",", multiline: bool = False, position: bool = False) -> DataFrame:
    """A delimited file with a header, every column text and blank cells "".

    multiline allows line breaks inside quotes and makes each file one task; read_any reads such files in parallel. position
    adds _pos, the place of a row in the file order, for first-wins and last-wins rules.
    """
    df = spark.read.csv(path, header=True, sep=sep, escape='"', inferSchema=False, multiLine=multiline, enforceSchema=False)
    header = spark.read.csv(path, header=False, sep=sep, escape='"', inferSchema=False).first() or ()
    if len(set(header)) < len(header):  # Spark would number them
        raise SourceError(f"{path}: a column name occurs twice")
    out = [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns]
    return with_places(df.select(*out)) if position else df.select(*out)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, JSON lines, TSV or CSV by the name's ending; columns as text.

    Text with line breaks inside quotes, which one pass over its lines finds out, is read with the rows' places in _pos.
    """
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "parquet":
        return as_text(spark.read.parquet(path))
    if kind in ("json", "jsonl"):
        return as_text(spark.read.json(path))
    sep = "\t" if kind == "tsv" else ","
    plain = read_text(spark, path, sep)
    return quoted_rows(spark, path, plain.columns, sep, POSITION) if has_quoted_breaks(spark, path) else plain


def _place(file: Column, block: Column) -> Column:
    """The place of a row in file order; part is its source's number in a union."""
    return F.struct(F.lit(0).alias("part"), file.alias("file"), block.alias("block"), F.monotonically_increasing_id().alias("row"))


def with_places(df: DataFrame) -> DataFrame:
    """The rows with _pos: their places in the files that they come from, or their order where they come from no files."""
    if POSITION in df.columns:
        return df
    try:
        return df.withColumn(POSITION, _place(F.col("_metadata.file_path"), F.col("_metadata.file_block_start")))
    except AnalysisException:
        return df.withColumn(POSITION, _place(F.lit(""), F.lit(0).cast("long")))


def as_text(df: DataFrame) -> DataFrame:
    """All columns as text, null as ""."""
    return df.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns))


def tagged(df: DataFrame, name: str) -> DataFrame:
    """A source of its own: each row carries the source's name, in the last column."""
    return df.withColumn(SOURCE, F.lit(name))


def combined(df: DataFrame, origin: str | None = None) -> DataFrame:
    """A source whose column (the first, unless named) tells each row's origin; it becomes _source, in the last place."""
    origin = origin or df.columns[0]
    rest = [c for c in df.columns if c != origin]
    if not [c for c in rest if c != POSITION]:
        raise SourceError("a combined source needs an origin and at least one more column")
    return df.select(*(F.col(f"`{c}`") for c in rest), F.col(f"`{origin}`").cast("string").alias(SOURCE))


def check_origins(df: DataFrame) -> None:
    """Every row must have an origin that is not blank."""
    if not df.where(~F.coalesce(F.col(SOURCE), F.lit("")).rlike(r"\S")).isEmpty():
        raise SourceError("a row has a blank origin")


def slice_of(df: DataFrame, origin: str) -> DataFrame:
    return df.where(F.col(SOURCE) == origin)


def origins(df: DataFrame) -> DataFrame:
    """The distinct origins, sorted."""
    return df.select(SOURCE).distinct().orderBy(SOURCE)


def origin_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(SOURCE).agg(F.count(F.lit(1)).alias("rows"))


def missing_origins(df: DataFrame, wanted: Iterable[str]) -> DataFrame:
    """The wanted origins that no row has."""
    names = df.sparkSession.createDataFrame([(w,) for w in wanted], f"{SOURCE} string")
    return names.join(df.select(SOURCE).distinct(), SOURCE, "left_anti")


def resolved(name: str, spec, overrides: dict | None = None, base: str | None = None):
    """What a source is read from: an override as it stands, else what is declared, a relative path from the folder `base`."""
    if name in (overrides or {}):
        return overrides[name]
    file = spec["file"] if isinstance(spec, dict) else spec
    absolute = not isinstance(file, str) or file.startswith("/") or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", file)
    return file if base is None or absolute else f"{base.rstrip('/')}/{file}"


def load_sources(spark: SparkSession, declared: dict, overrides: dict | None = None, base: str | None = None) -> dict[str, DataFrame]:
    """name -> table for a declaration name -> path, DataFrame, or {"file": path or DataFrame, "origin_column": True}.

    A combined source gives the whole under its own name and a slice under each origin; slices are filters, not
    copies. All names must differ. An override replaces the path of a declared name. Relative declared paths are taken
    from `base`, the configuration's folder, where it is given.
    """
    overrides = overrides or {}
    if unknown := set(overrides) - set(declared):
        raise SourceError(f"override of an undeclared source: {sorted(unknown)}")
    out: dict[str, DataFrame] = {}

    def put(name: str, df: DataFrame) -> None:
        if name in out:
            raise SourceError(f"two sources are named {name}")
        out[name] = df

    for name, spec in declared.items():
        whole = isinstance(spec, dict) and bool(spec.get("origin_column"))
        file = resolved(name, spec, overrides, base)
        df = as_text(file) if isinstance(file, DataFrame) else read_any(spark, file)
        if not whole:
            put(name, tagged(df, name))
            continue
        df = combined(df)
        check_origins(df)
        put(name, df)
        for r in origins(df).collect():  # names of sources, one row for each
            put(r[SOURCE], slice_of(df, r[SOURCE]))
    return out


def union_sources(parts: Iterable[DataFrame]) -> DataFrame:
    """All rows over the first-seen superset of the columns, missing cells "", _source last.

    Rows keep their places if all parts have them, those of an earlier part before those of a later one.
    """
    parts = list(parts)
    if not parts:
        raise SourceError("a union needs at least one source")
    if all(POSITION in p.columns for p in parts):
        parts = [p.withColumn(POSITION, F.col(POSITION).withField("part", F.lit(k))) for k, p in enumerate(parts)]
    else:
        parts = [p.drop(POSITION) for p in parts]
    wide = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    data = [c for c in wide.columns if c not in (SOURCE, POSITION)]
    tail = [c for c in (POSITION, SOURCE) if c in wide.columns]
    return wide.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in data), *tail)


def _first_runs(df: DataFrame, n: int) -> DataFrame:
    """The rows of each origin up to the run that its n-th one is in, by _pos: at most 2n rows of an origin.

    A run is n row numbers of a block. One pass counts the rows of each run (a row for each n rows of input), the sum
    before a run tells whether it is needed, and a second pass leaves out what comes after the last one of its origin.
    The rows must have the same places in both passes, as those of files have.
    """
    run = F.struct(F.col(POSITION)["part"].alias("part"), F.col(POSITION)["file"].alias("file"), F.col(POSITION)["block"].alias("block"), F.floor(F.col(POSITION)["row"] / n).alias("run"))
    counts = df.groupBy(F.col(SOURCE).alias("_origin"), run.alias("_run")).agg(F.count(F.lit(1)).alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("_origin").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1))
    last = counts.withColumn("before", before).where(F.coalesce("before", F.lit(0)) < n).groupBy("_origin").agg(F.max("_run").alias("_last"))
    return df.join(F.broadcast(last), (F.col(SOURCE).eqNullSafe(F.col("_origin"))) & (run <= F.col("_last"))).select(*(F.col(f"`{c}`") for c in df.columns))


def sample_per_source(df: DataFrame, n: int, order: str | list[str]) -> DataFrame:
    """The first n rows of each origin.

    In the order of places, rows that cannot be among them are left out before any is shuffled. In other orders ranks
    beyond n are cut in each task before the shuffle, where n is at most Spark's windowGroupLimitThreshold (1,000).
    """
    order = [order] if isinstance(order, str) else order
    if order == [POSITION]:
        df = _first_runs(df, n)
    by = Window.partitionBy(SOURCE).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(by)).where(F.col("_rank") <= n).drop("_rank")
