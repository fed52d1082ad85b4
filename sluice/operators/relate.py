"""Tables related to each other: reference checks, read-back of a graph, comparison of two arms."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class DanglingReference(ValueError):
    """Rows refer to keys that are not there."""


def orphans(child: DataFrame, foreign_key: str, parent: DataFrame, key: str | None = None) -> DataFrame:
    """Rows of child whose foreign key is not null and not a key of parent."""
    keys = parent.select(F.col(f"`{key or foreign_key}`").alias("_k"))
    return child.where(F.col(f"`{foreign_key}`").isNotNull()).join(keys, F.col(f"`{foreign_key}`") == F.col("_k"), "left_anti")


def reference_report(child: DataFrame, foreign_key: str, parent: DataFrame, key: str | None = None, name: str = "reference", labels: tuple[str, str] = ("child", "parent")) -> DataFrame:
    """One row: constraint, rows with a reference, orphans among them."""
    constraint = constraint_name(*labels, name)
    used = child.agg(F.count(F.col(f"`{foreign_key}`")).alias("references"), F.lit(0).cast("long").alias("orphans"))
    lost = orphans(child, foreign_key, parent, key).agg(F.lit(0).cast("long").alias("references"), F.count(F.lit(1)).alias("orphans"))
    return used.union(lost).agg(F.sum("references").alias("references"), F.sum("orphans").alias("orphans")).select(F.lit(constraint).alias("constraint"), "references", "orphans")


def constraint_name(child: str, parent: str, name: str) -> str:
    return f"{child}_{parent}_{name}_fk".replace("-", "_")


def constraint_report(tables: dict[str, DataFrame], references: Sequence[tuple[str, str, str, str, str]]) -> DataFrame:
    """(constraint, references, orphans) of all (child, foreign key, parent, key, name) at once.

    Each table is read once, its rows give an entry for each constraint that they are a child or a parent of; one
    aggregate over (constraint, key) tells how many rows refer to a key and whether it is there, so a key that very many
    rows refer to costs a row a task. Keys are compared as text; null ones refer to nothing.
    """
    entries: dict[str, list] = {n: [] for n in tables}
    for child, foreign_key, parent, key, name in references:
        constraint = F.lit(constraint_name(child, parent, name)).alias("constraint")
        for table, column, there in ((child, foreign_key, False), (parent, key, True)):
            entries[table].append(F.struct(constraint, F.col(f"`{column}`").cast("string").alias("key"), F.lit(there).alias("there")))
    parts = [tables[n].select(F.inline(F.array(*es))) for n, es in entries.items() if es]
    found = reduce(DataFrame.union, parts).where("key is not null")
    keys = found.groupBy("constraint", "key").agg(F.count_if(~F.col("there")).alias("n"), F.max("there").alias("there"))
    counted = keys.groupBy("constraint").agg(F.sum("n").alias("references"), F.sum(F.when(F.col("there"), 0).otherwise(F.col("n"))).alias("orphans"))
    names = counted.sparkSession.createDataFrame([(constraint_name(c, p, n),) for c, _, p, _, n in references], "constraint string")
    return names.join(counted, "constraint", "left").select("constraint", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("references", "orphans")))


def check_reference(child: DataFrame, foreign_key: str, parent: DataFrame, key: str | None = None) -> None:
    lost = orphans(child, foreign_key, parent, key).count()
    if lost:
        raise DanglingReference(f"{lost} rows have a {foreign_key} that is no {key or foreign_key}")


def graph_rows(edges: DataFrame, nodes_from: DataFrame, from_key: str, nodes_to: DataFrame, to_key: str) -> DataFrame:
    """(from, rel, to): each edge with the properties of both ends."""
    a = nodes_from.select(F.col(f"`{from_key}`").alias("src"), F.struct("*").alias("from"))
    b = nodes_to.select(F.col(f"`{to_key}`").alias("dst"), F.struct("*").alias("to"))
    rel = F.struct(*(c for c in edges.columns if c not in ("src", "dst"))).alias("rel")
    return edges.select("src", "dst", rel).join(a, "src").join(b, "dst").select("from", "rel", "to")


def two_arms(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, names: tuple[str, str]) -> DataFrame:
    """keys, the value of each arm, and the overhead of the left over the right in per cent; a missing arm is null."""
    a = left.select(*keys, F.col(value).alias(names[0]))
    b = right.select(*keys, F.col(value).alias(names[1]))
    over = F.when(F.col(names[1]) != 0, (F.col(names[0]) / F.col(names[1]) - 1) * 100)
    return a.join(b, list(keys), "full_outer").withColumn("overhead_pct", over)
