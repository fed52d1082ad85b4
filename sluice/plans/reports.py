"""Counts of a plan, phase metrics, and medians over benchmark runs."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.casts import RESCUED
from ..functions.text import ratio
from ..operators.filters import PARTITION
from ..operators.relate import two_arms

#: The phase that reports leave out (fixed value).
LEFT_OUT = "filter"
METRICS = "target string, entity string, phase string, partition string, rows long, seconds double"


def plan_counts(parts: Iterable[tuple[str, str, DataFrame]]) -> DataFrame:
    """(target, entity, partition, rows) that a load would write; parts are (target, entity, rows with _partition)."""
    counted = [
        df.groupBy(F.col(PARTITION).alias("partition")).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(t).alias("target"), F.lit(e).alias("entity"), "partition", "rows")
        for t, e, df in parts
    ]
    return reduce(DataFrame.unionByName, counted)


def empty_ones(counts: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Entities that have no row at all."""
    names = counts.sparkSession.createDataFrame([(e,) for e in expected], "entity string")
    return names.join(counts.where("rows > 0"), "entity", "left_anti")


@dataclass
class Metrics:
    """Rows and seconds of each phase of a load, counted by the load's own jobs.

    The phase filter has the rows that a target's filters let through, and rescue those of them with a cell that does not
    fit its kind; write has what was written, in all with the seconds of the whole, and for each partition.
    """

    rows: list[tuple[str, str, str, str | None, int, float | None]] = field(default_factory=list)

    def measured(self, target: str, entity: str, phase: str, df: DataFrame, action: Callable[[DataFrame], object]) -> int:
        """Run an action on df; its rows are counted on the way, without another pass."""
        seen = Observation(f"{target}-{entity}-{phase}-{uuid.uuid4().hex}")
        began = time.perf_counter()
        action(df.observe(seen, F.count(F.lit(1)).alias("rows")))
        n = int(seen.get["rows"])
        self.rows.append((target, entity, phase, None, n, time.perf_counter() - began))
        return n

    def stored(self, store, target: str, entity: str, rows: DataFrame, put: Callable[[DataFrame], str | None]) -> int:
        """Run put on filtered rows that have _rescued; how many of them hold a cell that does not fit.

        put returns the folder that it has written, of which the footers tell the rows of each partition.
        """
        seen = Observation(f"{target}-{entity}-{uuid.uuid4().hex}")
        began = time.perf_counter()
        folder = put(rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.size(RESCUED) > 0).alias("lost")))
        took = time.perf_counter() - began
        if folder is None:  # the batch was stored before, nothing has run
            return 0
        counted = {} if seen._jo.get().isEmpty() else seen.get  # nothing is observed where the planner finds that there are no rows
        found, lost = int(counted.get("rows") or 0), int(counted.get("lost") or 0)
        self.rows += [(target, entity, "filter", None, found, None), (target, entity, "rescue", None, lost, None)]
        parts = [(r["partition"], r["rows"]) for r in store.written(folder).collect()]
        self.rows.append((target, entity, "write", None, sum(n for _, n in parts), took))
        self.rows += [(target, entity, "write", p, n, None) for p, n in parts]
        return lost

    def total(self, target: str, entity: str, phase: str) -> int:
        return sum(n for t, e, p, part, n, _ in self.rows if (t, e, p, part) == (target, entity, phase, None))

    def frame(self, spark: SparkSession) -> DataFrame:
        return with_rate(spark.createDataFrame(self.rows, METRICS))


def with_rate(df: DataFrame) -> DataFrame:
    return df.withColumn("rows_per_s", ratio(F.col("rows"), F.col("seconds")))


def medians(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Median seconds and peak, largest rows and rate for each key over repetitions, without the filter phase; null peaks do not count."""
    out = runs.where(F.col("phase") != LEFT_OUT).groupBy(*keys).agg(F.median("seconds").alias("seconds"), F.median("peak").alias("peak"), F.max("rows").alias("rows"))
    return with_rate(out)


def run_totals(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Seconds of each run over the phases that reports have."""
    return runs.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("phase") != LEFT_OUT, F.col("seconds"))), F.lit(0.0)).alias("seconds"))


def overhead(traced: DataFrame, untraced: DataFrame, keys: Sequence[str], run: str) -> DataFrame:
    """Median run totals of two arms side by side, and what the first costs over the second in per cent."""
    total = lambda df: run_totals(df, [*keys, run]).groupBy(*keys).agg(F.median("seconds").alias("seconds"))
    return two_arms(total(traced), total(untraced), keys, "seconds", ("traced", "untraced"))
