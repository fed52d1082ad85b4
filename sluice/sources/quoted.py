"""Delimited text whose quoted fields hold line breaks, read in parallel: where a record starts follows from how many quotes stand before."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

QUOTE = '"'
#: What a piece of text is: a whole record, the end of one that an earlier split began, all of a split within a record, or its start.
WHOLE, END, WITHIN, START = 0, 1, 2, 3
PIECES = "file string, block long, line long, kind int, text string"


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines as they stand, with the file and split that each is in."""
    return spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _quotes():
    return F.length("value") - F.length(F.replace("value", F.lit(QUOTE), F.lit("")))


def has_quoted_breaks(spark: SparkSession, path: str) -> bool:
    """Whether a line has an odd number of quotes."""
    return not text_lines(spark, path).where(_quotes() % 2 == 1).isEmpty()


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole records, and the pieces of those that go over the edges of splits. Lines come in order, split after split."""
    at, number, inside, held, first = None, 0, False, [], 0

    def rest() -> list[tuple]:
        if not inside or at is None:
            return []
        return [(*at, first if first >= 0 else 0, START if first >= 0 else WITHIN, "\n".join(held))]

    for b in batches:
        edges = np.flatnonzero((b["file"].to_numpy()[1:] != b["file"].to_numpy()[:-1]) | (b["block"].to_numpy()[1:] != b["block"].to_numpy()[:-1])) + 1
        for low, high in zip([0, *edges], [*edges, len(b)]):
            part = b.iloc[low:high]
            if part.empty:
                continue
            out, key = [], (part["file"].iloc[0], int(part["block"].iloc[0]))
            if key != at:
                out += rest()
                at, number, inside, held, first = key, 0, bool(part["odd"].iloc[0]), [], -1
            odd = part["value"].str.count(QUOTE).to_numpy() % 2
            before = (int(inside) + np.cumsum(odd) - odd) % 2
            whole = np.flatnonzero((before == 0) & (odd == 0))
            lines = part["value"].to_numpy()
            yield pd.DataFrame({"file": key[0], "block": key[1], "line": number + whole, "kind": WHOLE, "text": lines[whole]})
            for k in np.flatnonzero((before == 1) | (odd == 1)):
                if not before[k]:
                    held, first = [lines[k]], number + k
                else:
                    held.append(lines[k])
                    if odd[k]:
                        out.append((*key, max(first, 0), WHOLE if first >= 0 else END, "\n".join(held)))
                        held, first = [], -1
            inside = bool((before[-1] + odd[-1]) % 2)
            number += len(part)
            if out:
                yield pd.DataFrame(out, columns=["file", "block", "line", "kind", "text"])
    if last := rest():
        yield pd.DataFrame(last, columns=["file", "block", "line", "kind", "text"])


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line, text) of each record: the split and line that it starts in, and its text with its line breaks.

    Two passes over the text. The first counts the quotes of each split; the sum before a split tells whether it starts
    inside quotes (a row for each split of some 128 MB, which is broadcast). The second cuts every split by itself, in its
    own task. Of each split at most two pieces go over an edge; they are put together by file. A quote that is still
    open at the end of a file closes there. Quotes within unquoted fields count as quotes.
    """
    lines = text_lines(spark, path)
    counts = lines.groupBy("file", "block").agg((F.sum(_quotes()) % 2).alias("n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("file", "block", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) % 2 == 1).alias("odd"))
    pieces = lines.join(F.broadcast(starts), ["file", "block"]).select("file", "block", "odd", "value").mapInPandas(_pieces, PIECES)
    cut = pieces.where(F.col("kind") != WHOLE)
    number = F.sum((F.col("kind") == START).cast("int")).over(Window.partitionBy("file").orderBy("block", "kind"))
    joined = cut.withColumn("record", number).groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "kind", "line", "text"))).alias("pieces"))
    over = joined.select("file", F.col("pieces")[0]["block"].alias("block"), F.col("pieces")[0]["line"].alias("line"), F.array_join(F.col("pieces")["text"], "\n").alias("text"))
    found = pieces.where(F.col("kind") == WHOLE).select("file", "block", "line", "text").union(over)
    return found.withColumn("text", F.regexp_replace("text", "\\r$", "")).where("text <> ''")


def quoted_rows(spark: SparkSession, path: str, header: list[str], sep: str, position: str) -> DataFrame:
    """The records below each file's header as text columns, blank cells "", and their places in the last column."""
    schema = StructType([StructField(f"c{k}", StringType()) for k in range(len(header))])
    rows = records(spark, path).where("not (block = 0 and line = 0)")
    rows = rows.withColumn("cells", F.from_csv("text", schema.simpleString()[7:-1].replace(":", " "), {"sep": sep, "quote": QUOTE, "escape": QUOTE, "maxCharsPerColumn": "-1"}))
    place = F.struct(F.lit(0).alias("part"), F.col("file"), F.col("block"), F.col("line").alias("row")).alias(position)
    return rows.select(*(F.coalesce(F.col("cells")[f"c{k}"], F.lit("")).alias(c) for k, c in enumerate(header)), place)
