"""SimHash near-duplicates: fingerprints, sharded BK-trees, components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import jaccard
from .common import cut, table
from .components import connected_components

#: A bit block of each of the five parts that a 64-bit fingerprint is split into: (first bit, width).
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
RADIUS = 3
#: Nodes of one BK-tree at most; a larger shard is dealt as several trees.
TREE_NODES = 4096
#: Bits of a shard key below its slot, the number of the fingerprint among those of a text.
SLOT = 56


def fingerprints(text: str | None, number: int = 1, width: int = 3, step: int = 1 << 16) -> list[int]:
    """64-bit SimHashes of the word shingles, each repeat counted; 0 where there is no word.

    The first is over the shingles' hashes, the others over the same hashes mixed anew by an invertible function.
    """
    ones, total = np.zeros((number, 64), np.int64), 0
    for hashes in jaccard.shingle_hashes(text, width, step):
        total += len(hashes)
        for n in range(number):
            if n:
                hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
                hashes = hashes ^ (hashes >> np.uint64(32))
            ones[n] += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return [int.from_bytes(bits.tobytes(), "big") for bits in np.packbits(2 * ones > total, axis=1)]


def simhash(text: Column, number: int = 1) -> Column:
    """array<long> of a text's fingerprints."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([np.array(fingerprints(t, number), np.uint64).view(np.int64) for t in texts], dtype=object)

    return run(text)


class BKTree:
    """Burkhard-Keller tree over integers: a child hangs at its Hamming distance to the parent."""

    def __init__(self) -> None:
        self.root: tuple[int, dict] | None = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = (value, {})
            return
        node = self.root
        while d := (value ^ node[0]).bit_count():
            child = node[1].get(d)
            if child is None:
                node[1][d] = (value, {})
                return
            node = child

    def within(self, value: int, radius: int) -> Iterator[int]:
        """All values at most radius away; only edges from d - radius to d + radius are followed."""
        todo = [self.root] if self.root else []
        while todo:
            own, children = todo.pop()
            d = (value ^ own).bit_count()
            if d <= radius:
                yield own
            if children:
                todo += [child for edge, child in children.items() if d - radius <= edge <= d + radius]


class Links:
    """Union-find that keeps only the links of a spanning forest."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    def link(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.parent[x] = y
        return x != y


def cell_links(left: list[int], right: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """Spanning links between values at most radius apart: within left (right None), or from left's tree to right."""
    tree, seen, out = BKTree(), Links(), []
    if right is not None:
        for x in left:
            tree.add(x)
    for x in left if right is None else right:
        for y in tree.within(x, radius):
            if seen.link(x, y):
                out.append((x, y))
        if right is None:
            tree.add(x)
    return out


def _runs(batches: Iterable[pd.DataFrame]) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """Runs of equal (cell, p, q) of sorted batches, a run may cross batches: cell, p, q, parts, fingerprints."""
    rest = None
    for batch in batches:
        rows = batch[["cell", "p", "q", "part", "fp"]].to_numpy(np.int64)
        rows = rows if rest is None else np.concatenate([rest, rows])
        if not len(rows):
            continue
        starts = np.flatnonzero(np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)])
        for i, j in zip(starts[:-1], starts[1:]):
            yield *map(int, rows[i, :3]), rows[i:j, 3], rows[i:j, 4]
        rest = rows[starts[-1] :]
    if rest is not None and len(rest):
        yield *map(int, rest[0, :3]), rest[:, 3], rest[:, 4]


def _search(radius: int):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple[int, int, int]] = []
        for cell, p, q, parts, fps in _runs(batches):
            values = fps.view(np.uint64)
            left = values[parts == p].tolist()
            found = cell_links(left, None if p == q else values[parts == q].tolist(), radius)
            out += [(cell >> SLOT, a, b) for a, b in found]
            if len(out) > 50_000:
                yield _frame(out)
                out = []
        yield _frame(out)

    return run


def _frame(links: list[tuple[int, int, int]]) -> pd.DataFrame:
    return pd.DataFrame(np.array(links, np.uint64).reshape(-1, 3).view(np.int64), columns=["slot", "a", "b"])


def _shards(kept: int):
    """Keys of a fingerprint: one for each choice of `kept` blocks, of its slot, the choice's number and these blocks' bits."""
    bits = lambda s, w: F.shiftrightunsigned("fp", s).bitwiseAND((1 << w) - 1)
    keys = []
    for number, chosen in enumerate(combinations(BLOCKS, kept)):
        key = F.lit(number).cast("long")
        for start, width in chosen:
            key = F.shiftleft(key, width).bitwiseOR(bits(start, width))
        keys.append(F.shiftleft(F.col("slot").cast("long"), SLOT).bitwiseOR(key))
    return F.array(*keys)


def hamming_links(fps: DataFrame, radius: int = RADIUS, tree_nodes: int = TREE_NODES) -> DataFrame:
    """Spanning links (slot, a, b) of all pairs of the distinct (slot, fp) with one slot that differ in at most radius bits.

    Two values that differ in r bits agree in at least 5 - r of 5 blocks, so each is filed in one shard for each
    choice of 5 - r blocks and only shards with two members or more are searched. A shard's members form a
    BK-tree. A shard of more than tree_nodes members is dealt into several trees, and each pair of its parts is
    searched by its own cell: all pairs are met, no task holds more than two parts. Trees travel by shuffle to the
    tasks of their queries, as a broadcast of them would grow with the corpus. A cell emits the links of a
    spanning forest, not all of its pairs; they join the same fingerprints.
    """
    if not 0 < radius < len(BLOCKS):
        raise ValueError(f"radius must be 1 to {len(BLOCKS) - 1}")
    rows = fps.select(F.explode(_shards(len(BLOCKS) - radius)).alias("cell"), "fp")
    trees = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    trees = trees.select("cell", F.ceil(F.col("n") / tree_nodes).cast("int").alias("trees"))
    part = F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int")
    cells = (
        rows.join(trees, "cell")
        .withColumn("part", part)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)))
        .select("cell", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "fp")
    )
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.repartition(parts, "cell", "p", "q").sortWithinPartitions("cell", "p", "q")
    return dealt.mapInPandas(_search(radius), "slot long, a long, b long")


def near_groups(docs: DataFrame, text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fp (signed long), component_id, by one fingerprint.

    A null or blank text has fingerprint 0 and is linked like any other. Repeated rows and ids each give a row.
    component_id is the least non-null doc_id of the component, null if it has none.
    """
    own = cut(docs.select("doc_id", simhash(F.col(text))[0].alias("fp")), "fingerprints")
    distinct = own.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = connected_components(hamming_links(distinct.select(F.lit(0).alias("slot"), "fp"), radius).select("a", "b"))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return own.join(rooted.select("fp", "root").join(least, "root").drop("root"), "fp")


def near_dedup(docs: DataFrame, text: str = "text", radius: int = RADIUS) -> DataFrame:
    """The documents, one of each group: the row with the least doc_id, null ids last.

    Two documents are linked when their sets of five-word shingles have a Jaccard similarity of 0.8 or more; groups are
    what links connect. Candidates are what the BK-trees link by fingerprints of these shingles, and rows that share a
    MinHash band (jaccard.BANDS); only pairs whose similarity is computed and reaches 0.8 are linked.

    A text of one to four words is one shingle; null, empty and blank texts are all alike. Of repeated rows one stays;
    of rows that tie in doc_id, null ones too, the first in the table's order. Texts of any length count in whole; all
    columns are kept, whatever their names. An empty table gives no rows.
    """
    source = cut(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "near")
    rank = F.struct(F.col("doc.doc_id").isNull().alias("none"), "doc.doc_id", "row")
    own = cut(source.select("row", rank.alias("rank"), jaccard.sketch(F.col(f"doc.{text}")).alias("s")).select("row", "rank", "s.*"), "sketches")
    first = cut(own.groupBy("fp").agg(F.min("row").alias("first")), "values")  # one row stands for all with a value
    same = own.join(first, "fp").select(F.col("row").alias("a"), F.col("first").alias("b"))
    links = hamming_links(first.select(F.lit(0).alias("slot"), "fp"), radius)
    at = lambda end: first.select(F.col("fp").alias(end), F.col("first").alias(f"row_{end}"))
    near = links.join(at("a"), "a").join(at("b"), "b").select(F.col("row_a").alias("a"), F.col("row_b").alias("b"))
    linked = jaccard.similar(source.select("row", F.col(f"doc.{text}").alias("text")), own, same.union(near))
    roots = connected_components(linked)
    rooted = own.select("row", "rank").join(roots, own.row == roots.node, "left").select("rank", F.coalesce("root", "row").alias("root"))
    stay = rooted.groupBy("root").agg(F.min("rank").alias("rank")).select("rank.row")
    gone = cut(own.select("row").join(stay, "row", "left_anti"), "gone")  # written, so that Spark knows its size: texts move only if it is large
    return source.join(gone, "row", "left_anti").select("doc.*")


def op3_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component, over whole texts.

    Null and empty texts have the fingerprint zero and are linked like any other; equal texts have equal fingerprints and
    one component; repeated rows give a row each. Rows of a null id are linked by their texts, and component_id is the
    least id that is not null, null if there is none; an empty table gives no rows.
    """
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
