"""Pairs of texts whose sets of five-word shingles are alike: MinHash bands for candidates, exact similarity to confirm."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut
from .components import connected_components

#: Words of a shingle.
WIDTH = 5
#: Linked is what has intersection / union of at least this fraction.
LEAST = (4, 5)
#: Bands and minima in each. A pair of similarity s shares one with chance 1 - (1 - s^ROWS)^BANDS: 0.9996 at 0.8.
BANDS, ROWS = 20, 5
#: Minima of a text, the first for its bands; the last bit of each goes to its sketch of BITS / 64 longs.
BITS = 320
#: Bits in which the sketches of a pair at 0.8 differ are (1 - 0.8) / 2 of BITS on average, 32, with a deviation of
#: 5.4. A pair that differs in more than this, six deviations above, is not compared.
FAR = 64
#: Rows of a band that all its rows are compared with first.
LEADERS = 4
#: Rows that are compared with others together, and shingles of theirs: more of either become several cells.
HEADS, HEAD_SHINGLES = 64, 1 << 20
#: Rows that one cell's heads are compared with in a run.
RUN_ROWS = 4096
#: Rows, and shingles of theirs, of a block of a band's rows: a band of more is dealt as several blocks.
BLOCK, BLOCK_SHINGLES = 4096, 1 << 21

_FACTORS = np.array([xxhash.xxh32_intdigest(str(i), 1) | 1 for i in range(BITS)], np.uint32)[:, None]
_SHIFTS = np.array([xxhash.xxh32_intdigest(str(i), 2) for i in range(BITS)], np.uint32)[:, None]


def shingle_hashes(text: str | None, width: int, step: int = 1 << 16) -> Iterator[np.ndarray]:
    """Hashes of the word shingles, repeats too, at most step at a time; nothing where there is no word."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: lowers A-Z, splits at the six blanks
    if not words:
        return
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: max(1, len(words) - width + 1)]
    ends = ends[-len(starts) :]
    for k in range(0, len(starts), step):
        yield np.array([xxhash.xxh64_intdigest(joined[i:j], 42) for i, j in zip(starts[k : k + step].tolist(), ends[k : k + step].tolist())], np.uint64)


def fold(parts: list[np.ndarray]) -> int:
    """The first fingerprint of hashes that are at hand."""
    ones, total = np.zeros(64, np.int64), 0
    for hashes in parts:
        total += len(hashes)
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a text without words has the one hash 0."""
    parts = list(shingle_hashes(text, WIDTH))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(1, np.uint64)


def minima(shingles: np.ndarray, step: int = 1024) -> np.ndarray:
    """The least value of each of BITS hash functions over a set."""
    least = np.full(BITS, np.iinfo(np.uint32).max, np.uint32)
    high = (shingles >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(high), step):
        least = np.minimum(least, (high[k : k + step] * _FACTORS + _SHIFTS).min(axis=1))
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """A key for each band of the minima, equal where all minima of the band are."""
    return np.array([xxhash.xxh64_intdigest(band.tobytes(), n) for n, band in enumerate(least[: BANDS * ROWS].reshape(BANDS, ROWS))], np.uint64)


def bits(least: np.ndarray) -> np.ndarray:
    """The sketch: one bit of each of the minima, mixed before, as the least of many values is mostly small."""
    mixed = least * np.uint32(0x9E3779B1)
    return np.packbits((mixed ^ (mixed >> np.uint32(16))) & np.uint32(1)).view(">i8").astype(np.int64)


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets' Jaccard similarity is LEAST or more."""
    over, under = LEAST
    if under * min(len(x), len(y)) < over * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return under * both >= over * (len(x) + len(y) - both)


def sketch(text: Column) -> Column:
    """struct of a text's fingerprint over five-word shingles, the size of its set, its band keys and its bits in longs b0, b1, ..."""
    out = T.StructType().add("fp", T.LongType()).add("size", T.IntegerType()).add("bands", T.ArrayType(T.LongType()))

    @F.pandas_udf(reduce(lambda t, k: t.add(f"b{k}", T.LongType()), range(BITS // 64), out))
    def run(texts: pd.Series) -> pd.DataFrame:
        fps, sizes, keys, sketches = [], [], [], []
        for t in texts:
            parts = list(shingle_hashes(t, WIDTH))
            own = np.unique(np.concatenate(parts)) if parts else np.zeros(1, np.uint64)
            least = minima(own)
            fps.append(fold(parts))
            sizes.append(len(own))
            keys.append(bands(least).view(np.int64))
            sketches.append(bits(least))
        found = {"fp": np.array(fps, np.uint64).view(np.int64), "size": np.array(sizes, np.int32), "bands": keys}
        return pd.DataFrame(found | {f"b{k}": column for k, column in enumerate(np.array(sketches, np.int64).reshape(-1, BITS // 64).T)})

    return run(text)


def _compare(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (c, part, run, row, heads, text) sorted by cell: a cell's heads, with null heads, and then rows to compare with those listed."""
    cell, own = None, {}
    for batch in batches:
        out = []
        for c, part, run, row, heads, text in zip(*(batch[n] for n in ("c", "part", "run", "row", "heads", "text"))):
            if (c, part, run) != cell:
                cell, own = (c, part, run), {}
            shingles = shingle_set(text)
            if heads is None:
                own[row] = shingles
            else:
                out += [(a, row) for a in heads if alike(own[a], shingles)]
        yield pd.DataFrame(np.array(out, np.int64).reshape(-1, 2), columns=["a", "b"])


def confirm(texts: DataFrame, sizes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of rows whose texts are alike. texts: (row, text); sizes: (row, size); pairs: (a, b, band), each once.

    The first rows of pairs, the heads, are put into cells by the least band that they were found in, so that heads with
    the same partners meet; a cell has about HEADS of them. Each partner's text goes to a cell once, however many of its
    heads it is compared with. A cell with very many partners is split into runs, each with all its heads.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heads = pairs.groupBy(F.col("a").alias("row")).agg(F.min("band").alias("c")).select("row", F.coalesce("c", F.xxhash64("row")).alias("c")).join(sizes.hint("merge"), "row")
    fit = F.ceil(F.greatest(F.count(F.lit(1)) / HEADS, F.sum("size") / HEAD_SHINGLES)).cast("int")
    dealt = cut(heads.join(heads.groupBy("c").agg(fit.alias("parts")), "c").select("row", "c", F.pmod(F.xxhash64("row"), "parts").cast("int").alias("part")), "heads")
    met = pairs.join(dealt, pairs.a == dealt.row).groupBy("c", "part", "b").agg(F.collect_list("a").alias("heads"))
    met = cut(met.withColumnRenamed("b", "row"), "cells")
    runs = met.groupBy("c", "part").agg(F.ceil(F.count(F.lit(1)) / RUN_ROWS).cast("int").alias("runs"))
    columns = ("c", "part", "run", "row", "heads")
    rows = met.join(runs, ["c", "part"]).withColumn("run", F.pmod(F.xxhash64("row"), "runs").cast("int")).select(*columns)
    first = dealt.join(runs, ["c", "part"]).withColumn("run", F.explode(F.sequence(F.lit(0), F.col("runs") - 1))).withColumn("heads", F.lit(None).cast("array<bigint>"))
    every = rows.union(first.select(*columns)).join(texts.hint("merge"), "row")
    placed = every.repartition(parts, "c", "part", "run").sortWithinPartitions("c", "part", "run", F.col("heads").isNotNull())
    return placed.mapInPandas(_compare, "a long, b long")


def _cells(batches: Iterable[pd.DataFrame]) -> Iterator[tuple[int, int, int, pd.DataFrame]]:
    """Cells (band, p, q) of sorted batches, each whole: a cell may cross batches."""
    rest = None
    for batch in batches:
        rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if len(rest):
            cell = rest[["band", "p", "q"]].to_numpy(np.int64)
            starts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]).any(axis=1)])
            for i, j in zip(starts[:-1], starts[1:]):
                yield *map(int, cell[i]), rest.iloc[i:j]
            rest = rest.iloc[starts[-1] :]
    if rest is not None and len(rest):
        yield *(int(rest[n].iloc[0]) for n in ("band", "p", "q")), rest


def block_links(band: int, own: pd.DataFrame, p: int, q: int) -> Iterator[tuple[int, int]]:
    """Links between the rows of part p and those of part q (within one part if they are the same) of one band.

    Two rows are compared if they are not connected yet, neither by their roots nor by links found here, if their sizes
    and sketches allow it, and if this is the first band that they share: in any earlier one they are compared as well.
    """
    over, under = LEAST
    row, size, part = (own[n].to_numpy(np.int64) for n in ("row", "size", "part"))
    bit = own[[f"b{k}" for k in range(BITS // 64)]].to_numpy(np.int64).view(np.uint64)
    keys = np.stack(own["bands"].to_numpy()).astype(np.int64)
    place = int(np.argmax(keys[0] == band)) if (keys[0] == band).any() else 0
    names, root = np.unique(own["root"].to_numpy(np.int64), return_inverse=True)
    sets: dict[int, np.ndarray] = {}

    def of(k: int) -> np.ndarray:
        if k not in sets:
            sets[k] = shingle_set(own["text"].iloc[k])
        return sets[k]

    right = np.flatnonzero(part == q)
    for x in np.flatnonzero(part == p):
        ys = right[right > x] if p == q else right
        ys = ys[(root[ys] != root[x]) & (under * np.minimum(size[ys], size[x]) >= over * np.maximum(size[ys], size[x]))]
        ys = ys[(np.bitwise_count(bit[ys] ^ bit[x]).sum(axis=1) <= FAR) & ~(keys[ys, :place] == keys[x, :place]).any(axis=1)]
        for y in ys:
            if root[y] != root[x] and alike(of(x), of(y)):
                root[root == root[y]] = root[x]
                yield int(row[x]), int(row[y])


def _search(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for band, p, q, own in _cells(batches):
        yield pd.DataFrame(np.array(list(block_links(band, own, p, q)), np.int64).reshape(-1, 2), columns=["a", "b"])


def _may_be_alike(a: str, b: str) -> Column:
    """Whether two rows (struct<row, size, b0, ...>) can reach the threshold by their sizes, and do not miss it by far in their sketches."""
    over, under = LEAST
    far = reduce(Column.__add__, (F.bit_count(F.col(f"{a}.b{k}").bitwiseXOR(F.col(f"{b}.b{k}"))) for k in range(BITS // 64)))
    sizes = [F.col(f"{x}.size") for x in (a, b)]
    return (F.col(f"{a}.row") != F.col(f"{b}.row")) & (under * F.least(*sizes) >= over * F.greatest(*sizes)) & (far <= FAR)


def _ordered(pairs: DataFrame) -> DataFrame:
    """(a, b, band) with a below b, each pair once."""
    return pairs.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("band").alias("band"))


def similar(texts: DataFrame, sketches: DataFrame, more: DataFrame) -> DataFrame:
    """Links (a, b) that connect all candidate pairs with a similarity of 0.8 or more, and no others.

    texts: (row, text); sketches: (row, size, bands, b0, ...); more: (a, b), further candidates. Candidates are all pairs
    that share a band. Each band's rows are first compared with its LEADERS least rows only. The rows of bands that are
    not connected then are dealt into blocks, and all pairs of blocks are met, each by its own task (_search): no pair is
    written down that is not a link. Pairs whose sketches are far apart are not compared. Joins are all by shuffle, as
    each side grows with the corpus; texts that share no band move in none.
    """
    parts, more = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), more.where("a <> b")
    attributes = ("size", *(f"b{k}" for k in range(BITS // 64)))
    keys = sketches.select("row", F.explode("bands").alias("band"))
    several = keys.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band")
    own = sketches.select("row", F.struct("row", *attributes).alias("x"))
    shared = cut(keys.join(several.hint("merge"), "band").join(own.hint("merge"), "row").select("band", "x"), "bands")
    met = shared.select("x.row").union(more.select("a")).union(more.select("b")).distinct()
    texts = cut(texts.join(cut(met, "met"), "row", "left_semi"), "texts")
    rank = F.row_number().over(Window.partitionBy("band").orderBy("x.row"))
    leaders = shared.withColumn("rank", rank).where(F.col("rank") <= LEADERS).select("band", F.col("x").alias("y"))
    stars = shared.join(leaders.hint("merge"), "band").where(_may_be_alike("x", "y")).select(F.col("x.row").alias("a"), F.col("y.row").alias("b"), "band")
    pairs = cut(_ordered(stars.unionByName(more.withColumn("band", F.lit(None).cast("long")))), "stars")
    roots = connected_components(confirm(texts, sketches.select("row", "size"), pairs))
    rooted = shared.select("band", "x.row", "x.size").join(roots, F.col("row") == roots.node, "left").select("band", "row", "size", F.coalesce("root", "row").alias("root"))
    rooted = cut(rooted, "rooted")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("size") / BLOCK_SHINGLES)).cast("int")
    mixed = rooted.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n"), blocks.alias("blocks"))
    mixed = mixed.where(f"lo <> hi and n > {LEADERS + 1}").select("band", "blocks")
    open_ = rooted.drop("size").join(mixed, "band").withColumn("part", F.pmod(F.xxhash64("row"), "blocks").cast("int"))
    open_ = open_.join(sketches.select("row", "bands", *attributes).hint("merge"), "row").join(texts.hint("merge"), "row")
    open_ = open_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"p": F.least("part", "other"), "q": F.greatest("part", "other")})
    cells = open_.select("band", "p", "q", "part", "row", "root", "bands", *attributes, "text").repartition(parts, "band", "p", "q").sortWithinPartitions("band", "p", "q")
    return roots.toDF("a", "b").union(cells.mapInPandas(_search, "a long, b long"))
