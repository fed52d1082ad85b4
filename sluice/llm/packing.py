"""Packing: pieces into sequences of a fixed window by non-negative least squares over lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, text_or_empty
from .tokens import MEMO, batches, blank_encoder

WINDOW = 4096
END = 2
#: Least number of salts that rows of one length are ranked by.
SALTS = 64
#: Entries of a worker's memo where packing is all that an executor does, some 360 MB; it has no bearing on the result.
OWN_MEMO = 1_000_000


def _pieces(path: str, window: int, end: int, memo: int):
    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = blank_encoder(path, memo)
        tail = end.to_bytes(2, "little")
        for frame in frames:
            out: dict[str, list] = {k: [] for k in ("at", "start", "length", "ids", "ids_crc32", "doc_tokens")}
            kept = (ids + tail for part in batches(frame["text"].tolist(), most=4096, chars=4 << 20) for ids in encode(part))
            for k, raw in enumerate(kept):
                total = len(raw) // 2
                for start in range(0, total, window):
                    ids = raw[2 * start : 2 * (start + window)]
                    wide = np.frombuffer(ids, "<u2").astype("<u4").tobytes()
                    for name, value in zip(out, (k, start, len(ids) // 2, ids, zlib.crc32(wide), total)):
                        out[name].append(value)
            done = pd.DataFrame(out)
            done.insert(0, "doc_id", frame["doc_id"].take(done.pop("at")).to_numpy() if len(done) else [])
            yield done

    return run


def tokenize(docs: DataFrame, path: str, text: str = "text", window: int = WINDOW, end: int = END, memo: int = MEMO) -> DataFrame:
    """Pieces of at most `window` ids: doc_id, start, length, ids (16-bit little-endian), ids_crc32, doc_tokens.

    Each document is its ids and one end id; null counts as empty. It is cut at multiples of the window only.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_or_empty(text).alias("text"))
    return rows.mapInPandas(_pieces(path, window, end, memo), f"doc_id {kind}, start long, length long, ids binary, ids_crc32 long, doc_tokens long")


def combinations(count: np.ndarray, window: int, depth: int = 8, triples: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Shallow combinations of present lengths that fill the window exactly.

    One length k times and a filler (k below depth), and triples of distinct lengths. Rows of (lengths, copies), up
    to three distinct lengths each; an unused place has length 0.
    """
    present = np.flatnonzero(count[:window])
    present = present[present > 0]
    found = []
    for k in range(1, depth):
        filler = window - k * present
        ok = (filler > 0) & (count[np.clip(filler, 0, window - 1)] > 0)
        if k == 1:
            ok &= present <= filler
        a, b = present[ok], filler[ok]
        found.append(np.stack([a, b, 0 * a, 0 * a + k, 0 * a + 1, 0 * a], axis=1))
    for t in range(triples):
        second = present[(np.arange(len(present)) * (2 * t + 3) + 7 * t) % max(1, len(present))] if len(present) else present
        third = window - present - second
        ok = (third > 0) & (count[np.clip(third, 0, window - 1)] > 0) & (present != second) & (third != present) & (third != second)
        a = present[ok]
        found.append(np.stack([a, second[ok], third[ok], 0 * a + 1, 0 * a + 1, 0 * a + 1], axis=1))
    rows = np.concatenate(found) if found else np.zeros((0, 6), np.int64)
    same = rows[:, 0] == rows[:, 1]  # a filler of the same length
    rows[same, 3] += rows[same, 4]
    rows[same, 1] = rows[same, 4] = 0
    return rows[:, :3], rows[:, 3:]


def solve(lengths: np.ndarray, copies: np.ndarray, count: np.ndarray, rounds: int = 300) -> np.ndarray:
    """x >= 0 that minimises |A x - count|^2, A the copies of each length: accelerated projected gradient."""
    if not len(lengths):
        return np.zeros(0)
    add = lambda x: np.bincount(lengths.ravel(), (copies * x[:, None]).ravel(), len(count))
    per = lambda r: (copies * r[lengths]).sum(axis=1)
    target = count.astype(float)
    target[0] = 0
    load = np.bincount(lengths.ravel(), (copies * copies.sum(axis=1, keepdims=True)).ravel(), len(count))
    step = 1 / np.maximum(1e-9, (copies * load[lengths]).sum(axis=1))  # a diagonal bound of A'A
    x = y = np.zeros(len(lengths))
    for k in range(rounds):
        residual = add(y) - target
        residual[0] = 0
        new = np.maximum(0, y - step * per(residual))
        y, x = new + k / (k + 3) * (new - x), new
    return x


def plan(count: np.ndarray, window: int = WINDOW) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns [(length, copies)] with their repeats that use up count[1..window] exactly."""
    rest = count.astype(np.int64).copy()
    out: list[tuple[list[tuple[int, int]], int]] = []
    if rest[window]:
        out.append(([(window, 1)], int(rest[window])))
        rest[window] = 0
    lengths, copies = combinations(rest, window)
    x = np.floor(solve(lengths, copies, rest[:window]) + 0.5).astype(np.int64)
    for j in np.argsort(-x, kind="stable"):
        if x[j] <= 0:
            break
        used = [(int(a), int(c)) for a, c in zip(lengths[j], copies[j]) if a and c]
        if (n := int(min([x[j], *(rest[a] // c for a, c in used)]))) > 0:
            out.append((used, n))
            for a, c in used:
                rest[a] -= n * c
    while len(left := np.flatnonzero(rest)):  # greedily: the longest that still fits, the whole pattern as often as it goes
        space, used, high = window, [], len(left)
        while space and (high := min(high, int(np.searchsorted(left, space, "right")))):
            a = int(left[high - 1])
            c = int(min(rest[a], space // a))
            used.append((a, c))
            space -= a * c
            high -= 1
        n = int(min(rest[a] // c for a, c in used))
        out.append((used, n))
        for a, c in used:
            rest[a] -= n * c
    return out


def most_intervals(window: int) -> int:
    """The most rows that intervals can give, whatever the input.

    A combination has at most three lengths, and there are at most 11 for each length; every greedy pattern uses up a
    length, so there are at most `window` of them, each of distinct lengths that together fit the window.
    """
    distinct = int((2 * window) ** 0.5) + 1
    return 1 + window * (11 * 3 + distinct)


def intervals(patterns: list[tuple[list[tuple[int, int]], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, from rank, to rank, copies, first sequence, offset): pieces of a length go by rank to sequences.

    One row for each length of a pattern: `copies` pieces that follow each other by rank lie side by side in a sequence.
    """
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for used, n in patterns:
        offset = 0
        for length, copies in used:
            low = rank.get(length, 0)
            rank[length] = low + n * copies
            rows.append((length, low, low + n * copies, copies, sequence, offset))
            offset += length * copies
        sequence += n
    return rows


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Pieces with sequence_id and offset; no sequence is longer than the window, offsets have no gaps.

    The histogram of lengths (at most `window` rows) is planned on the driver; the plan sends each piece to its place
    by its rank among the pieces of its length. Ranks are counted per salt and shifted by the counts of the salts
    before, so that a length which very many pieces have is not one task's.
    """
    spark = pieces.sparkSession
    salts = max(SALTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = cut(salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = np.zeros(window + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():
        histogram[length] = n
    rows = intervals(plan(histogram, window))
    if len(rows) > most_intervals(window):
        raise ValueError("a plan of more rows than lengths allow")
    names = ["length", "low", "high", "copies", "first", "base"]
    # an Arrow table becomes rows in the JVM; rows of Python objects would take Python workers of their own on the executors
    places = spark.createDataFrame(pa.table(dict(zip(names, np.array(rows, np.int64).reshape(-1, len(names)).T))))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    shifts = counts.select("length", "_salt", F.coalesce(before, F.lit(0)).alias("_shift"))
    rank = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")) - 1
    ranked = salted.withColumn("_rank", rank).join(shifts, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_shift"))
    # the plan's rows are bounded by the window alone, whatever the input: it may be broadcast
    placed = ranked.join(F.broadcast(places), (ranked["length"] == places["length"]) & (F.col("_rank") >= F.col("low")) & (F.col("_rank") < F.col("high")))
    k = F.col("_rank") - F.col("low")
    sequence, place = F.col("first") + F.expr("(_rank - low) div copies"), F.col("base") + k % F.col("copies") * places["length"]
    return placed.select(*(ranked[c] for c in pieces.columns), sequence.alias("sequence_id"), place.alias("offset"))


def packed(docs: DataFrame, path: str, text: str = "text", window: int = WINDOW, memo: int = MEMO) -> DataFrame:
    """Tokenize and pack; pieces with their ids. The pieces are written once, as two passes read them."""
    return pack(cut(tokenize(docs, path, text, window, memo=memo), "pieces"), window)


def op10_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts are empty documents of one id; repeated rows and ids are packed each on their own."""
    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), memo=OWN_MEMO).drop("ids")
