"""Hard-negative mining: exact integer scores by Four-Russians table lookups over packed bit planes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Dimensions of a group: a byte of a bit plane selects one of 256 subset sums.
GROUP = 8
#: Anchors and candidates that meet in one cell of the grid of blocks.
ANCHORS, CANDIDATES = 1024, 2048
#: Candidates whose looked-up rows are added at a time.
STRIP = 256
POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these shares of the positive's, in per cent.
LEAST, MOST = 30, 90

PACKED = "row long, vec_id long, label int, dims int, planes binary"
FOUND = "row long, slot int, found_id long, score long"


def quantised(rows: DataFrame) -> DataFrame:
    """(vec_id, label, q array<long>) of the rows that take part; see mine for which."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("int")
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * 256))
    whole = rows.where("vec_id is not null and label is not null and embedding is not null").where(~F.exists(F.col("embedding").cast("array<double>"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    norm = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + F.pow(F.floor(x * 256).cast("double"), 2) + F.pow(x * 256, 2))
    return whole.where(norm < 2.0**62).select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), scaled.alias("q"))


def pack(q: np.ndarray, bits: int) -> np.ndarray:
    """(rows, bits, groups) bytes: bit j of a plane's byte g is that plane's bit of component 8 g + j, in two's complement."""
    n, d = q.shape
    padded = np.zeros((n, -(-d // GROUP) * GROUP), np.int64)
    padded[:, :d] = q
    return np.stack([np.packbits(((padded >> p) & 1).astype(np.uint8).reshape(n, -1, GROUP), axis=2, bitorder="little")[:, :, 0] for p in range(bits)], axis=1)


def unpack(planes: np.ndarray) -> np.ndarray:
    """(rows, 8 groups) components of packed planes; the last plane is the sign's."""
    bits = np.unpackbits(planes, axis=2, bitorder="little").astype(np.int64)
    weights = _weights(planes.shape[1])
    return np.einsum("p,npd->nd", weights, bits)


def _weights(bits: int) -> np.ndarray:
    return np.array([*(1 << p for p in range(bits - 1)), -(1 << (bits - 1))], np.int64)


def subset_sums(q: np.ndarray) -> Iterator[np.ndarray]:
    """For each group the (256, anchors) sums of every subset of the anchors' eight components."""
    for g in range(q.shape[1] // GROUP):
        sums = np.zeros((1, q.shape[0]), np.int64)
        for j in range(GROUP):
            sums = np.concatenate([sums, sums + q[:, g * GROUP + j]])
        yield sums


def scores(anchors: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(candidates, anchors) inner products: for each group and plane, the candidates' bytes select rows of the shifted table, which are added up."""
    n, bits, _ = planes.shape
    out = np.zeros((n, anchors.shape[0]), np.int64)
    for g, sums in enumerate(subset_sums(anchors)):
        for p, w in enumerate(_weights(bits)):
            shifted = sums * w
            for k in range(0, n, STRIP):
                out[k : k + STRIP] += shifted[planes[k : k + STRIP, p, g]]
    return out


def _planes(found: pd.DataFrame, bits: int) -> np.ndarray:
    return np.frombuffer(b"".join(found["planes"]), np.uint8).reshape(len(found), bits, -1)


def _first(score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the first `most` by score, ties by id."""
    if len(score) > most:
        near = np.flatnonzero(score >= -np.partition(-score, most - 1)[most - 1])
    else:
        near = np.arange(len(score))
    return near[np.lexsort((ids[near], -score[near]))][:most]


def index(rows: DataFrame) -> tuple[DataFrame, int]:
    """The packed candidates (PACKED), stored in the shared folder, and the number of their planes."""
    base = quantised(rows)
    (most,) = base.agg(F.max(F.array_max(F.transform("q", lambda x: F.greatest(x, -x - 1))))).first()
    bits = int(most or 0).bit_length() + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            dims = b["q"].map(len)
            for d, part in b.groupby(dims, sort=False):
                packed = pack(np.array([np.asarray(x, np.int64) for x in part["q"]]).reshape(len(part), d), bits)
                yield pd.DataFrame({"row": part["row"], "vec_id": part["vec_id"], "label": part["label"], "dims": d, "planes": [p.tobytes() for p in packed]})

    return cut(base.withColumn("row", F.monotonically_increasing_id()).mapInPandas(run, PACKED), "vectors"), bits


def _grid(anchors: DataFrame, candidates: DataFrame, by: list[str], run) -> DataFrame:
    """FOUND rows of run(anchors, candidates) for each cell of blocks among the rows that agree in `by`.

    Blocks are cut by a hash of the row's number, a hot label's too; each anchor goes to all candidate blocks of its
    group and each candidate to all anchor blocks, so a cell is bounded and no pair is ever a row.
    """
    anchors = anchors.toDF(*anchors.columns)  # both sides come from one table
    sizes = candidates.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    asked = anchors.groupBy(*by).agg(F.count(F.lit(1)).alias("m"))
    blocks = asked.join(sizes, by).select(*by, F.ceil(F.col("n") / CANDIDATES).cast("int").alias("cs"), F.ceil(F.col("m") / ANCHORS).cast("int").alias("as"))
    place = lambda size: F.pmod(F.xxhash64("row"), F.col(size)).cast("int")
    every = lambda size: F.explode(F.sequence(F.lit(0), F.col(size) - 1))
    left = anchors.join(blocks, by).withColumn("a", place("as")).withColumn("c", every("cs")).drop("cs", "as")
    right = candidates.join(blocks, by).withColumn("c", place("cs")).withColumn("a", every("as")).drop("cs", "as")
    return left.groupBy(*by, "a", "c").cogroup(right.groupBy(*by, "a", "c")).applyInPandas(run, FOUND)


def positives(anchors: DataFrame, packed: DataFrame, bits: int, most: int = POSITIVES) -> DataFrame:
    """(row, slot, found_id, score): each anchor's first rows of its label with another id."""

    def run(a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if a.empty or c.empty:
            return pd.DataFrame([], columns=["row", "slot", "found_id", "score"])
        score, ids = scores(unpack(_planes(a, bits)), _planes(c, bits)), c["vec_id"].to_numpy()
        out = []
        for k, (row, own) in enumerate(zip(a["row"], a["vec_id"])):
            others = np.flatnonzero(ids != own)
            out += [(row, 0, ids[i], score[i, k]) for i in others[_first(score[others, k], ids[others], most)]]
        return pd.DataFrame(out, columns=["row", "slot", "found_id", "score"])

    found = _grid(anchors, packed, ["label", "dims"], run)
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "found_id"))
    return found.withColumn("slot", rank.cast("int")).where(F.col("slot") <= most)


def negatives(anchors: DataFrame, packed: DataFrame, bits: int, most: int = NEGATIVES) -> DataFrame:
    """(row, slot, found_id, score, rank): for each positive (slot) of the anchors' column `positives`, the first rows of other labels within the window."""

    def run(a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        if not (a.empty or c.empty):
            score, ids, labels = scores(unpack(_planes(a, bits)), _planes(c, bits)), c["vec_id"].to_numpy(), c["label"].to_numpy()
            for k, (row, label, against) in enumerate(zip(a["row"], a["label"], a["against"])):
                others = np.flatnonzero(labels != label)
                own = score[others, k]
                for slot, s in enumerate(map(int, against), 1):
                    near = np.flatnonzero((own >= -(-LEAST * s // 100)) & (own <= MOST * s // 100))
                    at = others[near[_first(own[near], ids[others[near]], most)]]
                    out += [(row, slot, i, v) for i, v in zip(ids[at], score[at, k])]
        return pd.DataFrame(out, columns=["row", "slot", "found_id", "score"])

    found = _grid(anchors, packed, ["dims"], run)
    rank = F.row_number().over(Window.partitionBy("row", "slot").orderBy(F.desc("score"), "found_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= most)


def mine(rows: DataFrame, every: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the rows (vec_id, label, embedding).

    Rows with a null id, label or vector, a null, NaN or infinite component, or a squared norm of 2^62 or more in scaled
    components take no part; among the rest any inner product fits a long. Only vectors of one length are compared; an
    empty vector scores 0. Rows with the anchor's own id are not its positives; repeated rows are rows of their own, and
    of equal scores the smaller id comes first. An anchor without a positive, or whose windows are empty, gives no rows,
    as does an empty table. Other columns are not read.

    All rows are scored against the anchors, in cells of at most some 1,024 anchors and 2,048 candidates; from a cell
    come only the first rows of each window.
    """
    packed, bits = index(rows.select("vec_id", "label", "embedding"))
    anchors = packed.where(F.col("vec_id") % every == 0)
    chosen = cut(positives(anchors, packed, bits), "positives")
    lists = chosen.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("slot", "score")))["score"].alias("against"))
    found = negatives(anchors.join(lists, "row"), packed, bits)
    named = chosen.select("row", "slot", F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = found.join(named, ["row", "slot"]).join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_four_russians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector against all; rules as in mine."""
    return mine(table(spark, sf_dir, "embeddings"))


OP11_SQL = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 10
"""
