"""Conversation prefix trie: prefixes are known by composable fingerprints of stored turns, no rebuilt text is ever made."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc32_sql, cut, table

#: Conversations whose ids differ below this share a base; a head has fewer turns than HEADS.
GROUP, HEADS = 100, 6
#: Fingerprints are four numbers modulo these primes.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
LANES = range(len(PRIMES))
#: Nodes of one conversation that are summed up together, and ids of a piece of a node's list.
STRETCH, PIECE = 4096, 65536


def bases(seed: int) -> list[int]:
    """What each lane multiplies by from turn to turn."""
    return [int.from_bytes(hashlib.sha256(f"{seed}:{k}".encode()).digest()[:8], "little") % (p - 2) + 2 for k, p in enumerate(PRIMES)]


def _powers(base: int, exponent: np.ndarray, prime: int) -> np.ndarray:
    out, square, left = np.ones(len(exponent), np.int64), base, exponent.astype(np.int64)
    while left.any():
        out = np.where(left & 1, out * square % prime, out)
        square, left = square * square % prime, left >> 1
    return out


def stored_turns(rows: DataFrame) -> DataFrame:
    """The turns, stored in order of conversation: conv_id, block, rid (its reference, in order), role, text.

    Sorted by conv_id, turn (null first), role and text; a conversation of very many turns lies in several blocks.
    """
    clean = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    placed = clean.withColumn("spread", F.monotonically_increasing_id()).repartitionByRange(*order, "spread").sortWithinPartitions(*order, "spread")
    return cut(placed.select("conv_id", F.spark_partition_id().alias("block"), F.monotonically_increasing_id().alias("rid"), "role", "text"), "turns")


def _lanes(name: str) -> list[Column]:
    return [F.col(f"{name}{k}") for k in LANES]


def products(turns: DataFrame, seed: int) -> DataFrame:
    """conv_id, pos (from 1), rid, chars, p0.. (fingerprint of the first pos turns), q0.. (of one turn less).

    A run of n turns is (b^n, sum of turn_i * b^i), which composes: (m, s) then (n, t) is (m n, s + m t). Each block's
    runs are summed on their own; those that come before them in a conversation of several blocks (two in a block at
    most: its first and its last) are composed in front.
    """
    base = bases(seed)

    @F.pandas_udf(", ".join(f"t{k} long" for k in LANES))
    def terms(at: pd.Series, *turn: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({f"t{k}": _powers(base[k], at.to_numpy(), PRIMES[k]) * turn[k].to_numpy() % PRIMES[k] for k in LANES})

    hashes = [F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "role", "text"), F.lit(PRIMES[k] - 1)) + 1 for k in LANES]
    rows = turns.select("conv_id", "block", "rid", F.length("text").cast("long").alias("chars"), *(h.alias(f"h{k}") for k, h in enumerate(hashes)))
    upto = Window.partitionBy("conv_id", "block").orderBy("rid").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("conv_id", "block").orderBy("rid")).cast("long"))
    rows = rows.withColumn("t", terms(F.col("at") - 1, *_lanes("h"))).select("conv_id", "block", "rid", "chars", "at", "t.*")
    rows = rows.select("conv_id", "block", "rid", "chars", "at", *_lanes("t"), *((F.sum(f"t{k}").over(upto) % PRIMES[k]).alias(f"s{k}") for k in LANES))
    rows = cut(rows, "runs")

    whole = rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"), *(F.max_by(f"s{k}", "at").alias(f"s{k}") for k in LANES))
    several = whole.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "n", *_lanes("s")))).alias("runs")).where(F.size("runs") > 1)

    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for conv, runs in zip(batch["conv_id"], batch["runs"]):
                n, m, s = 0, [1] * len(PRIMES), [0] * len(PRIMES)
                for run in runs:
                    out.append((conv, run["block"], n, *m, *s))
                    s = [(a + b * run[f"s{k}"]) % PRIMES[k] for k, (a, b) in enumerate(zip(s, m))]
                    n += run["n"]
                    m = [b * pow(base[k], run["n"], PRIMES[k]) % PRIMES[k] for k, b in enumerate(m)]
            yield pd.DataFrame(out, columns=["conv_id", "block", "before", *(f"m{k}" for k in LANES), *(f"c{k}" for k in LANES)])

    lanes = lambda name: ", ".join(f"{name}{k} long" for k in LANES)
    carried = several.mapInPandas(compose, f"conv_id long, block int, before long, {lanes('m')}, {lanes('c')}")
    rows = rows.join(F.broadcast(carried), ["conv_id", "block"], "left")  # two rows for each block of the stored turns at most
    m, c = ([F.coalesce(x, F.lit(v)) for x in _lanes(name)] for name, v in (("m", 1), ("c", 0)))
    mod = lambda x, k: F.pmod(x, F.lit(PRIMES[k]))
    return rows.select(
        "conv_id", (F.coalesce("before", F.lit(0)) + F.col("at")).alias("pos"), "rid", "chars",
        *(mod(c[k] + m[k] * F.col(f"s{k}"), k).alias(f"p{k}") for k in LANES),
        *(mod(c[k] + m[k] * mod(F.col(f"s{k}") - F.col(f"t{k}"), k), k).alias(f"q{k}") for k in LANES),
    )


def members(own: DataFrame, seed: int) -> DataFrame:
    """conv_id, depth, print, above (the print one turn shorter), rid and chars of the last turn, ends: each prefix of each rebuilt conversation.

    A head's prefixes are the base's own; behind it stands the quotient of two products of the conversation's own turns,
    moved to its new place: head + b^(k - h) (product(pos) - product(h)), for k turns of head and the h left out.
    """
    base = bases(seed)
    first = F.struct("pos", "rid", "chars", *_lanes("p"), *_lanes("q"))
    told = own.groupBy("conv_id").agg(F.max("pos").alias("n"), F.array_sort(F.collect_list(F.when(F.col("pos") < HEADS, first))).alias("first"))
    told = cut(told.select("conv_id", "n", (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int").alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"), "first"), "heads")
    heads = told.select(F.col("conv_id").alias("base"), F.col("first").alias("head"))
    plan = told.join(heads, "base", "left").withColumn("head", F.slice(F.coalesce("head", F.array().cast(told.schema["first"].dataType)), F.lit(1), F.col("h")))
    plan = plan.withColumn("k", F.size("head")).withColumn("size", F.col("k") + F.greatest(F.lit(0), F.col("n") - F.col("h")))
    zero = F.lit(0).cast("long")
    end = lambda array, at, k: F.when(at > 0, F.coalesce(F.try_element_at(array, at)[f"p{k}"], zero)).otherwise(zero)
    struct = lambda lanes: F.struct(*(x.alias(f"f{k}") for k, x in enumerate(lanes)))
    none = struct([zero] * len(PRIMES))
    root = plan.select("conv_id", zero.alias("depth"), none.alias("print"), none.alias("above"), zero.alias("rid"), zero.alias("chars"), (F.col("size") == 0).alias("ends"))
    turn = F.col("turn")
    head = plan.select("conv_id", "size", F.explode("head").alias("turn")).select(
        "conv_id", turn["pos"].alias("depth"), struct([turn[f"p{k}"] for k in LANES]).alias("print"), struct([turn[f"q{k}"] for k in LANES]).alias("above"), turn["rid"].alias("rid"), turn["chars"].alias("chars"), (turn["pos"] == F.col("size")).alias("ends"),
    )
    kept = plan.where("n > h").select("conv_id", "h", "k", "size", *(end(F.col("head"), F.col("k"), k).alias(f"b{k}") for k in LANES), *(end(F.col("first"), F.col("h"), k).alias(f"o{k}") for k in LANES))
    # b^(k - h), by what is left out
    move = [F.element_at(F.array(*(F.lit(pow(base[k], -d, p)) for d in range(HEADS))), F.col("h") - F.col("k") + 1) for k, p in enumerate(PRIMES)]
    moved = lambda name, k: F.pmod(F.col(f"b{k}") + move[k] * F.pmod(F.col(f"{name}{k}") - F.col(f"o{k}"), F.lit(PRIMES[k])), F.lit(PRIMES[k]))
    rest = own.join(kept, "conv_id").where("pos > h")
    depth = F.col("k") + F.col("pos") - F.col("h")
    rest = rest.select("conv_id", depth.alias("depth"), struct([moved("p", k) for k in LANES]).alias("print"), struct([moved("q", k) for k in LANES]).alias("above"), "rid", "chars", (depth == F.col("size")).alias("ends"))
    return cut(root.union(head).union(rest), "members")


class Collision(ArithmeticError):
    """Two different prefixes have one fingerprint: another seed is needed."""


def verified(found: DataFrame, turns: DataFrame) -> DataFrame:
    """conv_id, depth, print, above, n_convs, chars of each node, after its members have been held against each other.

    All members of a node must have one print above and, where they refer to different stored turns, turns of the same
    role and text; so by induction over depth they are equal in whole.
    """
    nodes = found.groupBy("depth", "print").agg(F.min("conv_id").alias("conv_id"), F.min("above").alias("above"), F.max("above").alias("other"), F.count(F.lit(1)).alias("n_convs"), F.min("rid").alias("rid"), F.max("rid").alias("last"), F.max("chars").alias("chars"))
    nodes = cut(nodes, "nodes")
    shared = nodes.where("rid <> last and depth > 0").select("depth", "print")
    refs = found.join(shared, ["depth", "print"], "left_semi").select("depth", "print", "rid").distinct()
    texts = refs.join(turns.select("rid", "role", "text"), "rid").groupBy("depth", "print")
    unlike = texts.agg(F.min("role").alias("a"), F.max("role").alias("b"), F.min("text").alias("c"), F.max("text").alias("d")).where("a <> b or c <> d")
    if not nodes.where("above <> other").isEmpty() or not unlike.isEmpty():
        raise Collision
    return nodes.select("conv_id", "depth", "print", "above", "n_convs", "chars")


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """conv_id, depth, n_leaves, saved_tokens of nodes (conv_id, depth, parent_conv_id, leaf, saved).

    The nodes that a conversation stands for are a path that ends with its last turn, and hangs from a node of a smaller
    one. Whole paths are summed up over the paths that hang from them by doubling, in as many rounds as the logarithm of
    the most paths from the root to a leaf; then each path from its end, in stretches.
    """
    paths = nodes.groupBy("conv_id").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"), F.min(F.struct("depth", "parent_conv_id")).alias("top"))
    paths = paths.select("conv_id", "leaf", "saved", F.col("top.parent_conv_id").alias("up"), F.col("top.parent_conv_id").alias("parent_conv_id"), (F.col("top.depth") - 1).alias("depth"))
    now = cut(paths, "paths")
    while not now.where("up is not null").isEmpty():
        came = now.where("up is not null").groupBy(F.col("up").alias("conv_id")).agg(F.sum("leaf").alias("more"), F.sum("saved").alias("extra"))
        above = now.select(F.col("conv_id").alias("up"), F.col("up").alias("next"))
        now = now.join(came, "conv_id", "left").join(above, "up", "left")
        now = cut(now.select("conv_id", (F.col("leaf") + F.coalesce("more", F.lit(0))).alias("leaf"), (F.col("saved") + F.coalesce("extra", F.lit(0))).alias("saved"), F.col("next").alias("up"), "parent_conv_id", "depth"), "paths")
    hung = now.where("parent_conv_id is not null").groupBy(F.col("parent_conv_id").alias("conv_id"), "depth").agg(F.sum("leaf").alias("more"), F.sum("saved").alias("extra"))
    rows = nodes.select("conv_id", "depth", "leaf", "saved").join(hung, ["conv_id", "depth"], "left")
    rows = rows.select("conv_id", "depth", F.floor(F.col("depth") / STRETCH).alias("stretch"), *((F.col(a) + F.coalesce(b, F.lit(0))).alias(a) for a, b in (("leaf", "more"), ("saved", "extra"))))
    below = rows.groupBy("conv_id", "stretch").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    after = Window.partitionBy("conv_id").orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    below = below.select("conv_id", "stretch", F.sum("leaf").over(after).alias("more"), F.sum("saved").over(after).alias("extra")).where("more is not null")
    upto = Window.partitionBy("conv_id", "stretch").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(below, ["conv_id", "stretch"], "left")
    total = lambda a, b: F.sum(a).over(upto) + F.coalesce(b, F.lit(0))
    return rows.select("conv_id", "depth", total("leaf", "more").alias("n_leaves"), total("saved", "extra").alias("saved_tokens"))


def end_digests(found: DataFrame) -> DataFrame:
    """depth, print, ends_sha256 of the nodes at which a conversation ends: its ids ascending, hashed piece by piece."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), PIECE):
                part = b.iloc[k : k + PIECE]
                by = part.groupby("node", sort=False)["conv_id"]
                yield pd.DataFrame({"node": list(by.groups), "first": by.min().to_numpy(), "ids": [",".join(map(str, ids)) for _, ids in by]})

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, state = None, hashlib.sha256()
        for b in batches:
            out = []
            for n, ids in zip(b["node"], b["ids"]):
                if n == node:
                    state.update(b",")
                else:
                    if node is not None:
                        out.append((node, state.hexdigest()))
                    node, state = n, hashlib.sha256()
                state.update(ids.encode())
            yield pd.DataFrame(out, columns=["node", "ends_sha256"])
        if node is not None:
            yield pd.DataFrame([(node, state.hexdigest())], columns=["node", "ends_sha256"])

    node = F.concat_ws(":", "depth", *(F.col("print")[f"f{k}"] for k in LANES))
    ends = found.where("ends").select(node.alias("node"), "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    parts = ends.mapInPandas(pieces, "node string, first long, ids string")
    hashed = parts.repartition("node").sortWithinPartitions("node", "first").mapInPandas(digests, "node string, ends_sha256 string")
    split = F.split("node", ":")
    lane = lambda k: F.get(split, F.lit(k + 1)).cast("long").alias(f"f{k}")
    return hashed.select(F.get(split, F.lit(0)).cast("long").alias("depth"), F.struct(*map(lane, LANES)).alias("print"), "ends_sha256")


def trie(rows: DataFrame, seed: int = 1) -> DataFrame:
    """The nodes of the trie over the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    rows has conv_id, turn, role, text; turns are in order of turn (null first), then role, then text, repeated rows
    being turns of their own; null roles and texts count as empty, rows of a null conv_id take no part, other columns are
    not read. A conversation without a base, or with a base shorter than its head, is rebuilt from what there is, perhaps
    from nothing. An empty table has no node. Texts of any length are hashed where they lie; they are moved to sort
    them once, and once more to compare turns that are stored twice or more.
    """
    turns = stored_turns(rows)
    while True:  # a collision of 124-bit fingerprints is all but impossible; another seed makes the result right all the same
        found = members(products(turns, seed), seed)
        try:
            nodes = verified(found, turns)
            break
        except Collision:
            seed += 1
    above = nodes.select(F.col("conv_id").alias("parent_conv_id"), (F.col("depth") + 1).alias("depth"), F.col("print").alias("above"))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("above").alias("print")).agg(F.count(F.lit(1)).alias("n_children"))
    joined = nodes.join(above, ["depth", "above"], "left").join(children, ["depth", "print"], "left").join(end_digests(found), ["depth", "print"], "left")
    none = hashlib.sha256(b"").hexdigest()
    out = joined.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    out = cut(out.withColumn("leaf", (F.col("n_children") == 0).cast("long")), "trie")
    sums = subtree_sums(out)
    return out.join(sums, ["conv_id", "depth"]).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op13_prefix_monoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations; rules as in trie."""
    return trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


OP13_SQL = f"""
WITH turns AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
    SELECT conv_id AS c, {crc32_sql("conv_id")} % 6 AS h, conv_id - conv_id % 100 AS b FROM (SELECT DISTINCT conv_id FROM turns)
), rebuilt AS (
    SELECT c, row_number() OVER (PARTITION BY c ORDER BY side, pos) AS depth, sha256(role || chr(0) || text) AS turn, length(text) AS chars
    FROM (SELECT c, 0 AS side, pos, role, text FROM convs JOIN turns ON conv_id = b AND pos <= h UNION ALL SELECT c, 1, pos, role, text FROM convs JOIN turns ON conv_id = c AND pos > h)
), paths AS (
    SELECT c, depth, string_agg(turn, '') OVER (PARTITION BY c ORDER BY depth) AS path, chars FROM rebuilt
    UNION ALL SELECT c, 0, '', 0 FROM convs
), members AS (
    SELECT c, depth, sha256(path) AS node, chars, depth = max(depth) OVER (PARTITION BY c) AS ends, lag(sha256(path)) OVER (PARTITION BY c ORDER BY depth) AS above FROM paths
), nodes AS (
    SELECT node, depth, min(c) AS conv_id, any_value(above) AS above, count(*) AS n_convs, any_value(chars) AS chars, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
    FROM members GROUP BY node, depth
), told AS (
    SELECT nodes.*, p.conv_id AS parent_conv_id, coalesce(k.n, 0) AS n_children
    FROM nodes LEFT JOIN nodes p ON nodes.above = p.node AND nodes.depth = p.depth + 1 LEFT JOIN (SELECT above, depth - 1 AS depth, count(*) AS n FROM nodes GROUP BY ALL) k ON nodes.node = k.above AND nodes.depth = k.depth
), sums AS (
    SELECT m.node, m.depth, sum((t.n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum((t.n_convs - 1) * t.chars)::BIGINT AS saved_tokens
    FROM told t JOIN members m ON t.conv_id = m.c AND m.depth <= t.depth GROUP BY ALL
)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM told JOIN sums USING (node, depth)
"""
