import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from sluice.llm import prefixtrie as P
from tests.conftest import SF


def brute(rows):
    """The trie by its definition, over whole rebuilt conversations."""
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [x[2:] for x in sorted(ts)] for c, ts in turns.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(c / 100) * 100
        rebuilt[c] = own.get(c - base, [])[:h] + own[c][h:]
    nodes = defaultdict(list)
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            nodes[tuple(ts[:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for n in nodes:
        if n:
            children[n[:-1]] += 1
    for n, cs in nodes.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += not children[n]
            saved[n[:d]] += (len(cs) - 1) * len(n[-1][1]) if n else 0
    ends = lambda n, cs: hashlib.sha256(",".join(map(str, sorted(c for c in cs if len(rebuilt[c]) == len(n)))).encode()).hexdigest()
    return sorted((min(cs), len(n), min(nodes[n[:-1]]) if n else None, len(cs), children[n], leaves[n], saved[n], ends(n, cs)) for n, cs in nodes.items())


def frame(spark, rows):
    return spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, depth string")


def got(df):
    return sorted(map(tuple, df.collect()))


def made(rng, convs):
    text = lambda: rng.choice([None, "", "a", "b", "é😀", "long " * 50])
    return [(c, rng.choice([None, t, t]), rng.choice(["user", "assistant", None, ""]), text()) for c in convs for t in range(rng.choice([1, 1, 2, 3, 5, 9]))]


def test_nulls_ties_repeats_and_missing_bases(spark):
    rng = random.Random(3)
    rows = made(rng, [*range(60), *range(150, 190), *range(-130, -90), 1000, 1001, 1002, 2**40 + 1, 5050]) + [(None, 1, "user", "a"), (3, 0, "user", "a"), (3, 0, "user", "a")]
    want = brute(rows)
    assert got(P.trie(frame(spark, rows))) == want and any(r[4] > 2 for r in want) and any(len(str(r[7])) for r in want)
    assert got(P.trie(frame(spark, rows[:0]))) == []
    assert got(P.trie(frame(spark, [(7, 1, "user", None)]))) == brute([(7, 1, "user", None)])  # its head would be of a base that is not there


def test_a_conversation_over_many_blocks_and_stretches(spark, monkeypatch):
    monkeypatch.setattr(P, "STRETCH", 16)
    monkeypatch.setattr(P, "PIECE", 3)
    rng = random.Random(5)
    long = [(100, t, "user", rng.choice("ab")) for t in range(500)]
    rows = long + [(c, t, r, x) for c in (101, 102, 103) for _, t, r, x in long[: 40 * (c - 100)]] + [(c, 0, "user", "a") for c in range(200, 260)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = P.stored_turns(frame(spark, rows))
        assert turns.where("conv_id = 100").select("block").distinct().count() > 2
        assert got(P.trie(frame(spark, rows))) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_fingerprint_that_collides_is_found_out(spark, monkeypatch):
    right, seeds = P.bases, []
    monkeypatch.setattr(P, "bases", lambda seed: (seeds.append(seed), [1] * 4 if seed == 1 else right(seed))[1])  # order does not count
    rows = made(random.Random(8), range(20)) + [(c, t, "user", x) for c, xs in ((200, "xy"), (300, "yx")) for t, x in enumerate(xs)]
    assert got(P.trie(frame(spark, rows))) == brute(rows)
    assert 2 in seeds


@pytest.mark.parametrize("way", ["definition", "sql"])
def test_query(spark, way):
    import duckdb

    if way == "sql":
        con = duckdb.connect()
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF}/conversations.parquet')")
        want = sorted(con.execute(P.OP13_SQL).fetchall())
    else:
        want = brute([tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])
    assert got(P.op13_prefix_monoid(spark, SF)) == want
