import math
import random

import numpy as np
import pytest

from sluice.llm import hardneg as H
from tests.conftest import SF


def brute(rows, every=100):
    kept = []
    for i, e, y in rows:
        if i is None or e is None or y is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        kept.append((i, [math.floor(256 * float(x)) for x in e], (y + 1) % 10 if i % 7 == 0 else y))
    out = []
    for i, q, y in kept:
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(q, p)), j, z) for j, p, z in kept if len(p) == len(q)]
        for s, j, _ in sorted(x for x in scored if x[2] == y and x[1] != i)[:5]:
            near = sorted((t, k) for t, k, z in scored if z != y and 30 * -s <= 100 * -t <= 90 * -s)[:10]
            out += [(i, j, r, k, -s, -t) for r, (t, k) in enumerate(near, 1)]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize(("dims", "scale"), [(3, 1.0), (8, 30000.0), (17, 0.1)])
def test_lookups_give_inner_products(dims, scale):
    rng = np.random.default_rng(dims)
    a, c = (np.floor(256 * rng.normal(0, scale, (n, dims))).astype(np.int64) for n in (7, 600))
    bits = int(max(np.abs(a).max(), np.abs(c).max())).bit_length() + 1
    padded = H.unpack(H.pack(a, bits))
    assert (padded[:, :dims] == a).all() and not padded[:, dims:].any()
    assert (H.scores(padded, H.pack(c, bits)) == c @ a.T).all()


def test_small_cells_nulls_ties_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(H, "ANCHORS", 3)
    monkeypatch.setattr(H, "CANDIDATES", 16)
    rng = random.Random(4)
    rows = [(k, [rng.choice([0.0, 0.25, 0.5, -0.5, 1.0, 0.126]) for _ in range(5)], rng.randrange(4)) for k in range(300)]
    rows += [(301, None, 1), (302, [1.0, None, 0.0, 0.0, 0.0], 1), (303, [float("nan")] * 5, 2), (304, [float("inf")] * 5, 2), (305, [1.0] * 5, None), (None, [1.0] * 5, 1)]
    rows += [(400, [0.5, 0.5], 1), (401, [1.0, 1.0], 1), (402, [0.25, 0.5], 2), (500, [], 1), (501, [], 1), (502, [], 3), (-100, [0.5] * 5, 2), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame([(*r, "z") for r in rows], "vec_id long, embedding array<float>, label int, row string")
    want = brute([(i, e and [None if x is None else float(np.float32(x)) for x in e], y) for i, e, y in rows])
    assert got(H.mine(df)) == want and want
    assert {r[0] for r in want} >= {0, 100, 200, 400, 500, -100}
    assert got(H.mine(df.limit(0))) == []


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want = brute(rows)
    assert got(H.op11_four_russians(spark, SF)) == want and len(want) > 50


def test_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    assert got(H.op11_four_russians(spark, SF)) == sorted(con.execute(H.OP11_SQL).fetchall())
