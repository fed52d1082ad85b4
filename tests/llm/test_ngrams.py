import math
import random
import re
import zlib
from collections import Counter

import pytest

from sluice.llm import ngrams as N
from tests.conftest import SF


def brute(rows, order, worth=N.WORTH):
    """Probabilities by their definition, one token after the other."""
    cut = lambda x: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or "")), ""]
    tenth = lambda i: None if i is None else zlib.crc32(str(i).encode()) % 10
    counts = Counter()
    for i, x in rows:
        if tenth(i):
            t = cut(x)
            counts.update(tuple(t[a : a + k]) for k in range(1, order + 1) for a in range(len(t) - k + 1))
    ones = {g: c for g, c in counts.items() if len(g) == 1}
    n, v = sum(ones.values()), len(ones)

    def p(context, w):
        if not context:
            return (counts[(w,)] + 0.1) / (n + 0.1 * (v + 1))
        if not counts[context]:
            return p(context[1:], w)
        return (counts[(*context, w)] + worth * p(context[1:], w)) / (counts[context] + worth)

    out = []
    for i, x in rows:
        t = cut(x)
        out.append((i, tenth(i) == 0, len(t), sum(counts[(w,)] > 0 for w in t), n, sum(math.log10(p((), w)) for w in t), sum(math.log10(p(tuple(t[max(0, a - order + 1) : a]), w)) for a, w in enumerate(t))))
    return out, p, [w for (w,) in ones]


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2:])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], abs=1e-5) and g[6] == pytest.approx(w[6], abs=1e-5)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_are_those_of_the_definition(spark, order):
    rng = random.Random(order)
    text = lambda: "".join(rng.choice(["a", "A ", "b", " b", "ab\t", "c\n", "É", "é ", " ", "\x1f", " x y "]) for _ in range(rng.randrange(40)))
    rows = [(i, text()) for i in range(120)] + [(200, None), (201, ""), (None, "a b a"), (7, "a b"), (7, "a b"), (202, "q " * 3000), (2**60 + 1, "a a")]
    want, p, known = brute(rows, order)
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, key string")
    for bucket in (50, 1 << 20):  # many buckets, and one
        same(N.score(df, order, bucket=bucket, part=300).collect(), want)
    if order > 1:
        for context in ((known[0],), ("a",) * (order - 1), ("nowhere",)):
            assert sum(p(context, w) for w in known) + p(context, "unheard-of") == pytest.approx(1)
    assert N.score(df.limit(0), order).collect() == []


def test_text_ids(spark):
    rows = [("x1", "a b"), ("x2", "a c")]
    got = N.score(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    same(got, brute(rows, 2)[0])


def test_query_and_sql(spark):
    import duckdb

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = N.op12_backoff_automaton(spark, SF).collect()
    same(got, brute(rows, N.ORDER)[0])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    assert sorted(map(tuple, got)) == sorted(con.execute(N.OP12_SQL).fetchall())
