import itertools
import random

from sluice.llm import mixing as M
from tests.conftest import SF


def test_targets_share_again_what_is_above_the_cap():
    got = M.targets([("b", 100), ("a", 10), (None, 1000), ("c", 100)])
    assert got["a"] == 30 and abs(sum(got.values()) - 1210) < 1e-6
    # weights: a 1, b 2, c 3, null 1; b and c are capped as well, null takes the rest
    assert got["b"] == 300 and got["c"] == 300 and abs(got[None] - 580) < 1e-6
    assert M.targets([]) == {} and M.targets([("x", 0)]) == {"x": 0.0}


def test_subset_sum_against_all_subsets():
    rng = random.Random(3)
    for _ in range(40):
        items = [(rng.randrange(1, 12), rng.randrange(1, 4)) for _ in range(4)]
        items = list({n: c for n, c in items}.items())
        budget = rng.randrange(40)
        best = max(s for s in (sum(n * k for (n, _), k in zip(items, ks)) for ks in itertools.product(*(range(c + 1) for _, c in items))) if s <= budget)
        got = M.subset_sum(budget, [n for n, _ in items], [c for _, c in items])
        assert sum(n * k for n, k in got.items()) == best and all(k <= dict(items)[n] for n, k in got.items())


def test_fit_meets_the_budget():
    rng = random.Random(4)
    for _ in range(60):
        counts = {rng.randrange(1, 3000): rng.randrange(1, 50) for _ in range(rng.randrange(1, 200))}
        total = sum(n * c for n, c in counts.items())
        target = rng.random() * 3 * total
        passes, more = M.fit(list(counts), list(counts.values()), target)
        assert all(c <= counts[n] for n, c in more.items())
        taken = passes * total + sum(n * c for n, c in more.items())
        assert abs(taken - target) <= max(counts) and (len(counts) < 50 or abs(taken - target) <= 2)


def goals(sizes):
    """Targets by water-filling: one level for all, each source's target the lesser of level times weight and three times its size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    low, high = 0.0, 3.0 * sum(sizes.values()) + 1
    for _ in range(200):
        level = (low + high) / 2
        given = sum(min(level * weight[s], 3 * sizes[s]) for s in order)
        low, high = (level, high) if given < sum(sizes.values()) else (low, level)
    return {s: min(high * weight[s], 3 * sizes[s]) for s in order}


def test_fit_with_a_very_long_document_and_with_no_small_ones():
    rng = random.Random(7)
    counts = {rng.randrange(1, 3000): rng.randrange(1, 2000) for _ in range(900)} | {3_000_000: 2, 1_000_003: 1}
    total = sum(n * c for n, c in counts.items())
    for share in (0.001, 0.3, 0.77, 0.999, 2.5):
        passes, more = M.fit(list(counts), list(counts.values()), share * total)
        assert abs(passes * total + sum(n * c for n, c in more.items()) - share * total) <= 1
    coarse = {70_000 * k: 3 for k in range(1, 200)}
    total = sum(n * c for n, c in coarse.items())
    passes, more = M.fit(list(coarse), list(coarse.values()), 0.4 * total)
    assert passes == 0 and 0 <= 0.4 * total - sum(n * c for n, c in more.items()) < 70_001


def test_ranks_do_not_depend_on_the_number_of_salts(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted(map(tuple, M.mixture(docs).collect()))
    monkeypatch.setattr(M, "SALTS", 333)
    assert sorted(map(tuple, M.mixture(docs).collect())) == want


def test_query(spark):
    import re

    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = M.op5_subset_sum_mix(spark, SF).collect()
    assert rows and sorted(r.doc_id for r in rows) == sorted(docs)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", d.text or "")) for i, d in docs.items()}
    sums, took, goal = {}, {}, {}
    for r in rows:
        s = docs[r.doc_id].source
        assert r.size == size[r.doc_id] and r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        sums[s], took[s], goal[s] = sums.get(s, 0) + r.size, took.get(s, 0) + r.taken, r.target
    assert goal.keys() == sums.keys() and all(abs(goal[s] - g) < 1e-6 * max(1, g) for s, g in goals(sums).items())
    assert all(abs(took[s] - goal[s]) <= max(50, 0.01 * goal[s]) for s in goal)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, M.op5_subset_sum_mix(spark, SF).collect()))


def test_edges(spark):
    schema = "doc_id long, text string, source string, n_chars long, _size string"
    docs = spark.createDataFrame([(1, "a b", None, 3, "x"), (1, "a b", None, 3, "x"), (2, None, "s", 0, None), (None, "c " * 100_000, "", 1, None), (4, " \n", "", 1, None)], schema)
    rows = M.mixture(docs).collect()
    assert len(rows) == 5 and {r.source_size for r in rows} == {4, 0, 100_000}
    assert M.mix(docs.drop("_size")).columns == docs.columns[:-1]
    dotted = docs.withColumnsRenamed({"_size": "a.b", "n_chars": "doc"})
    assert M.mix(dotted).columns == dotted.columns
    assert M.mixture(docs.limit(0)).count() == 0
