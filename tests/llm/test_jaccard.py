import random
import re
from collections import Counter

import pytest

from sluice.llm import jaccard as J
from sluice.llm import simhash


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", words) if w]
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def made(seed, bases, copies):
    """(id, text): random texts and copies with words appended or replaced, alike to different degrees."""
    rng, out = random.Random(seed), []
    word = lambda: f"w{rng.randrange(40000)}"
    for _ in range(bases):
        base = [word() for _ in range(rng.randrange(60, 500))]
        out.append(base)
        for _ in range(copies):
            near = list(base)
            if rng.random() < 0.5:
                near += [word() for _ in range(int(len(base) * rng.uniform(0.02, 0.35)))]
            else:
                for _ in range(max(1, int(len(base) * rng.uniform(0.002, 0.04)))):
                    near[rng.randrange(len(near))] = word()
            out.append(near)
    rng.shuffle(out)
    return [(i, " ".join(t)) for i, t in enumerate(out)]


def kept_by_brute_force(rows):
    sets, part = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    of = {}
    for i, own in sets.items():
        for shingle in own:
            of.setdefault(shingle, []).append(i)
    shared = Counter((x, y) for ids in of.values() for x in ids for y in ids if x < y)
    pairs = [(x, y) for (x, y), n in shared.items() if 5 * n >= 4 * (len(sets[x]) + len(sets[y]) - n)]
    for x, y in pairs:
        part[max(root(x), root(y))] = min(root(x), root(y))
    return sorted(i for i in part if root(i) == i), pairs


def test_stage_keeps_what_brute_force_similarity_keeps(spark):
    rows = made(3, 40, 4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, pairs = kept_by_brute_force(rows)
    assert len(pairs) > 100
    assert sorted(r.doc_id for r in simhash.near_dedup(docs).collect()) == want


def test_recall_and_precision_on_the_documents(spark):
    """Of the pairs at 0.8 or more, 0.9 or more end in one group, and groups join nothing else than brute force does."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want, pairs = kept_by_brute_force(rows)
    kept = {r.doc_id for r in simhash.near_dedup(docs).collect()}
    assert len(pairs) > 30 and kept >= set(want)
    assert len(rows) - len(kept) >= 0.9 * (len(rows) - len(want))


def test_bands_find_pairs_close_to_the_threshold():
    rows, close, found = dict(made(4, 400, 2)), 0, 0
    keys = {i: set(J.bands(J.minima(J.shingle_set(t))).tolist()) for i, t in rows.items()}
    sets = {i: shingles(t) for i, t in rows.items()}
    of = {}
    for i, t in rows.items():
        of.setdefault(t.split()[:1][0], []).append(i)  # copies mostly keep the first word
    for group in of.values():
        for x in group:
            for y in group:
                if x < y and 0.8 <= len(sets[x] & sets[y]) / len(sets[x] | sets[y]) < 0.86:
                    close, found = close + 1, found + bool(keys[x] & keys[y])
    assert close > 100 and found >= 0.99 * close


def test_pairs_of_one_band_that_its_least_row_is_not_alike_to(spark):
    """The least row of a band is unlike the others, which are copies of each other."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = [(0, " ".join(base[:150])), (1, " ".join(base)), (2, " ".join([*base, "more"])), (3, ""), (4, None), (5, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert kept_by_brute_force(rows[:3])[0] == [0, 1]
    assert sorted(r.doc_id for r in simhash.near_dedup(docs).collect()) == [0, 1, 3, 5]


def test_cells_and_runs_are_split(spark, monkeypatch):
    monkeypatch.setattr(J, "HEADS", 3)
    monkeypatch.setattr(J, "RUN_ROWS", 2)
    rows = made(6, 2, 12)
    want, pairs = kept_by_brute_force(rows)
    texts = spark.createDataFrame(rows, "row long, text string")
    every = spark.createDataFrame([(x, y, band) for x, _ in rows for y, _ in rows if x < y for band in [x % 2 or None]], "a long, b long, band long")
    sizes = spark.createDataFrame([(i, len(shingles(t))) for i, t in rows], "row long, size int")
    assert sorted(tuple(r) for r in J.confirm(texts, sizes, every).collect()) == sorted(pairs)


@pytest.mark.parametrize("block", [4096, 5])
def test_blocks_of_a_band_meet(spark, monkeypatch, block):
    """Leaders that are alike to nothing: all links come from the blocks."""
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "LEADERS", 0)
    rows = made(8, 6, 9)
    want, pairs = kept_by_brute_force(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(pairs) > 50 and sorted(r.doc_id for r in simhash.near_dedup(docs).collect()) == want


def test_sketches_keep_pairs_at_the_threshold():
    """Of pairs at 0.8 to 0.84 none is too far apart in its sketches; most pairs below 0.5 are."""
    rows = dict(made(9, 300, 3))
    sets = {i: shingles(t) for i, t in rows.items()}
    sketches = {i: J.bits(J.minima(J.shingle_set(t))).view("uint64").tolist() for i, t in rows.items()}
    of = {}
    for i, t in rows.items():
        of.setdefault(t.split()[0], []).append(i)
    far = lambda x, y: sum((a ^ b).bit_count() for a, b in zip(sketches[x], sketches[y]))
    alike = lambda x, y: len(sets[x] & sets[y]) / len(sets[x] | sets[y])
    pairs = [(x, y) for g in of.values() for x in g for y in g if x < y]
    close = [far(x, y) for x, y in pairs if 0.8 <= alike(x, y) < 0.84]
    assert len(close) > 50 and max(close) <= J.FAR and 25 < sum(close) / len(close) < 35
    rng = random.Random(1)
    ids = list(rows)
    assert sum(far(*rng.sample(ids, 2)) > J.FAR for _ in range(500)) > 490


def test_similarity_counts_at_the_threshold():
    x, y = J.shingle_set("a b c d e f g h i"), J.shingle_set("a b c d e f g h")
    assert len(x) == 5 and J.alike(x, y) and J.alike(x, x) and not J.alike(x, J.shingle_set("a b c d e f g"))
    assert not J.alike(x, J.shingle_set(""))
