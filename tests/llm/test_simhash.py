import random

import pytest
import xxhash

from sluice.llm import simhash as S
from tests.conftest import SF


def brute(texts, number=1):
    """fingerprint and component of each (id, text), all pairs; of several fingerprints any may be close."""
    fps, more = {}, {}
    for i, t in texts:
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w]
        shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        more[i] = S.fingerprints(t, number)
        assert more[i][0] == fps[i]
    part = {i: i for i in fps}
    ids = sorted(fps)
    changed = True
    while changed:
        changed = False
        for x in ids:
            for y in ids:
                if part[x] != part[y] and any((a ^ b).bit_count() <= 3 for a, b in zip(more[x], more[y])):
                    part[x] = part[y] = min(part[x], part[y])
                    changed = True
    return {i: (f"{fps[i]:016x}", part[i]) for i in ids}


def test_bk_tree_finds_all_within_radius():
    rng = random.Random(1)
    values = [rng.getrandbits(10) for _ in range(300)]
    tree = S.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:40]:
        assert sorted(tree.within(q, 2)) == sorted(v for v in set(values) if (v ^ q).bit_count() <= 2)


@pytest.mark.parametrize("tree_nodes", [4096, 7])
def test_links_join_all_close_values(spark, tree_nodes):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = list({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(3))) & (1 << 64) - 1 for b in base for _ in range(12)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = S.hamming_links(spark.createDataFrame([(k, v) for v in signed for k in (0, 5)], "slot int, fp long"), tree_nodes=tree_nodes).collect()
    assert sorted(r[1:] for r in links if r[0] == 0) == sorted(r[1:] for r in links if r[0] == 5)
    links = [r[1:] for r in links if r[0] == 5]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 3 for a, b in links)
    seen = S.Links()
    for a, b in links:
        seen.link(a, b)
    for i, x in enumerate(signed):
        for y in signed[:i]:
            if ((x ^ y) & (1 << 64) - 1).bit_count() <= 3:
                assert seen.root(x) == seen.root(y)


def test_edges_of_input(spark):
    text = "one two three four five six seven"
    rows = [(1, text), (2, text.upper()), (3, None), (4, ""), (5, " \n\t"), (6, "É é"), (7, "é É"), (7, "é É"), (None, text), (9, "w " * 70000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    got = {(r.doc_id, r.component_id) for r in S.near_groups(docs).collect()}
    assert {(1, 1), (2, 1), (None, 1), (3, 3), (4, 3), (5, 3)} <= got
    assert S.near_groups(docs).count() == len(rows)
    assert S.near_groups(docs.limit(0)).count() == 0
    assert S.near_dedup(docs).columns == ["doc_id", "text", "fp"]


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.op3_simhash_bktree(spark, SF).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs])
