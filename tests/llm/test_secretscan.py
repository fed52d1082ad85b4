import hashlib
import math
import random
import re
import string
from collections import Counter

from pyspark.sql import functions as F

from sluice.llm import secretscan as S
from tests.conftest import SF

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def listed(spans):
    return ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def token(rng, alphabet, n):
    return "".join(rng.choice(alphabet) for _ in range(n))


TEXTS = [
    None, "", " ", "token=token=abcdefgh12", "secret=token: abcdefghij", "é😀 Password : 'abc.def=ghi' x", "AKIAAKIA1234567890", "AKIAXX AKIA123456789012",
    "0" * 31 + "g" + "a" * 32, "api-key=12345678 API_KEY='12345678", "paſſword=12345678 toKen=12345678", "token:" * 50, "x" * 300_000 + " secret=0123456789abcdef",
    "secret=" + "a1" * 30, "password=short token =  \"longenough\"",
]


def test_base_spans_against_brute_force(spark):
    rng = random.Random(1)
    pieces = ["token", "SECRET", "=", ": ", "'", "abc", "12345678", "AKIA", "ABCDEFGHIJKL", "deadbeef" * 4, " ", "é", "😀", "api_key", "apikey", "\n"]
    texts = TEXTS + ["".join(rng.choice(pieces) for _ in range(rng.randrange(30))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, "b") for i, t in enumerate(texts)], "doc_id long, text string, base string")
    for r in S.scan(docs).collect():
        assert [tuple(x) for x in r.base] == brute(texts[r.doc_id]), texts[r.doc_id]
        assert set(map(tuple, r.base)) <= set(map(tuple, r.spans))
    assert S.scan(docs.limit(0)).count() == 0


def test_p_values_of_random_tokens_are_even(spark):
    """Simulated tokens, short ones over large alphabets too, where most cells expect less than one."""
    rng = random.Random(2)
    b62, hexes = string.ascii_uppercase + string.ascii_lowercase + string.digits, "0123456789abcdef"
    for alphabet, n in ((b62, 16), (b62, 40), (hexes, 18), (hexes, 40), (string.ascii_uppercase + string.digits, 20)):
        rows = [(token(rng, alphabet, n),) for _ in range(3000)]
        p = [r.p for r in spark.createDataFrame(rows, "t string").select(S._p_value(F.col("t"), F.lit(alphabet)).alias("p")).collect()]
        for x in (0.5, 0.2, 0.05, 0.01):
            assert sum(v <= x for v in p) / 3000 < 1.6 * x + 0.006, (n, len(alphabet), x)
        assert sum(v <= 0.5 for v in p) / 3000 > 0.3
    regular = spark.createDataFrame([("a1B" * 9,), ("word7" * 8,), ("aaaaaaaaaaaaaaaaaaaa1",)], "t string").select(S._p_value(F.col("t"), F.lit(b62)).alias("p"))
    assert all(r.p < 0.001 for r in regular.collect())


def test_drop_level_is_benjamini_hochberg():
    rng = random.Random(5)
    for _ in range(200):
        levels = [rng.choice([rng.randrange(5), rng.randrange(40), rng.randrange(120)]) for _ in range(rng.randrange(1, 80))]
        p = sorted(10 ** (-v / S.STEPS) for v in levels)
        passed = [x for k, x in enumerate(p, 1) if x <= 0.05 * k / len(p)]
        rejected = [v for v in levels if passed and 10 ** (-v / S.STEPS) <= max(passed)]
        cut = S.drop_level(dict(Counter(levels)), 0.05)
        assert [v for v in levels if v >= cut] == rejected


def test_report_level_leaves_out_what_random_tokens_do_not_explain():
    rng = random.Random(6)
    level = lambda p: int(-math.log10(max(p, 1e-15)) * S.STEPS)
    good = [level(rng.random()) for _ in range(2000)]
    bad = [level(0.002 + 0.05 * rng.random()) for _ in range(600)]
    cut = S.report_level(dict(Counter(good + bad)), 0.05)
    reported = sum(v < cut for v in good + bad)
    assert sum(v < cut for v in bad) <= 0.12 * reported and sum(v < cut for v in good) > 0.85 * len(good)
    assert sum(v < S.report_level(dict(Counter(good)), 0.05) for v in good) > 0.95 * len(good)


def test_very_many_matches_in_one_text(spark):
    n = 60_000
    docs = spark.createDataFrame([(1, "token=abcdefgh1 " * n)], "doc_id long, text string")
    (row,) = S.scan(docs).selectExpr("size(base) n", "base[0] a", f"base[{n - 1}] z").collect()
    assert row.n == n and tuple(row.a) == (0, 0, 15) and tuple(row.z) == (16 * (n - 1), 0, 16 * n - 1)


def test_precision_and_recall_on_planted_tokens(spark):
    """Random tokens of all encodings among names, paths and numbers; base spans are judged as well."""
    rng = random.Random(8)
    alphabets = ("0123456789abcdef", string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits, string.ascii_letters + string.digits)
    keys = [token(rng, alphabets[i % 4], rng.randrange(24, 60)) for i in range(400)]
    plain = [f"item{i}of" + "abcd" * 6 for i in range(200)] + ["Version2" * rng.randrange(4, 8) for _ in range(200)]
    rows = [(i, f"see {t} here") for i, t in enumerate(keys + plain)] + [(2000 + i, f"secret={t}") for i, t in enumerate(keys[:100])]
    found = S.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    hit = {r.doc_id for r in found if any(t.random for t in r.tokens)}
    assert len([i for i in range(400) if i in hit]) > 360 and len([i for i in range(400, 800) if i in hit]) < 20
    assert len([i for i in range(2000, 2100) if i in hit]) > 85


def test_random_tokens_are_kept_and_regular_ones_dropped(spark):
    rng = random.Random(3)
    b62 = string.ascii_letters + string.digits
    keys = [token(rng, b62, rng.randrange(30, 60)) for _ in range(150)]
    plain = [("word" + str(i % 7)) * 8 for i in range(150)] + ["SomeVeryLongCamelCaseNameWithWords2And3"] * 50
    docs = spark.createDataFrame([(i, f"see {t} here") for i, t in enumerate(keys + plain)], "doc_id long, text string")
    found = {r.doc_id for r in S.scan(docs).collect() if r.spans}
    assert len([i for i in range(150) if i in found]) > 125
    assert len([i for i in range(150, 350) if i in found]) < 10


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = S.op1_randomness_scan(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        base = brute(texts[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for _, k, _ in base) for x in range(3)]
        assert r.base_sha256 == hashlib.sha256(listed(base).encode()).hexdigest()
        assert set(filter(None, listed(base).split(","))) <= set(r.spans.split(","))


def test_few_regular_tokens_are_not_reported():
    rng = random.Random(9)
    level = lambda p: int(-math.log10(max(p, 1e-15)) * S.STEPS)
    for n in range(1, 51):
        for made in ([5] * n, [level(0.55)] * n, [level(0.001 + 0.3 * rng.random()) for _ in range(n)], [level(1e-9)] * n):
            cut = S.report_level(dict(Counter(made)), 0.05)
            assert sum(v < cut for v in made) == 0, (n, made)
    assert S.report_level({0: 19}, 0.05) == 0  # too few to tell


def test_small_classes_join_their_neighbours():
    counts = {0: {1: 5}, 1: {1: 2, 7: 3}, 2: {0: 30}, 3: {2: 4}}
    assert S.pools(counts, 8) == [([0, 1], {1: 7, 7: 3}), ([2, 3], {0: 30, 2: 4})]
    assert S.pools(counts, 1000) == [([0, 1, 2, 3], {1: 7, 7: 3, 0: 30, 2: 4})]
    assert S.pools({}, 5) == []
