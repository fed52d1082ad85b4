import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sluice.llm import quality as Q
from tests.conftest import SF


def brute(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(8)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), n < 20 or 100 * len(inside) > 30 * n


def test_counts_on_odd_texts():
    rng = random.Random(5)
    texts = [None, "", " \n ", "a\x1cb\x85c d", "#|<é", "x " * 50_000]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randrange(60))) + rng.choice(["\n", "\n\n", ""]) for _ in range(200)]
    texts += ["\n".join(rng.choice(["one two", "one two ", "", " ", "three"]) for _ in range(9)) for _ in range(100)]
    for t in texts:
        assert Q.statistics(t)[:5] == brute(t)[:5]


def test_query_and_agreement_with_labels(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = Q.op6_isolation_forest(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert tuple(r)[1:7] == brute(texts[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_rejects_bad_rows_and_keeps_good_ones(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = Q.op6_isolation_forest(spark, sf).join(labels, "doc_id").collect()
    good = [r.kept for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.1


def test_verdicts_on_labels_that_neither_fit_nor_calibrate(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality is not null")
    aside = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    found = Q.judged(docs, labels.where(~aside)).select("doc.doc_id", "q.*").join(labels.where(aside), "doc_id").where("not base_failed").collect()
    good, bad = ([r.kept for r in found if r.quality == q] for q in (1, 0))
    assert len(good) > 500 and len(bad) > 50
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.05


def test_one_id_with_very_many_rows_is_one_row_of_the_sample(spark):
    docs = spark.range(5000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("a word and another " * 10), F.col("id")).alias("text"))
    labels = spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, quality int")
    forest = Q.fit_forest(docs, labels)
    assert forest is None or forest.rows == 1


def test_every_label_counts(spark):
    """One bad document among 40,000 labelled ones, of all the last by the hash that samples were once taken by, is learned from."""
    ids = spark.range(40_000).select(F.col("id").alias("doc_id"))
    bad = ids.orderBy(F.xxhash64(F.lit(Q.SEED), "doc_id").desc()).first().doc_id
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(25)), lambda k: F.concat(F.lit("word"), F.pmod(F.xxhash64("doc_id", k), F.lit(900)))), " ")
    docs = ids.select("doc_id", F.when(F.col("doc_id") == bad, F.lit(" ".join(f"#{k}#%$" for k in range(25)))).otherwise(words).alias("text"))
    labels = ids.select("doc_id", (F.col("doc_id") != bad).cast("int").alias("quality"))
    forest = Q.fit_forest(docs, labels)
    assert np.isfinite(forest.threshold)
    rejected = [r.doc_id for r in Q.judged(docs, labels).where("not q.kept").select("doc.doc_id").collect()]
    assert bad in rejected and len(rejected) <= 1 + 40_000 * 0.001


def test_trees_take_all_rows(spark):
    for n, trees, least in ((1, 200, 256), (300, 20, 16), (1000, 10, 16), (90, 9, 20)):
        rows = Q.dealt(spark.range(n).withColumnRenamed("id", "doc_id"), n, trees, least).collect()
        assert len({r.doc_id for r in rows}) == n and len(set(rows)) == len(rows)
        assert len(rows) == n * min(trees, max(1, -(-trees * least // n)))


def test_threshold_against_its_definition(spark):
    rng = np.random.default_rng(3)
    for n, m in ((1, 5), (5000, 50), (9000, 0), (0, 3)):
        good, bad = rng.random(n), rng.random(m) + 0.3
        scored = spark.createDataFrame([(True, float(x)) for x in good] + [(False, float(x)) for x in bad], "good boolean, score double")
        if not n or not m:
            assert Q.calibrate(scored) == np.inf
            continue
        edge = np.sort(good)[::-1][int(Q.MAX_REJECTED_GOOD * n)]
        assert Q.calibrate(scored) == ((edge + min(bad[bad > edge])) / 2 if (bad > edge).any() else np.inf)


def test_forest_scores_outliers_higher():
    rng = np.random.default_rng(1)
    data = rng.normal(size=(2000, 3))
    forest = Q.Forest.fit(data, np.ones(3))
    assert forest.score(np.array([[9.0, 9, 9]]))[0] > np.quantile(forest.score(data), 0.999)
    assert Q.Forest.fit(np.zeros((5, 2)), np.ones(2)).score(np.zeros((2, 2))).shape == (2,)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "k"), (1, "word " * 30, "k"), (None, " ".join(map(str, range(30))), None)], "doc_id long, text string, q string")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for own in (labels, labels.limit(0), labels.withColumn("quality", F.lit(None).cast("int"))):
        kept = Q.quality_filter(docs, own)
        assert kept.columns == docs.columns and kept.count() <= 1
    assert Q.quality_filter(docs.limit(0), labels).count() == 0
