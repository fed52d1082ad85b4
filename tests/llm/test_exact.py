import glob
import hashlib
import os
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from sluice.llm import exact as E
from tests.conftest import SF


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    out = []
    for (i, t), n in zip(rows, norm):
        same = [(-len(u or ""), j is None, j or 0) for (j, u), m in zip(rows, norm) if m == n]
        best = min(same)
        out.append((i, None if best[1] else best[2], len(same), hashlib.sha256(n.encode()).hexdigest()))
    return out


ROWS = [(1, "a b"), (2, "a  b"), (3, "ab\n\t\x0b\x0c\r"), (4, None), (5, ""), (6, " "), (7, "é"), (7, "é"), (None, "é"), (8, "x" * 200_000), (9, "x" * 200_000 + " "), (10, "solo"), (None, "none")]


@pytest.mark.parametrize("weak", [False, True])
def test_against_brute_force_in_several_batches(spark, weak):
    """A weak digest puts different texts under one key; the byte check takes them apart."""
    tmp = tempfile.mkdtemp(prefix="spark-")
    docs = spark.createDataFrame([(i, t, "f", 1) for i, t in ROWS], "doc_id long, text string, file string, row int")
    docs.repartition(4).write.parquet(f"{tmp}/in")
    digest = (lambda c: F.substring(F.unhex(F.sha2(c, 256)), 1, 0)) if weak else E.sha256
    E.ingest(spark, f"{tmp}/in", f"{tmp}/work", digest=digest, files_per_batch=2)
    got = E.verdicts(spark, f"{tmp}/in", f"{tmp}/work").collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in got) == sorted((str(a), str(b), c) for a, b, c, _ in brute(ROWS))
    assert sum(r.kept for r in got) == len({x[3] for x in brute(ROWS)})
    docs.limit(3).write.mode("append").parquet(f"{tmp}/in")  # later arrivals meet the state
    E.ingest(spark, f"{tmp}/in", f"{tmp}/work", digest=digest, files_per_batch=2)
    again = E.verdicts(spark, f"{tmp}/in", f"{tmp}/work").collect()
    assert len(again) == len(ROWS) + 3 and sum(r.kept for r in again) == sum(r.kept for r in got)


def test_stage_keeps_columns_and_one_row_each(spark):
    docs = spark.createDataFrame([(i, t, "f", 1) for i, t in ROWS], "doc_id long, text string, file string, row int")
    kept = E.exact_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(len(r.text or "") for r in kept.collect()) == sorted(max(len(u or "") for _, u in ROWS if re.sub(r"\s", "", u or "") == n) for n in {re.sub(r"\s", "", t or "") for _, t in ROWS})
    assert E.exact_dedup(docs.limit(0)).count() == 0
    dotted = docs.withColumnsRenamed({"file": "a.b", "row": "doc"})
    assert E.exact_dedup(dotted).columns == dotted.columns and E.exact_dedup(dotted).count() == kept.count()


def test_query_on_a_single_file(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = E.op2_streaming_dedup(spark, SF).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == sorted(brute(rows))
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_a_file_with_an_old_time_that_comes_later_is_taken_in(spark):
    tmp = tempfile.mkdtemp(prefix="spark-")
    for k in range(2):
        spark.createDataFrame([(k, "same")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp}/in")
        if k:
            (late,) = set(glob.glob(f"{tmp}/in/*.parquet")) - seen
            os.utime(late, (10**9, 10**9))
        seen = set(glob.glob(f"{tmp}/in/*.parquet"))
        E.ingest(spark, f"{tmp}/in", f"{tmp}/work")
    assert {(r.doc_id, r.keep_id, r.group_size) for r in E.verdicts(spark, f"{tmp}/in", f"{tmp}/work").collect()} == {(0, 0, 2), (1, 0, 2)}
