"""What stages of the pipeline hold in Python workers at once."""

import corpus_pipeline as P
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tests.conftest import SF

from sluice.llm import common, jaccard, packing, quality

TEXT = 20_000


def _seen(frames):
    for frame in frames:
        out = pd.DataFrame({"doc_id": frame["doc_id"], "start": 0, "length": 1, "ids": b"", "ids_crc32": 0})
        yield out.assign(doc_tokens=frame["text"].map(len).sum())


@pytest.mark.parametrize("stage", ["quality_rules", "near_dedup", "pack_sequences"])
def test_batches_of_texts_are_bounded_by_bytes(spark, monkeypatch, stage):
    session = spark.newSession()
    docs = session.range(0, 1000, 1, 1).select(F.col("id").alias("doc_id"), F.lit("x").alias("source"), F.repeat(F.lit("a"), TEXT).alias("text"))
    if stage == "pack_sequences":  # its own batches
        monkeypatch.setattr(packing, "_pieces", lambda *_: _seen)
        out = P.pack_sequences(session, docs, SF)
        most, rows = out.agg(F.max("doc_tokens"), F.count(F.lit(1))).first()
    else:  # batches of the session's functions after the stage was planned
        monkeypatch.setattr(quality, "quality_filter", lambda docs, labels: docs)
        monkeypatch.setattr(P.simhash, "near_dedup", lambda docs: docs)
        got = getattr(P, stage)(session, docs, SF).mapInPandas(_seen, "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long")
        most, rows = got.agg(F.max("doc_tokens"), F.count(F.lit(1))).first()
    assert rows == 1000 and TEXT <= most <= common.BATCH_BYTES + TEXT


def test_a_limit_of_the_session_stays(spark):
    session = spark.newSession()
    session.conf.set(common.BATCH_SETTING, "12345")
    common.small_batches(session)
    assert session.conf.get(common.BATCH_SETTING) == "12345"


def test_small_batches_change_no_result(spark):
    session, texts = spark.newSession(), spark.read.parquet(f"{SF}/documents.parquet")
    whole = {r.doc_id: r.s for r in texts.select("doc_id", jaccard.sketch(F.col("text")).alias("s")).collect()}
    session.conf.set(common.BATCH_SETTING, "4096")
    texts = session.read.parquet(f"{SF}/documents.parquet")
    assert {r.doc_id: r.s for r in texts.select("doc_id", jaccard.sketch(F.col("text")).alias("s")).collect()} == whole


def test_the_plan_of_packing_takes_no_python_workers(spark):
    pieces = spark.range(20).selectExpr("id AS doc_id", "0L AS start", "1 + id % 3 AS length", "id AS ids_crc32", "1 + id % 3 AS doc_tokens")
    out = packing.pack(pieces, 8)
    assert "ExistingRDD" not in out._jdf.queryExecution().toString()
    rows = out.collect()
    assert len(rows) == 20 and all(r.offset + r["length"] <= 8 for r in rows)
    assert packing.pack(pieces.where("false"), 8).collect() == []
