"""Language identification: averaged hashed subword embeddings with a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

ORDERS = (2, 3, 4)
BUCKETS = 1 << 16
DIM = 16
EPOCHS, RATE, SEED = 4, 20.0, 7
#: Labelled documents that the model is fitted and calibrated on, at most; a fifth of them calibrate.
FIT_DOCS = 2500
#: Wrong answers among those accepted on the calibration documents, at most.
MAX_WRONG = 0.01
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def subwords(text: str) -> np.ndarray | None:
    """Hash buckets of all letter runs' n-grams with their word edges; None where there is no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letters = _letters()[points]
    if not letters.any():
        return None
    points = np.where(letters, points, np.uint32(32))
    edged = np.concatenate([[32], points, [32]]).astype(np.uint32)
    space = edged == 32
    out = []
    for n in ORDERS:
        if (m := len(edged) - n + 1) < 1:
            continue
        h, inside = np.full(m, n, np.uint32), np.zeros(m, bool)
        for k in range(n):
            h = h * np.uint32(0x01000193) + edged[k : k + m]
            h ^= h >> np.uint32(15)
            if 0 < k < n - 1:
                inside |= space[k : k + m]
        edges_only = space[:m] & space[n - 1 :]
        out.append((h * np.uint32(0x9E3779B1) >> np.uint32(16))[~(inside | (edges_only if n == 2 else False))] & np.uint32(BUCKETS - 1))
    return np.concatenate(out)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # embedding times softmax weights: a row of logits for each bucket
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def logits(self, buckets: np.ndarray) -> np.ndarray:
        return self.table[buckets].mean(axis=0, dtype=np.float64) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated probability, and whether that is too low to be relied on."""
        buckets = subwords(text) if text else None
        if buckets is None or not len(buckets):
            return UNKNOWN, 0.0, True
        p = softmax(self.logits(buckets) / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(p[k]), bool(p[k] < self.least)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


Bag = tuple[np.ndarray, np.ndarray]


def bag(text: str | None) -> Bag:
    """Distinct buckets of a text and how often each occurs: as many numbers as there are buckets at most, however long the text."""
    buckets = subwords(text) if text else None
    return np.unique(buckets if buckets is not None else np.zeros(0, np.uint32), return_counts=True)


def train(texts: list[Bag], langs: list[str], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model | None:
    """Stochastic gradient descent over documents; a fifth set aside calibrates temperature and rejection."""
    rows = [(b, y) for b, y in zip(texts, langs) if len(b[0])]
    if not rows:
        return None
    names = sorted({y for _, y in rows})
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    aside = len(rows) // 5
    bags = []
    for (at, n), y in rows:
        bags.append((at, (n / n.sum()).astype(np.float32), names.index(y)))
    embedding = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    weights, bias = rng.normal(0, 0.3, (DIM, len(names))).astype(np.float32), np.zeros(len(names), np.float32)
    learn = order[aside:]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for k in rng.permutation(learn):
            at, share, y = bags[k]
            mean = share @ embedding[at]
            g = softmax(mean @ weights + bias)
            g[y] -= 1
            back = weights @ g
            weights -= 0.02 * step * np.outer(mean, g).astype(np.float32)
            bias -= 0.002 * step * g
            embedding[at] -= step * share[:, None] * back
    model = Model(names, (embedding @ weights).astype(np.float32), bias)
    check = [bags[k] for k in (order[:aside] if aside else order)]
    logits = np.array([share @ model.table[at] + bias for at, share, _ in check])
    truth = np.array([y for *_, y in check])
    loss = lambda t: -np.log(np.maximum(1e-12, softmax(logits / t)[np.arange(len(truth)), truth])).mean()
    model.temperature = float(min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=loss))
    p = softmax(logits / model.temperature)
    score, wrong = p.max(axis=1), p.argmax(axis=1) != truth
    for k in np.argsort(score):  # the least bound above which few answers are wrong
        if wrong[score >= score[k]].mean() <= MAX_WRONG:
            model.least = float(score[k]) if wrong.any() else 0.0
            break
    return model


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, rows: int = FIT_DOCS) -> DataFrame:
    """(lang, doc_id, text) of at most `rows` documents that have a language and are not held out, each language an equal share.

    Each language's documents are cut by a bound on the hash of their ids first, so that only some three times the sample
    is shuffled; ids with many rows count once, with their least text. Languages are few: their counts come to the driver.
    """
    known = docs.where("lang is not null and text is not null and doc_id is not null").where(~held_out())
    counts = known.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).collect()
    each = max(1, rows // max(1, len(counts)))
    bars = docs.sparkSession.createDataFrame([(r.lang, 3.0 * each / r.n + 0.0) for r in counts], "lang string, bar double")
    h = F.xxhash64(F.lit(SEED), "doc_id") / F.lit(2.0**64) + 0.5
    near = known.join(F.broadcast(bars), "lang").where(h < F.col("bar"))
    one = near.groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id"))
    return one.withColumn("rank", rank).where(F.col("rank") <= each).drop("rank")


def fit(docs: DataFrame, rows: int = FIT_DOCS) -> Model | None:
    """Fit on the bounded sample; its documents' bucket counts come to the driver, not their texts."""

    @F.pandas_udf("buckets array<int>, counts array<int>")
    def bags(texts: pd.Series) -> pd.DataFrame:
        found = [bag(t) for t in texts]
        return pd.DataFrame({"buckets": [b.astype(np.int32) for b, _ in found], "counts": [n.astype(np.int32) for _, n in found]})

    found = sample(docs, rows).select("lang", "doc_id", bags("text").alias("b")).select("lang", "doc_id", "b.*").toPandas().sort_values(["doc_id", "lang"])
    arrays = [(np.asarray(b, np.int64), np.asarray(n, np.int64)) for b, n in zip(found["buckets"], found["counts"])]
    return train(arrays, found["lang"].tolist())


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, rejected. Null texts and texts without letters: und, 0.

    Repeated rows and null ids give a row each (a null id is not held out); long texts count in whole; of languages that
    tie the first in code-point order is predicted; an empty table gives no rows.
    """

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([model.predict(t) if model else (UNKNOWN, 0.0, True) for t in texts], columns=["lang_pred", "score", "rejected"])

    return docs.select("doc_id", held_out().alias("held_out"), run(F.col(text)).alias("found")).select("doc_id", "held_out", "found.*")


def op7_subword_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, by a model fitted on a sample of those that are not held out; rules as in identify."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs, fit(docs))
