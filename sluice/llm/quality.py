"""Quality rules: counted base rules, and an isolation forest over rule statistics."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut as settled
from .common import table

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
SPAN = 8
LEAST_WORDS = 20
#: Trees, and rows that a tree has at least, if there are so many; more where the trees together would not take all rows.
TREES, TREE_ROWS, DEPTH, SEED = 200, 256, 10, 6
#: Share of the calibration rows labelled good that the threshold may reject.
MAX_REJECTED_GOOD = 0.0005

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_chars long, n_lines long, n_upper long, n_bare long, top_word long, n_long long, n_stutter long"
#: Features, and how far beyond a node's rows a split may fall: symbols, say, are so rare in good rows that splits between
#: those rows alone would never part a row full of them from the others.
MARGINS = {"mean_word": 10.0, "symbols": 0.5, "dup_lines": 0.5, "repeats": 0.5, "upper": 0.5, "bare": 0.5, "top_word": 0.5, "long": 0.5, "stutter": 0.5}
_UPPER = bytes(range(65, 91))
#: Letters, digits and bytes of other scripts as "a"; blanks as they are; all else as "#".
_KINDS = bytes(b if chr(b) in BLANKS else 97 if b > 127 or chr(b).isalnum() else 35 for b in range(256))


def repeated_words(words: list[bytes], span: int = SPAN) -> int:
    """Words inside windows of `span` words that occur twice or more in the text, all occurrences counted."""
    n = len(words) - span + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for k in range(span):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n]
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    if not same.any():  # different hashes: different windows
        return 0
    maybe = np.zeros(n, bool)
    maybe[order[1:][same]] = maybe[order[:-1][same]] = True
    at = np.flatnonzero(maybe)
    windows = [tuple(words[i : i + span]) for i in at.tolist()]
    count = Counter(windows)
    edge = np.zeros(len(words) + 1, np.int64)
    for i, w in zip(at.tolist(), windows):
        if count[w] > 1:
            edge[i] += 1
            edge[i + span] -= 1
    return int((np.cumsum(edge)[:-1] > 0).sum())


def statistics(text: str | None) -> tuple[int, ...]:
    """Counts in the order of STATS; null counts as empty."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = raw.split()  # bytes split at the six blanks only
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    letters = sum(map(text.count, SYMBOLS))
    upper = len(raw) - len(raw.translate(None, _UPPER))
    count = Counter(words)
    bare = sum(b"a" not in w for w in raw.translate(_KINDS).split())
    return (
        len(words), len(text) - sum(map(text.count, BLANKS)), letters, len(lines) - len(set(lines)), repeated_words(words),
        len(text), len(lines), upper, bare, max(count.values(), default=0), sum(c for w, c in count.items() if len(w) > 30), sum(map(bytes.__eq__, words, words[1:])),
    )


def features(stats: pd.DataFrame) -> np.ndarray:
    words, chars = stats["n_words"].clip(lower=1), stats["word_chars"].clip(lower=1)
    return np.stack(
        [
            (chars / words).clip(upper=30), stats["n_symbols"] / chars, stats["n_dup_lines"] / stats["n_lines"].clip(lower=1), stats["n_repeat_words"] / words,
            stats["n_upper"] / chars, stats["n_bare"] / words, stats["top_word"] / words, stats["n_long"] / words, stats["n_stutter"] / words,
        ],
        axis=1,
    ).astype(float)


def _mean_path(n: np.ndarray | int) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow(data: np.ndarray, margins: np.ndarray, rng: np.random.Generator, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """feature, cut, child and length of a tree over all rows of data."""
    nodes = 2 ** (depth + 1)
    feature, child = np.zeros(nodes, np.int16), np.zeros(nodes, np.int16)
    cut, length = np.full(nodes, np.inf), np.zeros(nodes, np.float32)
    todo, used = [(0, data, 0)], 1
    while todo:
        k, own, d = todo.pop()
        if d == depth or len(own) < 2:
            child[k], length[k] = k, d + _mean_path(len(own))
            continue
        f = int(rng.integers(data.shape[1]))
        c = rng.uniform(own[:, f].min() - margins[f], own[:, f].max() + margins[f])
        feature[k], cut[k], child[k] = f, c, used
        todo += [(used, own[own[:, f] < c], d + 1), (used + 1, own[own[:, f] >= c], d + 1)]
        used += 2
    return feature, cut, child, length


@dataclass
class Forest:
    """Isolation trees as arrays: at node k of a tree, rows below cut[k] in feature[k] go to child[k], others to child[k] + 1.

    rows: those of a tree, on average.
    """

    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    length: np.ndarray
    rows: int
    threshold: float = np.inf

    @classmethod
    def of(cls, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], rows: int) -> Forest:
        feature, cut, child, length = map(np.stack, zip(*trees))
        return cls(feature, cut, child, length, rows)

    @classmethod
    def fit(cls, data: np.ndarray, margins: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, depth: int = DEPTH, seed: int = SEED) -> Forest:
        rng = np.random.default_rng(seed)
        rows = min(rows, len(data))
        return cls.of([grow(data[rng.choice(len(data), rows, replace=False)], margins, rng, depth) for _ in range(trees)], rows)

    def score(self, data: np.ndarray) -> np.ndarray:
        """0 to 1, higher for rows that random splits part from the others sooner."""
        total, every = np.zeros(len(data)), np.arange(len(data))
        for t in range(len(self.feature)):
            at = np.zeros(len(data), np.int64)
            while True:
                below = data[every, self.feature[t, at]] < self.cut[t, at]
                to = np.where(self.child[t, at] == at, at, self.child[t, at] + ~below)
                if (to == at).all():
                    break
                at = to
            total += self.length[t, at]
        return 2.0 ** (-total / len(self.feature) / max(1e-9, float(_mean_path(self.rows))))


def calibrate(scored: DataFrame, most: float = MAX_REJECTED_GOOD) -> float:
    """The cut between the scores of rows (good, score) that keeps all but a share `most` of the good ones; without bad rows nothing is rejected."""
    good, bad = scored.where("good"), scored.where("not good")
    n, others = scored.agg(F.count_if("good"), F.count_if(~F.col("good"))).first()
    if not n or not others:
        return np.inf
    edge = good.orderBy(F.desc("score")).limit(int(most * n) + 1).agg(F.min("score")).first()[0]
    above = bad.where(F.col("score") > edge).agg(F.min("score")).first()[0]
    return np.inf if above is None else float((edge + above) / 2)


def dealt(rows: DataFrame, n: int, trees: int = TREES, least: int = TREE_ROWS) -> DataFrame:
    """The n rows with the trees that they go to (tree), by hash: each row goes to as many different ones as give a tree about `least` rows, to one at least."""
    times = min(trees, max(1, -(-trees * least // n)))
    strides = [k for k in range(1, trees + 1) if gcd(k, trees) == 1]  # steps that meet every tree before they come back
    first = F.pmod(F.xxhash64(F.lit(SEED), F.lit("tree"), "doc_id"), F.lit(trees))
    stride = F.element_at(F.array(*map(F.lit, strides)), (F.pmod(F.xxhash64(F.lit(SEED), F.lit("stride"), "doc_id"), F.lit(len(strides))) + 1).cast("int"))
    return rows.withColumn("tree", F.explode(F.transform(F.sequence(F.lit(0), F.lit(times - 1)), lambda k: (first + k * stride) % trees)))


def _grown(rows: pd.DataFrame) -> pd.DataFrame:
    tree, rows = int(rows["tree"].iloc[0]), rows.sort_values("doc_id")
    arrays = grow(features(rows), np.array(list(MARGINS.values())), np.random.default_rng((SEED, tree)))
    return pd.DataFrame([(tree, len(rows), *arrays)], columns=["tree", "rows", "feature", "cut", "child", "length"])


def fit_forest(docs: DataFrame, labels: DataFrame) -> Forest | None:
    """Fit on the statistics of one half of all labelled good documents, calibrate on the other half and on all labelled bad ones.

    Every labelled document that passes the base rules takes part, one row of each id: of repeated ids the row with the
    least statistics. The statistics are counted before the join with the labels, so no text is shuffled. A tree's rows
    are a share of the good half and meet in one task; the driver gets the trees, whose size is fixed, and counts.
    """
    chosen = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counted = docs.where("doc_id is not null").select("doc_id", stats_udf()("text").alias("s")).join(chosen, "doc_id")
    half = F.pmod(F.xxhash64(F.lit(SEED), F.lit("half"), "doc_id"), F.lit(2)) == 0
    known = counted.groupBy("doc_id", "quality").agg(F.min("s").alias("s")).where("not s.base_failed")
    known = settled(known.select("doc_id", (F.col("quality") > 0).alias("good"), half.alias("half"), "s"), "labelled")
    fitted = known.where("good and half").select("doc_id", "s.*")
    if not (n := fitted.count()):
        return None
    schema = "tree int, rows long, feature array<short>, cut array<double>, child array<short>, length array<float>"
    trees = dealt(fitted, n).groupBy("tree").applyInPandas(_grown, schema).orderBy("tree").toPandas()
    kinds = {"feature": np.int16, "cut": float, "child": np.int16, "length": np.float32}
    forest = Forest.of([tuple(np.asarray(t[c], k) for c, k in kinds.items()) for t in trees.to_dict("records")], round(trees["rows"].mean()))
    scored = known.where("not (good and half)").select("good", score_udf(forest)("s").alias("score"))
    forest.threshold = calibrate(settled(scored, "scored"))
    return forest


def base_failed(stats: pd.DataFrame) -> pd.Series:
    return (stats["n_words"] < LEAST_WORDS) | (100 * stats["n_repeat_words"] > 30 * stats["n_words"])


def score_udf(forest: Forest):
    @F.pandas_udf("double")
    def run(stats: pd.DataFrame) -> pd.Series:
        return pd.Series(forest.score(features(stats)), dtype=float)

    return run


def stats_udf(forest: Forest | None = None):
    names = [c.split()[0] for c in STATS.split(", ")]

    @F.pandas_udf(STATS + ", base_failed boolean, anomaly double, kept boolean")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([statistics(t) for t in texts], columns=names)
        out["base_failed"] = base_failed(out)
        out["anomaly"] = forest.score(features(out)) if forest is not None and len(out) else 0.0
        out["kept"] = ~out["base_failed"] & (out["anomaly"] < (forest.threshold if forest is not None else np.inf))
        return out

    return run


def judged(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """doc (the row) and q (its counts, base_failed, anomaly, kept), for each row on its own, repeated rows and null ids too.

    A null or empty text has no words and fails the base rules; long texts count in whole; a score equal to the
    threshold is rejected. Without usable labels nothing is rejected beyond the base rules.
    """
    forest = fit_forest(docs.select("doc_id", F.col(text).alias("text")), labels)
    return docs.select(F.struct("*").alias("doc"), stats_udf(forest)(F.col(text).cast("string")).alias("q"))


def quality_filter(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with the columns of docs; nulls, empty texts, ties and repeats as in judged."""
    return judged(docs, labels).where("q.kept").select("doc.*")


def op6_isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of each row of documents by the labels of the table labels; rules as in judged."""
    found = judged(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return found.select("doc.doc_id", "q.n_words", "q.word_chars", "q.n_symbols", "q.n_dup_lines", "q.n_repeat_words", "q.base_failed", "q.kept", "q.anomaly")
