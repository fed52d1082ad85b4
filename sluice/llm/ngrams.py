"""Language-model scoring: a smoothed n-gram model as a weighted automaton with failure arcs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import fsum

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_sql, cut, table

#: Words of the longest n-gram, and how many draws from the shorter context each context's estimate is worth.
ORDER, WORTH = 2, 8.0
#: The base distribution adds so much to each count, one unknown word included.
ADDED = 0.1
#: Tokens of a bucket, the documents that one automaton scores.
BUCKET = 1 << 18
#: n-grams that are counted together in one task, about.
PART = 1 << 21
#: The token after a document's last word; no word is empty.
END = b""
#: Odd multipliers of the n-grams' fingerprints.
STEP, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

COUNTED = "level int, part int, bucket long, totals binary, n long, v long"
SCORED = "n_tokens long, n_known long, train_tokens long, base_score double, score double"


def words(text: str | None) -> list[bytes]:
    """Lower-cases A-Z only and cuts at the six blanks only, as both work on bytes."""
    return (text or "").encode("utf-8", "replace").lower().split()


def _squeezed(a: np.ndarray, width: int = 4) -> bytes:
    """Numbers byte plane by byte plane, as the upper planes are almost empty."""
    return _packed(a.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes())


def _restored(b: bytes, width: int = 4) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_unpacked(b), np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel()


def _packed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(b: bytes) -> bytes:
    return pa.decompress(b[8:], decompressed_size=int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True)


def encode(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Buckets of whole documents, stored: their words, the words' numbers token by token, and for each document its length and whether it is learned from."""
    shape = "bucket long, tokens long, keys array<string>, held array<boolean>, learned binary, lengths binary, words binary, ids binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def closed(number: int) -> pd.DataFrame:
            row = (TaskContext.get().partitionId() << 32 | number, sum(map(len, parts)), keys, held, _squeezed(np.array(learned)), _squeezed(np.array([len(p) for p in parts])), _packed(b" ".join(known)), _squeezed(np.concatenate(parts)))
            return pd.DataFrame([row], columns=[c.split(" ")[0] for c in shape.split(", ")])

        made, size = 0, 0
        known, keys, held, learned, parts = {END: 0}, [], [], [], []
        for b in batches:
            for key, text, out, learn in zip(b["key"], b["text"], b["held_out"], b["learn"]):
                found = [known.setdefault(w, len(known)) for w in words(text)]
                found.append(0)
                keys.append(key)
                held.append(bool(out))
                learned.append(bool(learn))
                parts.append(np.array(found, np.uint32))
                size += len(found)
                if size >= bucket:
                    yield closed(made)
                    made, size = made + 1, 0
                    known, keys, held, learned, parts = {END: 0}, [], [], [], []
        if parts:
            yield closed(made)

    tenth = F.crc32(F.col("doc_id").cast("string")) % 10
    rows = docs.select(F.col("doc_id").cast("string").alias("key"), F.col("text").cast("string").alias("text"), F.coalesce(tenth == 0, F.lit(False)).alias("held_out"), F.coalesce(tenth != 0, F.lit(False)).alias("learn"))
    return cut(rows.mapInPandas(run, shape), "ngram-buckets")


@dataclass
class Bucket:
    """A bucket's n-grams, numbered per level: of[k][i] is the number of the one of k + 1 words that ends at token i."""

    words: list[bytes]
    ids: np.ndarray
    lengths: np.ndarray
    learn: np.ndarray  # for each token
    of: list[np.ndarray]
    prints: list[np.ndarray]  # sorted fingerprints of the n-grams of two words and more
    first: list[np.ndarray]  # a token at which each of them ends

    @classmethod
    def read(cls, row, order: int) -> Bucket:
        vocabulary, ids = _unpacked(row["words"]).split(b" "), _restored(row["ids"]).astype(np.int64)
        lengths = _restored(row["lengths"]).astype(np.int64)
        learn = np.repeat(_restored(row["learned"]).astype(bool), lengths)
        before = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)  # tokens before it in its document
        own = np.array([xxhash.xxh64_intdigest(w) for w in vocabulary], np.uint64)[ids]
        out = cls(vocabulary, ids, lengths, learn, [ids], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)])
        h = own
        for k in range(1, order):
            longer = np.zeros_like(h)
            longer[1:] = (h[:-1] * STEP + own[1:]) * MIX
            h = longer ^ (longer >> np.uint64(29))
            at = np.flatnonzero(before >= k)
            prints, first, number = np.unique(h[at], return_index=True, return_inverse=True)
            of = np.full(len(ids), -1, np.int64)
            of[at] = number
            out.of.append(of)
            out.prints.append(prints)
            out.first.append(at[first])
        return out

    def seen(self, level: int) -> np.ndarray:
        """How often each n-gram of a level occurs in documents that are learned from."""
        numbers = self.of[level][self.learn]
        return np.bincount(numbers[numbers >= 0], minlength=len(self.words) if level == 0 else len(self.prints[level]))


def _parts(b: Bucket, level: int, parts: int) -> np.ndarray:
    """The part in which each n-gram is counted."""
    keys = np.array([xxhash.xxh64_intdigest(w, 1) for w in b.words], np.uint64) if level == 0 else b.prints[level]
    return (keys % np.uint64(parts)).astype(np.int64)


def part_count(buckets: DataFrame, part: int = PART) -> int:
    """Parts of about `part` tokens, as many as there are shuffle partitions at least."""
    (tokens,) = buckets.agg(F.sum("tokens")).first()
    return max(int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(tokens or 0) // part))


def count(buckets: DataFrame, parts: int, order: int = ORDER) -> DataFrame:
    """Totals over all buckets, stored (COUNTED): for each bucket, level and part those of the bucket's n-grams, in its order.

    A bucket sends each of its n-grams once, words as they are and longer ones as 64-bit fingerprints, in one block for
    each part, so a word that is frequent everywhere is one entry a bucket. A row of no bucket has a part's number of
    counted tokens and of distinct words.
    """

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                b = Bucket.read(row, order)
                for level in range(order):
                    place, n = _parts(b, level, parts), b.seen(level)
                    by = np.argsort(place, kind="stable")
                    edges = np.searchsorted(place[by], np.arange(parts + 1))
                    out = []
                    for p in range(parts):
                        own = by[edges[p] : edges[p + 1]]
                        if len(own):
                            keys = _packed(b" ".join(b.words[i] for i in own)) if level == 0 else _squeezed(np.diff(b.prints[level][own], prepend=np.uint64(0)), 8)
                            out.append((level, p, row["bucket"], keys, _squeezed(n[own])))
                    yield pd.DataFrame(out, columns=["level", "part", "bucket", "keys", "counts"])

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        level, p = int(rows["level"].iloc[0]), int(rows["part"].iloc[0])
        counts = [_restored(c) for c in rows["counts"]]
        edges = np.cumsum([len(c) for c in counts])[:-1]
        if level == 0:
            numbers: dict[bytes, int] = {}
            where = np.array([numbers.setdefault(w, len(numbers)) for k in rows["keys"] for w in _unpacked(k).split(b" ")], np.int64)
        else:
            _, where = np.unique(np.concatenate([np.cumsum(_restored(k, 8), dtype=np.uint64) for k in rows["keys"]]), return_inverse=True)
        sums = np.bincount(where, weights=np.concatenate(counts)).astype(np.int64)
        out = [(level, p, int(k), _squeezed(t, 8), None, None) for k, t in zip(rows["bucket"], np.split(sums[where], edges))]
        out.append((level, p, None, None, int(sums.sum()), int((sums > 0).sum())))
        found = pd.DataFrame(out, columns=["level", "part", "bucket", "totals", "n", "v"])
        return found.astype({"bucket": "Int64", "n": "Int64", "v": "Int64"})

    sent = buckets.select("bucket", "lengths", "learned", "words", "ids").mapInPandas(send, "level int, part int, bucket long, keys binary, counts binary")
    return cut(sent.groupBy("level", "part").applyInPandas(total, COUNTED), "ngram-counts")


class Automaton:
    """States are the root and the contexts that occur in what was learned; an arc reads a word and has its smoothed log probability.

    Where a state has no arc for a word, its failure arc leads to the state of the context without its first word, at the
    weight that the smoothing leaves to it. The root has an arc for every word. P(w | context) is
    (count(context w) + worth * P(w | shorter context)) / (count(context) + worth), and at the root
    (count(w) + 0.1) / (N + 0.1 (V + 1)): it sums to 1 over all words and one unknown word.
    """

    def __init__(self, b: Bucket, totals: list[np.ndarray], n: int, v: int, worth: float = WORTH) -> None:
        order = len(b.of)
        self.base = np.log10((totals[0] + ADDED) / (n + ADDED * (v + 1)))
        p = [10.0**self.base]
        states, state = 1, []  # for each level the state after an n-gram: its own, or that of its longest end that has one
        fail, weight, self.arcs, logs, after = [0], [0.0], {}, [], []
        for k in range(order):
            if k:
                at = b.first[k]
                prefix, suffix, word = b.of[k - 1][at - 1], b.of[k - 1][at], b.ids[at]
                context = totals[k - 1][prefix]
                p.append(np.where(context > 0, (totals[k] + worth * p[k - 1][suffix]) / (context + worth), p[k - 1][suffix]))
            shorter = state[k - 1][suffix] if k else np.zeros(len(totals[0]), np.int64)
            own = shorter.copy()
            if k < order - 1:
                has = np.flatnonzero(totals[k] > 0)
                own[has] = states + np.arange(len(has))
                states += len(has)
                fail += shorter[has].tolist()
                weight += np.log10(worth / (totals[k][has] + worth)).tolist()
            state.append(own)
            if k:
                has = np.flatnonzero(totals[k] > 0)
                keys = (state[k - 1][prefix[has]] << 32) | word[has]
                self.arcs.update(zip(keys.tolist(), range(len(logs), len(logs) + len(has))))
                logs += np.log10(p[k][has]).tolist()
                after += own[has].tolist()
        self.fail, self.weight, self.logs, self.after = fail, weight, logs, after
        self.root, self.known = self.base.tolist(), state[0].tolist()

    def score(self, ids: list[int]) -> float:
        """One pass from left to right: log10 probability of the tokens."""
        arcs, logs, after, fail, weight, root, known = self.arcs.get, self.logs, self.after, self.fail, self.weight, self.root, self.known
        state, out = 0, []
        add = out.append
        for w in ids:
            while state:
                arc = arcs(state << 32 | w)
                if arc is not None:
                    add(logs[arc])
                    state = after[arc]
                    break
                add(weight[state])
                state = fail[state]
            else:
                add(root[w])
                state = known[w]
        return fsum(out)


def score(docs: DataFrame, order: int = ORDER, worth: float = WORTH, bucket: int = BUCKET, part: int = PART) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, and SCORED, by a model of the documents that are not held out.

    Documents of which crc32(doc_id as text) mod 10 is 0 are held out. Null texts count as empty and have one token, the
    end; a row without an id is scored, but neither held out nor learned from; repeated rows are learned from and scored
    each; long texts count in whole; an empty table gives no rows. Other columns are not read.

    Each bucket of about a quarter of a million tokens is scored by an automaton of the n-grams that it holds, with their counts over
    the whole corpus; what is shuffled are each bucket's distinct n-grams and, once, its numbered tokens.
    """
    buckets = encode(docs, bucket)
    parts = part_count(buckets, part)
    totals = count(buckets, parts, order)
    n, v = (int(x or 0) for x in totals.where("level = 0 and bucket is null").agg(F.sum("n"), F.sum("v")).first())

    def run(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        row = rows.iloc[0]
        b = Bucket.read(row, order)
        sums = []
        for level in range(order):
            own = found[found["level"] == level].set_index("part")["totals"]
            place = _parts(b, level, parts)
            out = np.zeros(len(place), np.int64)
            for p, t in own.items():
                out[place == p] = _restored(t, 8)
            sums.append(out)
        model = Automaton(b, sums, n, v, worth)
        out, at = [], 0
        for key, held, size in zip(row["keys"], row["held"], b.lengths):
            ids = b.ids[at : at + size]
            at += size
            out.append((key, held, size, int((sums[0][ids] > 0).sum()), n, fsum(model.base[ids].tolist()), model.score(ids.tolist())))
        return pd.DataFrame(out, columns=["doc_id", "held_out", *(c.split(" ")[0] for c in SCORED.split(", "))])

    left = buckets.select("bucket", "keys", "held", "lengths", "learned", "words", "ids").groupBy("bucket")
    right = totals.where("bucket is not null").select("bucket", "level", "part", "totals").groupBy("bucket")
    found = left.cogroup(right).applyInPandas(run, f"doc_id string, held_out boolean, {SCORED}")
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def op12_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability under the bigram automaton and the base distribution; rules as in score."""
    out = score(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


OP12_SQL = rf"""
WITH docs AS (
    SELECT doc_id, {crc32_sql("doc_id")} % 10 AS tenth,
        list_append(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> ''), '') AS ws
    FROM documents
), t AS (
    SELECT doc_id, tenth, ws[i] AS w, CASE WHEN i > 1 THEN ws[i - 1] END AS before FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM docs)
), one AS (
    SELECT w, count(*) AS c FROM t WHERE tenth <> 0 GROUP BY w
), two AS (
    SELECT before, w, count(*) AS c FROM t WHERE tenth <> 0 AND before IS NOT NULL GROUP BY before, w
), size AS (
    SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM one
), p AS (
    SELECT t.doc_id, t.tenth, n, coalesce(one.c, 0) AS c1, coalesce(two.c, 0) AS c2, coalesce(h.c, 0) AS ch, (coalesce(one.c, 0) + 0.1::DOUBLE) / (n + 0.1::DOUBLE * (v + 1)) AS p1
    FROM t CROSS JOIN size LEFT JOIN one ON t.w = one.w LEFT JOIN two ON t.before = two.before AND t.w = two.w LEFT JOIN one h ON t.before = h.w
)
SELECT doc_id, tenth = 0 AS held_out, count(*) AS n_tokens, count(*) FILTER (c1 > 0) AS n_known, n AS train_tokens, round(fsum(log10(p1)), 6) AS base_score,
    round(fsum(log10(CASE WHEN ch > 0 THEN (c2 + 8 * p1) / (ch + 8) ELSE p1 END)), 6) AS score
FROM p GROUP BY doc_id, tenth, n
"""
