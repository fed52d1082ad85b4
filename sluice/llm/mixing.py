"""Mixing sources to target weights: whole documents chosen by exact length so that each source meets its budget."""

from __future__ import annotations

from itertools import accumulate
from math import gcd, isqrt

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
#: A source gives at most so many times its own words.
MOST = 3
#: Least number of salts that documents of one source and length are ranked by.
SALTS = 64
SEED = 20


def targets(sizes: list[tuple[str | None, int]], most: int = MOST) -> dict[str | None, float]:
    """Target words of each source: shares of all words by weights 1, 2, 3, 1, ... in code-point order, null last.

    No target is above `most` times its source; the excess is shared again by weight among the others.
    """
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {name: k % 3 + 1 for k, (name, _) in enumerate(order)}
    open_, out, left = dict(order), {}, float(sum(n for _, n in order))
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s, n in open_.items() if unit * weight[s] > most * n]
        if not full:
            return out | {s: unit * weight[s] for s in open_}
        for s in full:
            out[s] = float(most * open_.pop(s))
            left -= out[s]
    return out


def subset_sum(budget: int, lengths: list[int], counts: list[int]) -> dict[int, int]:
    """Bounded knapsack: how many of each length sum to the most that is not over budget. Reachable sums are bits.

    Sums are counted in the lengths' greatest common divisor. Of the steps' bit sets every k-th is kept, k the root of
    their number; the others are made again on the way back.
    """
    unit = gcd(*lengths) or 1
    top = budget // unit
    steps = []
    for length, count in zip(lengths, counts):
        size = 1
        while count > 0 and length * min(size, count) <= budget:
            steps.append((length, min(size, count)))
            count -= size
            size *= 2
    every, mask = isqrt(len(steps)) + 1, (1 << (top + 1)) - 1
    grown = lambda reach, step: reach | reach << step[0] // unit * step[1] & mask
    reach, kept, done = 1, [], 0
    while done < len(steps) and not reach >> top & 1:
        if done % every == 0:
            kept.append(reach)
        reach = grown(reach, steps[done])
        done += 1
    total, out = reach.bit_length() - 1, {}
    for block in range(len(kept) - 1, -1, -1):
        part = steps[block * every : min(done, (block + 1) * every)]
        before = list(accumulate(part[:-1], grown, initial=kept[block]))
        for (length, take), sums in zip(part[::-1], before[::-1]):
            if not sums >> total & 1:
                total -= length // unit * take
                out[length] = out.get(length, 0) + take
    return out


def fit(lengths: list[int], counts: list[int], target: float, most: int = MOST) -> tuple[int, dict[int, int]]:
    """(whole passes over the source, further documents of each length) that meet the target.

    The lengths' counts are scaled to the budget with the rounding carried along, so that the choice has the source's
    mix of lengths. As less than one document is carried from length to length, what remains is less than the longest
    document, for any number of documents. One document of each length, from the shortest on, comes back until they
    hold twice the longest, so that there is a choice; the remaining budget, four times the longest at most, is filled
    by subset sum over all documents left.
    """
    rows = sorted((n, c) for n, c in zip(lengths, counts) if n > 0)
    total = sum(n * c for n, c in rows)
    if not total:
        return 0, {}
    passes = min(most, int(target // total))
    budget = 0 if passes == most else min(total, round(target - passes * total))
    carry, chosen, rest = 0, {}, budget
    for n, c in rows:
        want = c * budget + carry
        chosen[n] = min(c, want // total)
        carry = want - chosen[n] * total
        rest -= n * chosen[n]
    longest, back = rows[-1][0], 0
    for n, _ in reversed(rows):
        while rest < 0 and chosen[n]:
            chosen[n] -= 1
            rest += n
    for n, _ in rows:
        if chosen[n] and back < 2 * longest:
            chosen[n] -= 1
            back += n
    free = {n: c - chosen[n] for n, c in reversed(rows) if c > chosen[n]}
    for n, c in subset_sum(rest + back, list(free), list(free.values())).items():
        chosen[n] += c
    return passes, {n: c for n, c in chosen.items() if c}


def _mix(docs: DataFrame, text: str, seed: int, doc: Column) -> DataFrame:
    """doc, s (source key), size, source_size, target, times.

    Documents of one source and length are ranked by a seeded hash. Salts are ranges of that hash, as many as there are
    shuffle partitions, and each one's ranks are shifted by the counts of those before: the ranks are the same however
    many salts there are, and a length that very many documents have is not one task's. A source's plan is made from
    its histogram, one row for each length: 24 bytes each, so a source with a million different lengths is a
    group of 24 MB.
    """
    spark = docs.sparkSession
    salts = max(SALTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    content = text_or_empty(text)
    name: Column = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))  # null and "" differ
    rows = docs.select(doc.alias("doc"), name.alias("s"), F.regexp_count(content, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(F.lit(seed), "doc_id", content).alias("h"))
    rows = rows.withColumn("salt", F.least(F.lit(salts - 1), F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * salts)).cast("int"))
    counts = cut(rows.groupBy("s", "size", "salt").agg(F.count(F.lit(1)).alias("n")), "lengths")
    # one row for each source: the weights of a mixture are given by source, so this table is of its size
    sizes = counts.groupBy("s").agg(F.sum(F.col("size") * F.col("n"))).collect()
    goal = targets([(s[1:] if s else None, int(n)) for s, n in sizes])
    goals = {s: (int(n), goal[s[1:] if s else None]) for s, n in sizes}

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        source = frame["s"].iloc[0]
        size, target = goals[source]
        passes, more = fit(frame["size"].tolist(), frame["n"].tolist(), target)
        return pd.DataFrame({"s": source, "size": frame["size"], "source_size": size, "target": target, "passes": passes, "more": [more.get(n, 0) for n in frame["size"]]})

    histogram = counts.groupBy("s", "size").agg(F.sum("n").alias("n"))  # a row for each length: its number has no bearing on that of the documents
    plans = histogram.groupBy("s").applyInPandas(one, "s string, size long, source_size long, target double, passes int, more long")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("s", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = counts.select("s", "size", "salt", before.alias("shift")).join(plans, ["s", "size"])
    rank = F.row_number().over(Window.partitionBy("s", "size", "salt").orderBy("h", "doc.doc_id"))
    placed = rows.withColumn("rank", rank).join(cells, ["s", "size", "salt"])
    times = F.col("passes") + (F.col("shift") + F.col("rank") <= F.col("more")).cast("int")
    return placed.withColumn("times", times)


def mix(docs: DataFrame, text: str = "text", seed: int = SEED) -> DataFrame:
    """The mixed documents: each row as often as the mix takes it, none to three times, with the columns of docs.

    Size is the number of words (null: 0); documents without words are not taken. A null source is a source of its own,
    other than "". Repeated rows and ids are documents of their own; rows equal in text and id tie and either may be
    taken. Long texts count in whole; an empty table gives no rows. The same input gives the same mix.
    """
    taken = _mix(docs, text, seed, F.struct("*")).where("times > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("doc.*")


def mixture(docs: DataFrame, text: str = "text", seed: int = SEED) -> DataFrame:
    """One row per document, of any text and id: doc_id, size, source_size, target, taken (0 to 3 times size); rules as in mix."""
    rows = _mix(docs, text, seed, F.struct("doc_id"))
    return rows.select("doc.doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def op5_subset_sum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture over all documents; nulls, empty texts, ties and repeats as in mix."""
    return mixture(table(spark, sf_dir, "documents"))
