"""Secret scan: pattern spans, and a battery of randomness tests over long tokens. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, text_or_empty

#: Base kinds in the order they are listed: pattern, and which group must have how many characters.
BASE = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
}
#: A quick test that a text can have a hit of the kind at all.
MAYBE = {"assign": r"(?i:password|passwd|secret|token|api_?key)", "access": r"AKIA[A-Z0-9]{12}", "hex": r"[0-9a-f]{32}"}
RANDOM = "random"
KINDS = (*BASE, RANDOM)
#: Tokens that the battery looks at, of at least so many characters.
SHORTEST = 16
TOKEN, MAYBE_TOKEN = rf"[A-Za-z0-9+/_-]{{{SHORTEST},}}", rf"[A-Za-z0-9+/_-]{{{SHORTEST}}}"
#: Encodings in the order they are inferred: pattern of the whole token, alphabet.
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = (
    (r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", DIGITS + "abcdef"),
    (r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", DIGITS + "ABCDEF"),
    (r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", UPPER + "234567"),
    (r"^(?=.*[0-9])(?=.*[A-Z])[A-Z0-9]+$", UPPER + DIGITS),
    (r"^(?=.*[0-9])(?=.*[a-z])[a-z0-9]+$", LOWER + DIGITS),
    (r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9]+$", UPPER + LOWER + DIGITS),
    (r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/"),
    (r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_"),
)
#: Lower bounds of the length classes within which false discoveries are controlled.
LENGTHS = (16, 20, 24, 32, 48, 80)
FDR = 0.05
#: Tokens that are judged together: classes with fewer join their neighbours.
POOL = 2000
#: p-values are rounded up to powers of 10^(-1/20), down to 10^-15.
STEPS, DEEPEST = 20, 300


def _spans(text: Column, pattern: str, maybe: str, group: int, least: int, kind: int) -> Column:
    """array<struct<start, kind, end>> of leftmost non-overlapping matches whose group has `least` characters.

    The texts between the matches and the matches themselves come from the same matcher; their lengths in code points
    add up to the positions.
    """
    sizes = lambda c: F.transform(c, lambda x: F.length(x).cast("long"))
    found = F.arrays_zip(
        sizes(F.split(text, pattern, -1)).alias("gap"),
        sizes(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("all"),
        sizes(F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).alias("part"),
    )
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    width = lambda x: x["gap"] + F.coalesce(x["all"], F.lit(0))
    step = lambda acc, x: F.struct(
        (acc["at"] + width(x)).alias("at"),
        F.when(
            x["part"] >= least,
            F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), F.lit(kind).alias("kind"), (acc["at"] + x["gap"] + x["all"]).alias("end")))),
        )
        .otherwise(acc["out"])
        .alias("out"),
    )

    def walk(every: Column) -> Column:
        """Blocks of as many matches as there are blocks, each from its own start: n^1.5 steps for n matches, where one list would take n^2."""
        side = F.ceil(F.sqrt(F.size(every))).cast("int")
        blocks = F.transform(F.sequence(F.lit(1), F.size(every), side), lambda i: F.slice(every, i, side))
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
        on = lambda acc, b: F.struct((acc["at"] + F.aggregate(b, F.lit(0).cast("long"), lambda n, x: n + width(x))).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        starts = lambda bs: F.aggregate(bs, zero, on, lambda acc: acc["out"])
        one = lambda b, at: F.aggregate(b, F.struct(at.alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
        return F.flatten(F.flatten(F.transform(F.array(blocks), lambda bs: F.zip_with(bs, starts(bs), one))))

    walked = F.element_at(F.transform(F.array(found), walk), 1)
    return F.when(text.rlike(maybe), walked).otherwise(empty)


def _both_tails(z: Column) -> Column:
    """Two-sided tail of the standard normal distribution (a published five-term approximation)."""
    x = F.abs(z)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.least(F.lit(1.0), 2 * poly * F.exp(-x * x / 2) / 2.5066282746310002)


def _p_value(token: Column, alphabet: Column) -> Column:
    """p of "symbols drawn independently and evenly from the alphabet": the least p of three tests, as the least of three independent ones."""
    index = F.transform(F.split(token, ""), lambda c: (F.instr(alphabet, c) - 1).cast("double"))

    def tests(x: Column) -> Column:
        n, k = F.length(token).cast("double"), F.length(alphabet).cast("double")
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
        # chi-squared against even counts, upper tail: the statistic's exact first three moments, as many cells expect
        # less than five, matched by a shifted gamma; half of the statistic's step is taken off
        counts = F.transform(F.sequence(F.lit(0), F.length(alphabet) - 1), lambda s: F.size(F.filter(x, lambda v: v == s)).cast("double"))
        chi = total(F.transform(counts, lambda c: c * c)) * k / n - n - k / n
        spread, third = 2 * (k - 1) * (n - 1) / n, 4 * (k - 1) * (n - 1) * (k + 2 * n - 6) / (n * n)
        shape, scale = 4 * spread * spread * spread / (third * third), third / (2 * spread)
        y = F.greatest(F.lit(0.0), (chi - (k - 1)) / (shape * scale) + 1)
        z_chi = (F.pow(y, F.lit(1 / 3)) - (1 - 1 / (9 * shape))) * F.sqrt(9 * shape)
        p_chi = F.when(z_chi > 0, _both_tails(z_chi) / 2).otherwise(1 - _both_tails(z_chi) / 2)
        # runs above and below the middle
        high = F.transform(x, lambda v: F.when(v >= k / 2, F.lit(1.0)).otherwise(F.lit(0.0)))
        a = total(high)
        b = n - a
        changes = total(F.zip_with(F.slice(high, F.lit(1), F.size(high) - 1), F.slice(high, F.lit(2), F.size(high) - 1), lambda u, v: F.abs(u - v)))
        mean = 2 * a * b / n + 1
        spread = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = F.when(spread > 0, _both_tails((changes + 1 - mean) / F.sqrt(spread))).otherwise(F.lit(1e-9))
        # correlation of neighbours
        centre = total(x) / n
        off = F.transform(x, lambda v: v - centre)
        power = total(F.transform(off, lambda v: v * v))
        lag = total(F.zip_with(F.slice(off, F.lit(1), F.size(off) - 1), F.slice(off, F.lit(2), F.size(off) - 1), lambda u, v: u * v))
        p_lag = F.when(power > 0, _both_tails((lag / power + 1 / n) * F.sqrt(n))).otherwise(F.lit(1e-9))
        return 1 - F.pow(1 - F.least(p_chi, p_runs, p_lag), F.lit(3.0))

    return F.element_at(F.transform(F.array(index), tests), 1)


def _level(p: Column) -> Column:
    """The step that p is rounded up to; higher levels are smaller p."""
    return F.least(F.lit(DEEPEST), F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * STEPS)).cast("int")


def candidates(text: Column) -> Column:
    """array<struct<start, end, level, length>> of tokens of an inferred encoding, with their test level."""
    spans = _spans(text, TOKEN, MAYBE_TOKEN, 0, SHORTEST, len(BASE))
    alphabet = lambda t: F.coalesce(*(F.when(t.rlike(p), F.lit(a)) for p, a in ENCODINGS))
    named = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.substr(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")).alias("token")))
    known = F.transform(named, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["token"].alias("token"), alphabet(s["token"]).alias("alphabet")))
    kept = F.filter(known, lambda s: s["alphabet"].isNotNull())
    return F.transform(
        kept,
        lambda s: F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            _level(_p_value(s["token"], s["alphabet"])).alias("level"),
            reduce(lambda c, k: F.when(s["end"] - s["start"] >= LENGTHS[k], F.lit(k)).otherwise(c), range(1, len(LENGTHS)), F.lit(0)).alias("length"),
        ),
    )


def drop_level(counts: dict[int, int], fdr: float) -> int:
    """The level from which tokens are not random: Benjamini-Hochberg over the tokens of a length class, given how many have each level."""
    total, rank, cut = sum(counts.values()), 0, DEEPEST + 1
    for level in sorted(counts, reverse=True):
        rank += counts[level]
        if 10 ** (-level / STEPS) <= fdr * rank / total:
            cut = level
    return cut


def report_level(counts: dict[int, int], fdr: float) -> int:
    """The level from which tokens are not reported, so that of those reported a share of `fdr` at most is not random.

    Random tokens have even p-values. Where p is large there are few others, so (tokens above p) / (1 - p) estimates how
    many random ones there are; the least estimate counts, those from less than three quarters of the range (which also
    show tokens that lump at one p) only by their upper limit of two deviations. What is above a level beyond the random
    ones' expected number is false, and one more: the share of it in all that is reported may not pass `fdr`, with no
    allowance. So of fewer than 1 / fdr tokens none is reported. At or below the level that the tests themselves reject.
    """
    drop = drop_level(counts, fdr)
    above = {c: sum(n for level, n in counts.items() if level < c) for c in range(1, drop + 1)}
    wide = lambda c: 1 - 10 ** (-c / STEPS)
    limit = lambda c: above[c] if wide(c) >= 0.75 else above[c] + 2 * above[c] ** 0.5
    random = min((limit(c) / wide(c) for c in above if wide(c) >= 0.25), default=0.0)
    return max((c for c, n in above.items() if max(0.0, n - random * wide(c)) + 1 <= fdr * n), default=0)


def pools(counts: dict[int, dict[int, int]], least: int = POOL) -> list[tuple[list[int], dict[int, int]]]:
    """Neighbouring length classes that are judged together, each pool of `least` tokens at least but if there are fewer in all."""
    out: list[tuple[list[int], dict[int, int]]] = []
    size = least
    for length in sorted(counts):
        if size >= least:
            out.append(([], {}))
            size = 0
        classes, levels = out[-1]
        classes.append(length)
        for level, n in counts[length].items():
            levels[level] = levels.get(level, 0) + n
        size += sum(counts[length].values())
    if len(out) > 1 and size < least:
        classes, levels = out.pop()
        out[-1][0].extend(classes)
        for level, n in levels.items():
            out[-1][1][level] = out[-1][1].get(level, 0) + n
    return out


def _cuts(found: DataFrame, fdr: float = FDR) -> dict[int, int]:
    """For each length class, the level from which tokens are not reported, over all documents' tokens.

    p-values are rounded up to levels before, so the procedures are exact for them; their table, which comes to the
    driver, has at most a row for each class and level, whatever the input.
    """
    levels = found.select(F.explode("tokens").alias("t")).groupBy("t.length", "t.level").agg(F.count(F.lit(1)).alias("n"))
    counts: dict[int, dict[int, int]] = {}
    for r in levels.collect():
        counts.setdefault(r["length"], {})[r["level"]] = r["n"]
    return {length: cut for lengths, c in pools(counts) for cut in [report_level(c, fdr)] for length in lengths}


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def scan(docs: DataFrame, text: str = "text", fdr: float = FDR) -> DataFrame:
    """One row per document: doc_id, base and spans as array<struct<start, kind, end>> in order of start and kind, and tokens.

    base has the pattern spans. spans has them and the random tokens that meet none of them. A token has 16 or more
    characters and an encoding inferred from them (hex, base32, base36 of either case, base62, base64 and its URL form,
    each with both letters and digits). Chi-squared, runs and serial correlation test an even, independent draw; within
    each length class (small ones together with their neighbours), over all documents, tokens that they reject are
    regular, with the wrongly rejected controlled as false discoveries, and so is the share of tokens called random that
    are not; where there are too few tokens to tell, none is called random. tokens has each token's start, end,
    level (of p) and whether it is random, also of those inside base spans.

    Null counts as empty; repeated rows and null ids give a row each; tokens of equal p share a verdict; long texts are
    scanned in whole, in n^1.5 steps for n matches; an empty table gives no rows.
    """
    body = text_or_empty(text)
    base = F.array_sort(F.flatten(F.array(*(_spans(body, p, MAYBE[name], g, n, k) for k, (name, (p, g, n)) in enumerate(BASE.items())))))
    found = cut(docs.select("doc_id", base.alias("base"), candidates(body).alias("tokens")), "secrets")
    cuts = _cuts(found, fdr)
    edge = lambda t: reduce(lambda c, k: F.when(t["length"] == k, F.lit(cuts[k])).otherwise(c), cuts, F.lit(0))
    judged = F.transform("tokens", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["level"].alias("level"), (t["level"] < edge(t)).alias("random")))
    found = found.withColumn("tokens", judged)
    extra = F.filter("tokens", lambda t: t["random"] & ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    extra = F.transform(extra, lambda t: F.struct(t["start"].alias("start"), F.lit(len(BASE)).alias("kind"), t["end"].alias("end")))
    return found.select("doc_id", "base", F.array_sort(F.concat("base", extra)).alias("spans"), "tokens")


def op1_randomness_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and n_confirmed: base spans that hold a token which the battery finds random; verdicts: each token's start, end, level and verdict.

    Nulls, empty and long texts, ties and repeats as in scan.
    """
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    holds = lambda b: F.exists("tokens", lambda t: t["random"] & (b["start"] < t["end"]) & (t["start"] < b["end"]))
    told = F.transform("tokens", lambda t: F.concat_ws(":", t["start"], t["end"], t["level"], F.when(t["random"], RANDOM).otherwise("regular")))
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{name}") for k, name in enumerate(BASE)),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
        F.size(F.filter("base", holds)).cast("long").alias("n_confirmed"),
        F.array_join(told, ",").alias("verdicts"),
    )
