"""Quality rules with risk-controlled cutoffs (operator 5).

Two fixed base rules fail a document outright.  Beside them, four rules compare
a ratio with a cutoff that is *learned*: within each stratum (a language with
enough labelled rows; the others are pooled) the documents labelled good form a
holdout, and each candidate cutoff gets an exact (Clopper-Pearson) upper bound
on the share of good documents it rejects.  The error probability ``DELTA`` is
divided by the number of candidates of all strata and rules (Bonferroni), so all
bounds hold at once whatever is chosen by them.  Rules are added, those that
catch most documents labelled bad first, each with the most lenient cutoff that
catches most of them, while the bounds of a stratum add up to ``RISK`` at most:
all its learned rules together reject no larger share of its good documents.  A
rule that catches no bad document is left off, so good documents are not spent
for nothing.

Counting is a Spark aggregation over all labelled rows; the driver sees only one
row of counts per stratum and label.  Null texts have no words and fail the
base rule, as do all texts under 50 words.  Of repeated labels for a document
the lowest is used, and rows that repeat an id are one trial (the least by its
measures).  Documents without a label are judged like any other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
MIN_WORDS = 50
#: The largest share of good documents that the learned rules may reject in a stratum.
RISK = 0.02
#: The probability that any certified bound is wrong.
DELTA = 0.05
#: A stratum of its own needs this many good and labelled documents.
MIN_STRATUM = 500
MAX_STRATA = 16

#: Rule: (name, numerator, denominator, cutoffs from lenient to strict).  All reject values above the cutoff.
RULES = (
    ("symbols", "n_symbols", "n_words", [4.0, 3.0, 2.0, 1.5, 1.0, 0.75, 0.5, 0.3, 0.2, 0.1, 0.05, 0.02]),
    ("dup_lines", "n_dup_lines", "n_words", [0.2, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01, 0.005]),
    ("repeats", "n_repeat_words", "n_words", [0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05]),
    ("long_words", "word_chars", "n_words", [20.0, 15.0, 12.0, 11.0, 10.0, 9.5, 9.0, 8.5, 8.0, 7.5]),
)

FEATURES = "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur at least twice in the text."""
    n = len(words)
    if n < 4:
        return 0
    code: dict[bytes, int] = {}
    ids = np.fromiter((code.setdefault(w, len(code)) for w in words), np.int64, n)
    if len(code) == n:
        return 0
    size = len(code)
    if size < 2_000_000:
        key = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
    else:  # the triple would not fit: number the pairs first
        _, pair = np.unique(ids[:-2] * size + ids[1:-1], return_inverse=True)
        key = pair * size + ids[2:]
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(key) + 1, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    twice = twice[:-1]
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : k + len(twice)] |= twice
    return int(covered.sum())


def measures(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode().split()
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    dup = 0
    if "\n" in text:
        lines = [x for x in text.split("\n") if x.strip(SPACES)]
        dup = len(lines) - len(set(lines))
    return len(words), chars, symbols, dup, repeated_words(words)


def measured(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = np.array([measures(t) for t in part.column("text").to_pylist()], np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("stratum"), *(pa.array(rows[:, k]) for k in range(5))],
                names=["doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
            )

    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("stratum"))
    return own.mapInArrow(run, FEATURES)


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


# exact binomial bound ------------------------------------------------------


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + top * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + top / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1.0) < 1e-14:
            break
    return h


def beta_cdf(x: float, a: float, b: float) -> float:
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def upper_bound(k: int, n: int, delta: float) -> float:
    """The largest p for which k or fewer of n are not rarer than ``delta``."""
    if k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        if 1.0 - beta_cdf(mid, k + 1, n - k) > delta:
            low = mid
        else:
            high = mid
    return high


# cutoffs -------------------------------------------------------------------


def exceeds(rule, cutoff: float):
    """Whether numerator / denominator is over the cutoff, without a division."""
    _, top, bottom, _ = rule
    return F.col(top) > F.lit(cutoff) * F.col(bottom)


def choose(good: int, good_over: list[int], bad_over: list[int], grid: list[float], delta: float, risk: float) -> tuple[float, float, int] | None:
    """The cutoff to use from counts over each candidate, lenient first: (cutoff, its bound, bad documents caught)."""
    certified = []
    for cutoff, k, caught in zip(grid, good_over, bad_over, strict=True):
        if not good or (bound := upper_bound(k, good, delta)) > risk:
            break
        certified.append((cutoff, bound, caught))
    most = max((c[2] for c in certified), default=0)
    return next((c for c in certified if c[2] == most), None) if most else None


def choose_all(good: int, over: dict[str, tuple[list[int], list[int]]], delta: float, risk: float) -> dict[str, float | None]:
    """A stratum's cutoffs by rule: bounds add up to ``risk`` at most."""
    out: dict[str, float | None] = {name: None for name, *_ in RULES}
    left = risk
    while True:
        found = {name: choose(good, *over[name], grid, delta, left) for name, _, _, grid in RULES if out[name] is None}
        found = {name: c for name, c in found.items() if c}
        if not found:
            return out
        name = max(found, key=lambda n: found[n][2])
        out[name], left = found[name][0], left - found[name][1]


def calibrate(features: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> dict[str, dict[str, float | None]]:
    """Cutoffs by stratum and rule; ``"*"`` is the pool of the small strata."""
    own = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    trials = features.where(F.col("doc_id").isNotNull()).join(own, "doc_id")
    fields = [c for c in features.columns if c != "doc_id"]
    held = trials.groupBy("doc_id", "quality").agg(F.min(F.struct(*fields)).alias("f")).select("doc_id", "quality", "f.*").where(~base_failed())
    good = F.count_if(F.col("quality") == 1)
    sizes = held.groupBy("stratum").agg(good.alias("good")).where(F.col("good") >= MIN_STRATUM).orderBy(F.desc("good"), "stratum").limit(MAX_STRATA)
    strata = [r["stratum"] for r in sizes.collect()]
    pooled = F.when(F.col("stratum").isin(strata), F.col("stratum")).otherwise(F.lit("*")) if strata else F.lit("*")
    over = [F.count_if(exceeds(rule, c)).alias(f"{rule[0]}_{k}") for rule in RULES for k, c in enumerate(rule[3])]
    rows = held.groupBy(pooled.alias("pool"), "quality").agg(F.count("*").alias("n"), *over).collect()  # a few strata, two labels
    counts = {(r["pool"], r["quality"]): r for r in rows}
    each = delta / (sum(len(grid) for *_, grid in RULES) * (len(strata) + 1))
    out: dict[str, dict[str, float | None]] = {}
    for pool in (*strata, "*"):
        g, b = counts.get((pool, 1)), counts.get((pool, 0))
        of = lambda row, name, grid: [row[f"{name}_{k}"] if row else 0 for k in range(len(grid))]
        over = {name: (of(g, name, grid), of(b, name, grid)) for name, _, _, grid in RULES}
        out[pool] = choose_all(g["n"] if g else 0, over, each, risk)
    return out


def verdict(cutoffs: dict[str, dict[str, float | None]]):
    """Column: the document passes every certified rule of its stratum."""
    own = [s for s in cutoffs if s != "*"]

    def passes(pool: str):
        out = F.lit(True)
        for rule in RULES:
            if (c := cutoffs[pool].get(rule[0])) is not None:
                out = out & ~exceeds(rule, c)
        return out

    chosen = None
    for pool in own:
        hit = F.col("stratum") == F.lit(pool)
        chosen = F.when(hit, passes(pool)) if chosen is None else chosen.when(hit, passes(pool))
    return passes("*") if chosen is None else chosen.otherwise(passes("*"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Measures and verdict for every document."""
    features = written(measured(docs), "rules")
    cutoffs = calibrate(features, labels)
    failed = base_failed()
    return features.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & verdict(cutoffs)).alias("kept"), "stratum",
    )
