"""How filters of documents interact: every order in which they may be applied.

A document is given by the set of filters that it fails, so a part of the corpus
is given by at most 2 ** n counts, and only those are aggregated: documents are
read once and neither their texts nor one row for each order is moved.  The
orders are the paths through the lattice of subsets, from no filter applied to
all.  Forward counting gives the orders that reach a state, backward counting those
that leave it; the removals of an edge (state, next filter), weighted with the
orders that pass it, add up to a filter's Shapley sum, and an order's steps are
the edges on its path.

Null texts are empty.  A null source is the part of the empty string.  ``E`` looks
at all documents: a row fails it if a row with a smaller ``doc_id`` has the same
text (told by SHA-256), so equal rows of one id don't fail by each other, and rows
without an id count as greater than all others and equal among themselves.  Of
several labels of a document one that is 1 counts; a document without a label is
neither good nor toxic.  An empty table gives no rows.  Other columns are not
read, so their names may clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import working_tables, written

LETTERS = "ABCDE"
WORD_BREAKS = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


# the lattice: fixed by the number of filters, whatever the data -----------------


def forward(n: int) -> list[int]:
    """For each state (a bit set of filters) the orders that reach it."""
    ways = [1] + [0] * ((1 << n) - 1)
    for state in range(1, 1 << n):
        ways[state] = sum(ways[state ^ (1 << f)] for f in range(n) if state >> f & 1)
    return ways


def backward(n: int) -> list[int]:
    """For each state the ways to go on from it to the state of all filters."""
    full = (1 << n) - 1
    ways = [0] * full + [1]
    for state in reversed(range(full)):
        ways[state] = sum(ways[state | (1 << f)] for f in range(n) if not state >> f & 1)
    return ways


def edges(n: int) -> Iterator[tuple[int, int, int]]:
    """``(state, filter, orders that pass)`` of every edge."""
    reach, leave = forward(n), backward(n)
    for state in range(1 << n):
        for f in range(n):
            if not state >> f & 1:
                yield state, f, reach[state] * leave[state | 1 << f]


def paths(letters: str) -> Iterator[tuple[str, int, int, int]]:
    """``(order, step, state before it, filter)`` of every step of every order."""
    for order in permutations(range(len(letters))):
        state = 0
        for step, f in enumerate(order, 1):
            yield "".join(letters[g] for g in order), step, state, f
            state |= 1 << f


def interactions(counts: DataFrame, letters: str) -> DataFrame:
    """Every step of every order for each ``part``.

    ``counts`` has ``part, mask, n, good, toxic``: the documents whose failed filters
    are the bits of ``mask``.  The tables that are broadcast are fixed by the number
    of filters, at most eight: n * 2 ** (2 n - 1) and n * n! rows.
    """
    n = len(letters)
    if n > 8:
        raise ValueError("more than eight filters")
    spark = counts.sparkSession
    met = [
        (mask, state, f, weight, fails and not mask & state, not mask & (state | 1 << f), fails and mask & state != 0, mask == 1 << f)
        for state, f, weight in edges(n)
        for mask in range(1 << n)
        for fails in [bool(mask >> f & 1)]
    ]
    met = spark.createDataFrame([(*m[:4], *map(int, m[4:])) for m in met], "mask int, state int, f int, weight long, goes int, stays int, late int, alone int")
    steps = spark.createDataFrame(list(paths(letters)), "filter_order string, step int, state int, f int")

    def total(flag: str, of: str = "n") -> Column:
        return F.sum(F.col(of) * F.col(flag))

    edge = counts.join(F.broadcast(met), "mask").groupBy("part", "state", "f", "weight").agg(
        total("stays").alias("kept"), total("goes").alias("removed"), total("late").alias("redundant"), total("alone").alias("unique_fails"),
        total("goes", "good").alias("good_lost"), total("goes", "toxic").alias("toxic_lost"),
    )
    shapley = edge.groupBy("part", "f").agg(F.sum(F.col("removed") * F.col("weight")).alias("shapley"))
    out = edge.join(shapley, ["part", "f"]).join(F.broadcast(steps), ["state", "f"])
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


# the filters ---------------------------------------------------------------------


def own_failures(text: Column) -> list[Column]:
    """What a text shows by itself, for the letters A to D."""
    words = F.filter(F.split(text, WORD_BREAKS), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    long = F.lit(100).cast("long")
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    return [n < 50, long * distinct < 65 * n, long * capitals > 5 * F.length(text), text.rlike(r"[#$%&*|]")]


def masked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, good, toxic`` of every document; texts are moved as digests only."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    mask = sum((fails.cast("int") * (1 << i) for i, fails in enumerate(own_failures(text))), F.lit(0))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), mask.alias("own"),
    )
    flag = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c)
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("known")).agg(flag("quality"), flag("toxic"))
    rows = written(rows.join(known, F.col("id") == F.col("known"), "left").drop("known"), "audited")
    # the least id of a text meets its rows by text and id, so a text of many rows is spread
    first = rows.groupBy(F.col("digest").alias("of")).agg(F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("least"))).alias("first"))
    first = first.select("of", F.col("first.least").alias("least"), F.lit(0).alias("repeats"))
    both = rows.join(first, (F.col("digest") == F.col("of")) & F.col("id").eqNullSafe(F.col("least")), "left")
    repeats = F.coalesce(F.col("repeats"), F.lit(1)) * 16
    return both.select("part", (F.col("own") + repeats).alias("mask"), F.coalesce("quality", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters over whole documents: one row for each part, order and step."""
    with working_tables(docs.sparkSession) as keep:
        counts = masked(docs, labels).groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
        return interactions(keep(written(counts, "failures")), LETTERS)
