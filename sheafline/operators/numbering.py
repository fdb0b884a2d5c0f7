"""Numbers of nested list entries and headings: a counter a level, restarted by shallower levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.functions.text import marker_ordinal
from sheafline.operators.rounds import running, tasks_for

LEVELS = 9
#: Entries of a sequence that make a block.
BLOCK = 4096
#: Entries of a task, some kilobytes each with their counters.
PER_TASK = 25_000


def level_numbers(entries: DataFrame, levels: DataFrame, keys: Sequence[str], block: int = BLOCK) -> DataFrame:
    """``entries`` with ``number`` and ``values``, the numbers that all levels show at the entry.

    ``entries`` has ``keys``, ``position`` (a whole number), ``level`` from 0 (deeper
    than ``LEVELS - 1`` counts as that) and ``start``, a value to begin anew with at
    this entry, or null.  ``levels`` has one row for each of the keys: ``starts`` and
    ``restarts``, arrays over the levels.  A level restarts after an entry of any
    shallower level (restart null), of a level below the given one, or never (0).
    A level not begun, or due to restart, shows its start.

    One counter a level and its last restart are what a block hands on: sums and
    greatest restarts of blocks are composed and then applied within each block,
    so a document's entries are numbered by many tasks.
    """
    tasks = tasks_for(entries.sparkSession, entries.count(), PER_TASK)
    own = entries.withColumn("level", F.least(F.col("level"), F.lit(LEVELS - 1))).join(levels.select(*keys, "starts", "restarts"), list(keys))
    counted = running(own, keys, "position", block, sums={f"n{k}": (F.col("level") == k).cast("long") for k in range(LEVELS)}, tasks=tasks)

    def restarted(k: int) -> Column:
        """Where level k restarts: the place, what it had counted, and the value that comes next."""
        rule = F.get("restarts", F.lit(k))
        shallower = (F.col("level") < k) & (rule.isNull() | (F.col("level") < rule))
        mine = (F.col("level") == k) & F.col("start").isNotNull()
        had = F.col(f"n{k}") - F.when(mine, 1).otherwise(0)
        return F.when(shallower | mine, F.struct("position", had.alias("had"), F.coalesce(F.when(mine, F.col("start")), F.get("starts", F.lit(k))).cast("long").alias("value")))

    marked = running(counted, keys, "position", block, maxima={f"r{k}": restarted(k) for k in range(LEVELS)}, tasks=tasks)

    def value(k: int) -> Column:
        since = F.col(f"n{k}") - F.coalesce(F.col(f"r{k}.had"), F.lit(0))
        first = F.coalesce(F.col(f"r{k}.value"), F.get("starts", F.lit(k)).cast("long"))
        return F.when(since > 0, first + since - 1).otherwise(F.get("starts", F.lit(k)).cast("long"))

    values = marked.withColumn("values", F.array(*(value(k) for k in range(LEVELS))))
    return values.select(*(c for c in entries.columns if c != "level"), "level", F.get("values", F.col("level")).alias("number"), "values")


def composite_label(pattern: Column, values: Column, markers: Column, legal: Column | None = None) -> Column:
    """A level's label by its pattern: ``%1`` to ``%9`` stand for the levels' values in their markers' forms, in decimals where ``legal``."""
    pieces = F.regexp_extract_all(pattern, F.lit("(%[1-9]|[^%]+|%)"), F.lit(1))
    place = lambda p: F.substring(p, 2, 1).cast("int") - 1
    form = lambda p: F.when(F.lit(False) if legal is None else legal, "decimal").otherwise(F.get(markers, place(p)))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike("^%[1-9]$"), marker_ordinal(form(p), F.get(values, place(p)))).otherwise(p)), "")
