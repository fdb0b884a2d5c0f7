"""Filter, project, cohort, aggregate, profile and pivot on any DataFrame.

The table's order is an explicit column; where results follow "first seen"
order, they carry the least value of it.  Bounded mode caps what leaves the
engine (rows, groups); the operators themselves cap nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafline.functions.coordinates import letters
from sheafline.functions.values import blank, compare, finite, is_number

#: Caps of bounded mode, and of the arguments it takes.
ROWS, GROUPS, DISTINCT, SAMPLES, COLUMNS = 200, 500, 10_000, 5, 256
ARGUMENTS = {"predicates": (0, 20), "filters": (0, 8), "predicates of a filter": (1, 8), "metrics": (1, 8), "group keys": (0, 3), "columns": (0, 50)}
#: Parts in which a column's distinct values are ranked.
SALTS = 256
OPERATORS = (
    "equals", "not-equals", "greater-than", "greater-than-or-equal", "less-than", "less-than-or-equal",
    "contains", "starts-with", "ends-with", "is-blank", "is-not-blank",
)


@dataclass(frozen=True)
class Predicate:
    column: str
    operator: str
    value: object = None

    def __post_init__(self) -> None:
        if self.operator not in OPERATORS:
            raise ValueError(f"unknown operator: {self.operator}")


@dataclass(frozen=True)
class Cohort:
    """Keeps the partitions in which some row, or none, meets all predicates."""

    quantifier: str
    predicates: Sequence[Predicate]

    def __post_init__(self) -> None:
        if self.quantifier not in ("exists", "not-exists"):
            raise ValueError(f"unknown quantifier: {self.quantifier}")


@dataclass(frozen=True)
class Metric:
    operation: str
    column: str | None = None
    name: str | None = None

    def label(self) -> str:
        return self.name or (f"{self.operation} {self.column}" if self.column else self.operation)


def header_names(headers: Sequence[object], first_column: int = 1) -> list[str]:
    """Column names from a header row: blanks get their letter, repeats a number."""
    if len(headers) > COLUMNS:
        raise ValueError(f"a table has at most {COLUMNS} columns")
    seen: dict[str, int] = {}
    out = []
    for i, header in enumerate(headers):
        name = str(header).strip() if header is not None else ""
        name = name or f"Column {letters(first_column + i)}"
        seen[name.lower()] = n = seen.get(name.lower(), 0) + 1
        out.append(name if n == 1 else f"{name} ({n})")
    return out


def pivot_names(headers: Sequence[object]) -> list[str]:
    """Field names of a pivot: another rule for blanks and repeats."""
    used: set[str] = set()
    out = []
    for i, header in enumerate(headers):
        base = (str(header) if header is not None else f"Column {i + 1}").strip() or "Column"
        name, n = base, 2
        while name.lower() in used:
            name, n = f"{base} {n}", n + 1
        used.add(name.lower())
        out.append(name)
    return out


def resolve(df: DataFrame, wanted: str) -> str:
    """A column by name or by letter, without regard to case; the leftmost wins."""
    key = wanted.strip().lower()
    for i, name in enumerate(df.columns):
        if name.lower() == key or letters(i + 1).lower() == key:
            return name
    raise ValueError(f"unknown column: {wanted}")


def _kind(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def condition(df: DataFrame, predicates: Sequence[Predicate]) -> Column:
    """All predicates hold; true for no predicates.  Null, where a blank fails one, counts as false."""
    tests = []
    for p in predicates:
        name = resolve(df, p.column)
        tests.append(compare(F.col(f"`{name}`"), _kind(df, name), p.operator, p.value))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def cohort(df: DataFrame, partition_by: str, filters: Sequence[Cohort]) -> DataFrame:
    """The rows of the partitions that meet all filters; blank keys meet none.

    One aggregation with map-side combining finds the keys; a semi join brings
    back the rows, broadcasting the keys where Spark finds them small enough.
    """
    key = resolve(df, partition_by)
    named = {f"f{i}": F.coalesce(condition(df, f.predicates), F.lit(False)) for i, f in enumerate(filters)}
    tests = [F.bool_or(F.col(n)) if f.quantifier == "exists" else ~F.bool_or(F.col(n)) for n, f in zip(named, filters, strict=True)]
    flagged = df.where(~blank(F.col(f"`{key}`"), _kind(df, key))).select(F.col(f"`{key}`").alias("k"), *(c.alias(n) for n, c in named.items()))
    keys = flagged.groupBy("k").agg(reduce(lambda a, b: a & b, tests).alias("hit")).where("hit").select("k")
    return df.join(keys, df[key] == keys["k"], "left_semi")


def matched(df: DataFrame, predicates: Sequence[Predicate] = (), partition_by: str | None = None, filters: Sequence[Cohort] = ()) -> DataFrame:
    rows = df
    if filters:
        if partition_by is None:
            raise ValueError("cohort filters need a partition column")
        rows = cohort(df, partition_by, filters)
    return rows.where(condition(df, predicates)) if predicates else rows


def check_arguments(**given: int) -> None:
    """Raises where an argument has fewer or more entries than bounded mode takes."""
    for name, n in given.items():
        low, high = ARGUMENTS[name.replace("_", " ")]
        if not low <= n <= high:
            raise ValueError(f"{name.replace('_', ' ')}: {low} to {high} are allowed, {n} are given")


def match_summary(
    df: DataFrame, predicates: Sequence[Predicate] = (), partition_by: str | None = None, filters: Sequence[Cohort] = (), offset: int = 0, limit: int = 50,
) -> DataFrame:
    """One row on a bounded query: ``matched`` rows, how many it ``returned``, and whether it is ``truncated``."""
    offset, limit = max(0, int(offset)), max(1, min(ROWS, int(limit)))
    matches = matched(df, predicates, partition_by, filters).agg(F.count("*").alias("matched"))
    returned = F.least(F.lit(limit).cast("long"), F.greatest(F.lit(0).cast("long"), F.col("matched") - offset))
    return matches.select("matched", returned.alias("returned"), (offset + returned < F.col("matched")).alias("truncated"))


def query(
    df: DataFrame, columns: Sequence[str] = (), predicates: Sequence[Predicate] = (), partition_by: str | None = None,
    filters: Sequence[Cohort] = (), order: str | None = None, offset: int = 0, limit: int | None = None, bounded: bool = False,
) -> DataFrame:
    """Matching rows, some columns of them; in ``order`` if offset or limit are given."""
    rows = matched(df, predicates, partition_by, filters)
    names = [resolve(df, c) for c in columns] or df.columns
    if bounded:
        check_arguments(predicates=len(predicates), filters=len(filters), columns=len(columns))
        for f in filters:
            check_arguments(predicates_of_a_filter=len(f.predicates))
        limit = max(1, min(ROWS, 50 if limit is None else int(limit)))
    if offset or limit is not None:
        if order is None:
            raise ValueError("offset and limit need an order column")
        rows = rows.orderBy(order).offset(max(0, int(offset)))
        rows = rows if limit is None else rows.limit(limit)
    return rows.select(*(F.col(f"`{n}`") for n in names))


def metric_column(df: DataFrame, metric: Metric, bounded: bool = False) -> Column:
    """A metric's aggregate; in bounded mode distinct values count up to ``DISTINCT``."""
    if metric.column is None:
        if metric.operation == "count":
            return F.count(F.lit(1))
        raise ValueError(f"{metric.operation} needs a column")
    name = resolve(df, metric.column)
    c, kind = F.col(f"`{name}`"), _kind(df, name)
    filled = F.when(~blank(c, kind), c)
    number = finite(c, kind)
    return {
        "count": lambda: F.count(filled),
        "count-distinct": lambda: F.least(F.count_distinct(filled), F.lit(DISTINCT)) if bounded else F.count_distinct(filled),
        "sum": lambda: F.coalesce(F.sum(number), F.lit(0.0)),
        "average": lambda: F.avg(number),
        "minimum": lambda: F.min(number),
        "maximum": lambda: F.max(number),
    }[metric.operation]()


def aggregate(
    df: DataFrame, metrics: Sequence[Metric], group_by: Sequence[str] = (), predicates: Sequence[Predicate] = (), partition_by: str | None = None,
    filters: Sequence[Cohort] = (), order: str | None = None, bounded: bool = False,
) -> DataFrame:
    """Metrics by group, groups in first-seen order where ``order`` is given.

    Without matching rows there is no group, even with no group column.
    """
    if bounded:
        check_arguments(predicates=len(predicates), filters=len(filters), metrics=len(metrics), group_keys=len(group_by))
    rows = matched(df, predicates, partition_by, filters)
    keys = [F.col(f"`{resolve(df, g)}`") for g in group_by]
    columns = [metric_column(df, m, bounded).alias(m.label()) for m in metrics]
    first = [F.min(order).alias("first__seen")] if order else []
    out = rows.groupBy(*(keys or [F.lit(1).alias("all__rows")])).agg(*columns, *first)
    out = out if keys else out.drop("all__rows")
    if order:
        out = out.orderBy("first__seen")
        out = out.limit(GROUPS) if bounded else out
        out = out.drop("first__seen")
    return out


def profile(df: DataFrame, order: str, columns: Sequence[str] = ()) -> DataFrame:
    """One row per column: blanks, distinct values, range, types and first samples.

    The columns are unpivoted, so one pass and one shuffle serve them all.
    """
    names = [resolve(df, c) for c in columns] or [c for c in df.columns if c != order]
    entries = []
    for i, name in enumerate(names):
        c, kind = F.col(f"`{name}`"), _kind(df, name)
        typed = "boolean" if isinstance(kind, T.BooleanType) else "number" if is_number(kind) else "string"
        entries.append(F.struct(F.lit(i).alias("position"), F.lit(name).alias("name"), F.lit(typed).alias("type"), F.when(~blank(c, kind), c.cast("string")).alias("value"), finite(c, kind).alias("number")))
    long = df.select(F.col(order).alias("o"), F.explode(F.array(*entries)).alias("e")).select("o", "e.*")
    by_value = long.groupBy("position", "name", "type", "value").agg(F.count("*").alias("n"), F.min("o").alias("first"), F.min("number").alias("low"), F.max("number").alias("high"))
    filled = F.col("value").isNotNull()
    some = F.slice(F.array_sort(F.collect_list(F.when(filled & (F.col("rank") <= SAMPLES), F.struct("first", "value")))), 1, SAMPLES)
    # only the first few values of each salt of a column are collected
    salted = by_value.withColumn("salt", F.pmod(F.xxhash64("value"), F.lit(SALTS)))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("position", "salt").orderBy(filled.desc(), "first", "value")))
    return ranked.groupBy("position", "name", "type").agg(
        F.sum("n").alias("row_count"),
        F.coalesce(F.sum(F.when(~filled, F.col("n"))), F.lit(0)).alias("blank_count"),
        F.coalesce(F.sum(F.when(filled, F.col("n"))), F.lit(0)).alias("non_blank_count"),
        F.count(F.when(filled, 1)).alias("distinct_count"),
        F.min("low").alias("minimum"),
        F.max("high").alias("maximum"),
        F.array_join(F.transform(some, lambda s: s["value"]), "|").alias("samples"),
    )


def pivot_summary(df: DataFrame, row_fields: Sequence[str], values: Sequence[Metric], order: str | None = None, first: str | None = None) -> DataFrame:
    """Grouped summaries where nothing to summarise gives 0, not a null; ``first`` names a column for a group's least ``order``."""
    columns = []
    for m in values:
        name = resolve(df, m.column or "")
        c, kind = F.col(f"`{name}`"), _kind(df, name)
        number = finite(c, kind)
        value = {
            "count": lambda c=c, kind=kind: F.count(F.when(~blank(c, kind), c)),
            "sum": lambda number=number: F.coalesce(F.sum(number), F.lit(0.0)),
            "average": lambda number=number: F.coalesce(F.avg(number), F.lit(0.0)),
            "minimum": lambda number=number: F.coalesce(F.min(number), F.lit(0.0)),
            "maximum": lambda number=number: F.coalesce(F.max(number), F.lit(0.0)),
        }[m.operation]()
        columns.append(value.alias(m.name or f"{m.operation} of {m.column}"))
    out = df.groupBy(*(F.col(f"`{resolve(df, f)}`") for f in row_fields)).agg(*columns, *([F.min(order).alias(first or "first__seen")] if order else []))
    if first:
        return out
    return out.orderBy("first__seen").drop("first__seen") if order else out
