"""Cells in long form: one row per cell, and what is done on rectangles of them.

A cell row has ``sheet, row, col`` (1-based), ``num`` or ``str`` for its value
(neither: blank), ``display`` and ``formula``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafline.functions.coordinates import MAX_ROWS, address_column, parse_range
from sheafline.functions.formulas import shifted
from sheafline.functions.values import finite, is_number, text
from sheafline.operators.table import Metric, pivot_summary

Area = tuple[int, int, int, int]


def area(address: str | Area) -> Area:
    return parse_range(address) if isinstance(address, str) else address


def inside(a: str | Area) -> Column:
    top, left, bottom, right = area(a)
    return F.col("row").between(top, bottom) & F.col("col").between(left, right)


def to_cells(df: DataFrame, row: Column, columns: Sequence[str], sheet: str = "sheet1") -> DataFrame:
    """A DataFrame's values as cells; ``row`` gives each record its sheet row."""
    entries = []
    for i, name in enumerate(columns):
        c, kind = F.col(f"`{name}`"), df.schema[name].dataType
        num = finite(c, kind)
        string = F.lit(None).cast("string") if is_number(kind) else F.nullif(c.cast("string"), F.lit(""))
        entries.append(F.struct(F.lit(i + 1).alias("col"), num.alias("num"), string.alias("str"), text(c, kind).alias("display")))
    cells = df.select(row.cast("long").alias("row"), F.explode(F.array(*entries)).alias("c"))
    return cells.select(F.lit(sheet).alias("sheet"), "row", "c.col", "c.num", "c.str", "c.display", F.lit(None).cast("string").alias("formula"))


def read_range(cells: DataFrame, where: str | Area) -> DataFrame:
    return cells.where(inside(where))


def statistics(cells: DataFrame, ranges: Sequence[str | Area]) -> DataFrame:
    """One row over a union of rectangles; each cell counts once.  Sum is null without numbers."""
    picked = cells.where(reduce(lambda a, b: a | b, map(inside, ranges), F.lit(False)))
    filled = F.col("num").isNotNull() | F.col("str").isNotNull()
    return picked.agg(
        F.count(F.when(filled, 1)).alias("count"),
        F.count("num").alias("numeric_count"),
        F.sum("num").alias("sum"),
        F.avg("num").alias("average"),
        F.min("num").alias("minimum"),
        F.max("num").alias("maximum"),
    )


def search(cells: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """Cells whose display text or formula contains the query, in sheet order."""
    wanted = query.strip().lower()
    if not wanted:
        return cells.limit(0).select("sheet", "row", "col", F.col("display").alias("preview"), F.lit("").alias("address"))
    haystack = F.lower(F.concat_ws(" ", "display", "formula"))
    found = cells.where(F.contains(haystack, F.lit(wanted)))
    found = found.select("sheet", "row", "col", F.coalesce(F.nullif("display", F.lit("")), F.concat(F.lit("="), "formula")).alias("preview"), address_column(F.col("row"), F.col("col")).alias("address"))
    return found if limit is None else found.orderBy("sheet", "row", "col").limit(limit)


def repeated_values(cells: DataFrame, where: str | Area, unique: bool = False) -> DataFrame:
    """Cells whose value occurs more than once in the rectangle, or just once.

    Counts are combined map-side before they are joined back.
    """
    own = cells.where(inside(where) & (F.col("num").isNotNull() | F.col("str").isNotNull()))
    counts = own.groupBy("num", "str").agg(F.count("*").alias("n")).where(F.col("n") == 1 if unique else F.col("n") > 1)
    counts = counts.select(F.col("num").alias("cn"), F.col("str").alias("cs"), "n")
    return own.join(counts, own["num"].eqNullSafe(F.col("cn")) & own["str"].eqNullSafe(F.col("cs"))).drop("cn", "cs")


def cell_is(cells: DataFrame, where: str | Area, operator: str, value: float | str) -> DataFrame:
    """Cells that meet a rule: equality is strict by type, order is for numbers only."""
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    c = F.col("num") if number else F.col("str")
    v = F.lit(value)
    if operator in ("equal", "not-equal"):
        same = F.coalesce(c == v, F.lit(False))
        test = same if operator == "equal" else ~same
    elif not number:
        test = F.lit(False)
    else:
        test = {"greater-than": c > v, "greater-than-or-equal": c >= v, "less-than": c < v, "less-than-or-equal": c <= v}[operator]
    return cells.where(inside(where) & F.coalesce(test, F.lit(False)))


def areas_frame(cells: DataFrame, areas: Sequence[str | Area]) -> DataFrame:
    """Areas as a small table, in the order given."""
    rows = [(i, *area(a)) for i, a in enumerate(areas)]
    return cells.sparkSession.createDataFrame(rows, "area int, top long, left long, bottom long, right long")


def cells_in_areas(cells: DataFrame, areas: Sequence[str | Area]) -> DataFrame:
    """Range join of cells and given rectangles; cells in several come several times."""
    span = areas_frame(cells, areas)  # as many rows as the caller wrote
    inside_area = (F.col("row") >= F.col("top")) & (F.col("row") <= F.col("bottom")) & (F.col("col") >= F.col("left")) & (F.col("col") <= F.col("right"))
    return cells.join(F.broadcast(span), inside_area)


def range_functions(cells: DataFrame, areas: Sequence[str | Area]) -> DataFrame:
    """SUM, COUNT, AVERAGE, MIN and MAX over each rectangle, numbers only.

    Without numbers SUM, COUNT, MIN and MAX are 0 and AVERAGE is the error value.
    """
    spans = areas_frame(cells, areas)
    sums = cells_in_areas(cells, areas).groupBy("area").agg(F.sum("num").alias("s"), F.count("num").alias("c"), F.min("num").alias("lo"), F.max("num").alias("hi"))
    zero = F.lit(0.0)
    return spans.join(sums, "area", "left").select(
        "area",
        F.coalesce("s", zero).alias("sum"),
        F.coalesce("c", F.lit(0)).alias("count"),
        F.when(F.coalesce("c", F.lit(0)) == 0, "#DIV/0!").otherwise(F.round(F.col("s") / F.col("c"), 6).cast("string")).alias("average"),
        F.coalesce("lo", zero).alias("minimum"),
        F.coalesce("hi", zero).alias("maximum"),
    )


def write_range(cells: DataFrame, where: str | Area, new: DataFrame) -> DataFrame:
    """Cells after those in the rectangle are replaced by ``new`` ones."""
    return cells.where(~inside(where)).unionByName(new.where(inside(where)))


def fill_range(cells: DataFrame, where: str | Area, value: float | str, sheet: str = "sheet1") -> DataFrame:
    """Cells after every position of the rectangle has the value."""
    top, left, bottom, right = area(where)
    spark = cells.sparkSession
    grid = spark.range(top, bottom + 1).select(F.col("id").alias("row"), F.explode(F.sequence(F.lit(left), F.lit(right))).alias("col"))
    number = isinstance(value, (int, float))
    filled = grid.select(
        F.lit(sheet).alias("sheet"), "row", "col",
        (F.lit(float(value)) if number else F.lit(None).cast("double")).alias("num"),
        (F.lit(None).cast("string") if number else F.lit(str(value))).alias("str"),
        F.lit(str(int(value)) if number and float(value).is_integer() else str(value)).alias("display"),
        F.lit(None).cast("string").alias("formula"),
    )
    return write_range(cells, where, filled)


def fill_formula(cells: DataFrame, where: str | Area, formula: str, translate: bool = True, sheet: str = "sheet1") -> DataFrame:
    """Cells after every position of the rectangle has the formula, as it reads from its first corner; or as given without ``translate``."""
    top, left, bottom, right = area(where)
    grid = cells.sparkSession.range(top, bottom + 1).select(F.col("id").alias("row"), F.explode(F.sequence(F.lit(left), F.lit(right))).alias("col"))
    own = F.lit(formula.removeprefix("="))
    text = shifted(own, F.col("row") - top, F.col("col") - left) if translate else own
    none = F.lit(None).cast("string")
    filled = grid.select(F.lit(sheet).alias("sheet"), "row", "col", F.lit(None).cast("double").alias("num"), none.alias("str"), none.alias("display"), text.alias("formula"))
    return write_range(cells, where, filled)


def overlaps(a: Area, b: Area) -> bool:
    return not (a[3] < b[1] or a[1] > b[3] or a[2] < b[0] or a[0] > b[2])


def pivot_written(
    cells: DataFrame, source: DataFrame, row_fields: Sequence[str], values: Sequence[Metric], order: str, target: str | Area,
    sheet: str = "sheet1", source_at: tuple[str, str | Area] | None = None,
) -> DataFrame:
    """``cells`` with a pivot of ``source`` written over the target's first corner: names, then a row a group in first-seen order.

    A pivot may not lie over its source, ``source_at`` (sheet, rectangle), and not
    leave the sheet.
    """
    top, left, bottom, right = area(target)
    if source_at is not None and source_at[0] == sheet and overlaps((top, left, bottom, right), area(source_at[1])):
        raise ValueError("PivotTable target cannot overlap its source range.")
    out = pivot_summary(source, row_fields, values, order, first="first__seen")
    names = [c for c in out.columns if c != "first__seen"]
    # a sheet has room for a million rows, so one task orders the groups
    placed = out.withColumn("row__no", F.row_number().over(Window.orderBy("first__seen")) + top)
    body = to_cells(placed, F.col("row__no"), names, sheet)
    heads = to_cells(cells.sparkSession.createDataFrame([tuple(names)], ", ".join(f"h{i} string" for i in range(len(names)))), F.lit(top), [f"h{i}" for i in range(len(names))], sheet)
    new = heads.unionByName(body).withColumn("col", F.col("col") + left - 1).where(F.col("row") <= MAX_ROWS)
    place = ["sheet", "row", "col"]
    return cells.join(new.select(*place), place, "left_anti").unionByName(new)


def axis_size(cells: DataFrame, low: int = 8, high: int = 60) -> DataFrame:
    """A width for each column from its longest display text, within bounds."""
    return cells.groupBy("sheet", "col").agg(F.least(F.lit(high), F.greatest(F.lit(low), F.max(F.length("display")) + 2)).alias("width"))


def copied_lines(cells: DataFrame, where: str | Area) -> DataFrame:
    """Tab-separated text of each row of a rectangle; the rectangle bounds a row's cells."""
    _, left, _, right = area(where)
    parts = cells.where(inside(where)).groupBy("sheet", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "display"))).alias("m"))
    columns = [F.coalesce(F.try_element_at("m", F.lit(c)), F.lit("")) for c in range(left, right + 1)]
    return parts.select("sheet", "row", F.concat_ws("\t", *columns).alias("line"))
