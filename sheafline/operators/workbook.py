"""Changes to cells, axes, merges and sheets, as joins and aggregations over whole tables of commands.

Every function takes the present rows and a table of commands and gives the rows
after them.  Commands on the same place count by their ``step``: the last one
that says something wins.  Rectangles are ``top, left, bottom, right``, 1-based;
either corner may come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafline.operators.rounds import running

RECTANGLE = ("top", "left", "bottom", "right")


def oriented(df: DataFrame) -> DataFrame:
    """Rectangles with their first corner at the top left."""
    low = lambda a, b: F.least(a, b)
    high = lambda a, b: F.greatest(a, b)
    return df.withColumns({"top": low("top", "bottom"), "bottom": high("top", "bottom"), "left": low("left", "right"), "right": high("left", "right")})


def clipped(ranges: DataFrame, used: DataFrame, key: str = "sheet") -> DataFrame:
    """Ranges cut to their sheet's used rectangle; those outside it go.  ``used`` has one row a sheet."""
    bounds = used.select(key, *(F.col(c).alias(f"used_{c}") for c in RECTANGLE))
    both = oriented(ranges).join(bounds, key)
    cut = {c: (F.greatest if c in ("top", "left") else F.least)(c, f"used_{c}") for c in RECTANGLE}
    return both.withColumns(cut).drop(*bounds.columns[1:]).where("top <= bottom AND left <= right")


def used_range(cells: DataFrame, key: str = "sheet") -> DataFrame:
    """The rectangle that holds all cells of each sheet."""
    return cells.groupBy(key).agg(F.min("row").alias("top"), F.min("col").alias("left"), F.max("row").alias("bottom"), F.max("col").alias("right"))


def positions(commands: DataFrame, *kept: str) -> DataFrame:
    """One row for each cell of each command's rectangle."""
    rows = oriented(commands).select("sheet", *kept, "left", "right", F.explode(F.sequence("top", "bottom")).alias("row"))
    return rows.select("sheet", *kept, "row", F.explode(F.sequence("left", "right")).alias("col"))


def formatted_ranges(cells: DataFrame, commands: DataFrame) -> DataFrame:
    """Cells with the commands' styles laid over their own; blank cells of a rectangle come to be.

    ``cells`` has ``sheet, row, col, style`` (a map, null: none) and any others,
    ``commands`` a rectangle, ``step`` and ``style``.
    """
    place = ["sheet", "row", "col"]
    own = cells.select(*place, F.explode("style").alias("k", "v"), F.lit(None).cast("long").alias("step"))
    laid = positions(commands, "step", "style").select(*place, F.explode("style").alias("k", "v"), F.col("step").cast("long").alias("step"))
    last = own.unionByName(laid).groupBy(*place, "k").agg(F.max_by("v", F.coalesce("step", F.lit(-(1 << 62)))).alias("v"))
    styles = last.groupBy(*place).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("style"))
    return cells.drop("style").join(styles, place, "full_outer").select(*cells.columns)


def resized(axes: DataFrame, commands: DataFrame) -> DataFrame:
    """Sizes and hidden marks of rows and columns: ``sheet, axis, index, size, hidden``.

    ``commands`` has ``sheet, axis, first, last, step, size, hidden``; a null size
    or mark leaves the present one.
    """
    new = commands.select("sheet", "axis", F.explode(F.sequence("first", "last")).alias("index"), "size", "hidden", F.col("step").cast("long").alias("step"))
    old = axes.select("sheet", "axis", F.col("index").cast(new.schema["index"].dataType).alias("index"), "size", "hidden", F.lit(-(1 << 62)).alias("step"))
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("step"))).alias(c)
    return old.unionByName(new).groupBy("sheet", "axis", "index").agg(latest("size"), F.coalesce(latest("hidden"), F.lit(False)).alias("hidden"))


def content_under_objects(cells: DataFrame, objects: DataFrame, block: int = 64) -> DataFrame:
    """New cells inside an object's rectangle, each with its first object: ``sheet, row, col, object``."""
    reach = F.explode(F.sequence(F.floor(F.col("top") / block), F.floor(F.col("bottom") / block))).alias("block")
    spans = oriented(objects).select("sheet", "object", *RECTANGLE, reach)
    inside = F.col("row").between(F.col("top"), F.col("bottom")) & F.col("col").between(F.col("left"), F.col("right"))
    hit = cells.select("sheet", "row", "col", F.floor(F.col("row") / block).alias("block")).join(spans, ["sheet", "block"]).where(inside)
    return hit.groupBy("sheet", "row", "col").agg(F.min("object").alias("object"))


def renumbered(sheets: DataFrame, rank: Column, tie: Column | None = None) -> DataFrame:
    """Sheets of each workbook at positions from 0 in the given order."""
    order = Window.partitionBy("workbook").orderBy(rank, *([] if tie is None else [tie]), "sheet")
    return sheets.withColumn("position", (F.row_number().over(order) - 1).cast("long"))


def sheets_created(sheets: DataFrame, new: DataFrame) -> DataFrame:
    """Sheets with each workbook's new one, ``workbook, name, position`` (null: last); its id is the next number.

    ``sheets`` has ``workbook, sheet, name, position, hidden``.
    """
    facts = sheets.groupBy("workbook").agg(F.max("sheet").alias("top"), F.count("*").alias("n"))
    made = new.join(facts, "workbook", "left").select(
        "workbook", (F.coalesce("top", F.lit(0)) + 1).alias("sheet"), "name",
        F.least(F.greatest(F.coalesce("position", "n", F.lit(0)), F.lit(0)), F.coalesce("n", F.lit(0))).cast("long").alias("position"), F.lit(False).alias("hidden"), F.lit(0).alias("old"),
    )
    both = sheets.withColumn("old", F.lit(1)).unionByName(made)
    return renumbered(both, F.col("position"), F.col("old")).drop("old")


def sheets_deleted(sheets: DataFrame, gone: DataFrame) -> DataFrame:
    """Sheets without the given ``workbook, sheet``; a workbook's last sheet stays."""
    marked = sheets.join(gone.select("workbook", "sheet").distinct().withColumn("gone", F.lit(True)), ["workbook", "sheet"], "left")
    own = Window.partitionBy("workbook")
    left = F.count(F.when(F.col("gone").isNull(), 1)).over(own)
    kept = marked.withColumn("left_over", left).where("gone IS NULL OR (left_over = 0 AND position = 0)")
    return renumbered(kept, F.col("position")).select(*sheets.columns)


def sheets_moved(sheets: DataFrame, moves: DataFrame) -> DataFrame:
    """Sheets after each workbook's move of one ``sheet`` to a ``position`` among the others."""
    to = moves.select("workbook", "sheet", F.col("position").alias("to"))
    marked = sheets.join(to, ["workbook", "sheet"], "left")
    others = renumbered(marked.where("to IS NULL"), F.col("position"))
    moved = marked.where("to IS NOT NULL").withColumn("position", F.greatest("to", F.lit(0)).cast("long"))
    return renumbered(others.unionByName(moved), F.col("position"), F.col("to").isNull()).select(*sheets.columns)


def sheets_shown(sheets: DataFrame, marks: DataFrame) -> DataFrame:
    """Sheets with the given ``workbook, sheet, hidden`` marks; a workbook that would show none keeps its own."""
    both = sheets.join(marks.select("workbook", "sheet", F.col("hidden").alias("mark")), ["workbook", "sheet"], "left").withColumn("mark", F.coalesce("mark", "hidden"))
    some = F.max((~F.col("mark")).cast("int")).over(Window.partitionBy("workbook")) == 1
    return both.withColumn("hidden", F.when(some, F.col("mark")).otherwise(F.col("hidden"))).select(*sheets.columns)


def rules_added(rules: DataFrame, new: DataFrame, prefix: str, block: int = 4096) -> DataFrame:
    """Rules with new ones, ``sheet, step, id, ...``; those without an id get the prefix and their sheet's next number.

    Steps are whole numbers, no two of a sheet alike; a sheet's rules are numbered
    by the blocks of their steps.
    """
    facts = rules.groupBy("sheet").agg(F.count("*").alias("n"))
    numbered = running(oriented(new), ["sheet"], "step", block, sums={"nth": F.lit(1)})
    made = numbered.join(facts, "sheet", "left").withColumn("id", F.coalesce("id", F.concat(F.lit(f"{prefix}-"), (F.col("nth") + F.coalesce("n", F.lit(0))).cast("string")))).drop("n", "nth")
    return rules.unionByName(made, allowMissingColumns=True)


#: Fixed value: the most characters of a validation's listed values, commas included.
LISTED_CHARS = 255


def validations_added(rules: DataFrame, new: DataFrame) -> DataFrame:
    """Data validations with new ones, ``sheet, step, id, ..., listed`` (an array of values, null: a formula).

    Listed values may hold no comma or quote and must fit in ``LISTED_CHARS``
    characters; others are refused with ``invalid-values`` and take no number.
    """
    listed = F.col("listed")
    bad = F.exists(listed, lambda v: v.rlike('[,"]')) | (F.length(F.array_join(listed, ",")) > LISTED_CHARS)
    marked = new.withColumn("error_code", F.when(bad, "invalid-values"))
    added = rules_added(rules, marked.where("error_code is null"), "validation")
    return added.unionByName(oriented(marked.where("error_code is not null")), allowMissingColumns=True)


#: Fixed value: what a table may be called.
TABLE_NAME = r"^[A-Za-z_\\][A-Za-z0-9_.\\]*$"


def tables_created(tables: DataFrame, cells: DataFrame, new: DataFrame) -> DataFrame:
    """``workbook, sheet, step, name, top, left, bottom, right, columns, error_code`` of commands that make tables.

    ``tables`` has the workbooks' tables, ``workbook, name``; ``cells`` has ``workbook,
    sheet, row, col, display``; ``new`` a rectangle, a name and a ``step`` that orders
    a workbook's commands.  Refused are tables without a row under their header
    (``no-rows``), odd names (``invalid-name``), and names that a table or an earlier
    accepted command of the workbook has, whatever its case (``name-taken``).  The
    header's cells name the columns; a blank one is called by its number.
    """
    own = oriented(new.select("workbook", "sheet", "step", "name", *RECTANGLE))
    plain = F.when(F.col("bottom") <= F.col("top"), "no-rows").when(~F.coalesce(F.col("name").rlike(TABLE_NAME), F.lit(False)), "invalid-name")
    checked = own.withColumn("plain", plain).withColumn("key", F.lower("name"))
    known = tables.select("workbook", F.lower("name").alias("key")).distinct().withColumn("known", F.lit(True))
    # of the commands that could make a name, the first one does
    earlier = F.row_number().over(Window.partitionBy("workbook", "key", F.col("plain").isNull()).orderBy("step")) > 1
    judged = checked.join(known, ["workbook", "key"], "left").withColumn("error_code", F.coalesce("plain", F.when(F.col("known") | earlier, "name-taken")))
    heads = judged.where("error_code is null").select("workbook", "sheet", "step", "left", "right", F.col("top").alias("row"))
    shown = heads.join(cells.select("workbook", "sheet", "row", "col", "display"), ["workbook", "sheet", "row"]).where("col between left and right and display <> ''")
    names = shown.groupBy("workbook", "sheet", "step").agg(F.map_from_entries(F.collect_list(F.struct(F.col("col").cast("long").alias("col"), "display"))).alias("shown"))
    full = F.transform(F.sequence(F.col("left").cast("long"), F.col("right").cast("long")), lambda c: F.coalesce(F.try_element_at("shown", c), F.concat(F.lit("Column"), (c - F.col("left") + 1).cast("string"))))
    out = judged.join(names, ["workbook", "sheet", "step"], "left")
    return out.select("workbook", "sheet", "step", "name", *RECTANGLE, F.when(F.col("error_code").isNull(), full).alias("columns"), "error_code")
