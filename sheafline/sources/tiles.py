"""Cells stored in tiles, so that a rectangle reads few files.

A cell goes to a folder by its sheet's hash and by its band of rows; within a
folder files hold ranges of (sheet, row), sorted, in small row groups.  A
rectangle names its folders, and the minima and maxima of the row groups do the
rest.  The number of folders is bounded, whatever the number of sheets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafline.operators.sheet import Area, area

#: Groups of sheets, rows of a band, bytes of a row group.
SHEETS, BAND, GROUP_BYTES = 32, 1 << 16, 4 << 20
#: Fixed value: the most cells that one ordered read may span.
MAX_CELLS = 100_000


def sheet_group(sheet: Column) -> Column:
    return F.pmod(F.xxhash64(sheet.cast("string")), F.lit(SHEETS)).cast("int")


def band_of(row: Column) -> Column:
    return F.floor((row - 1) / BAND).cast("int")


def write_tiles(cells: DataFrame, path: str, files: int | None = None) -> None:
    """Writes cells of ``sheet, row, col`` and any others; ``files`` is about how many there will be (none given: as Spark shuffles)."""
    placed = cells.withColumns({"sheets": sheet_group(F.col("sheet")), "band": band_of(F.col("row"))})
    order = ["sheets", "band", "sheet", "row"]
    dealt = placed.repartitionByRange(*order) if files is None else placed.repartitionByRange(files, *order)
    dealt.sortWithinPartitions(*order, "col").write.option("parquet.block.size", GROUP_BYTES).partitionBy("sheets", "band").parquet(path)


def read_rectangle(spark: SparkSession, path: str, sheet: str, where: str | Area) -> DataFrame:
    """The stored cells of one rectangle of one sheet."""
    top, left, bottom, right = area(where)
    stored = spark.read.parquet(path)
    here = (F.col("sheets") == sheet_group(F.lit(sheet))) & F.col("band").between((top - 1) // BAND, (bottom - 1) // BAND)
    return stored.where(here & (F.col("sheet") == sheet) & F.col("row").between(top, bottom) & F.col("col").between(left, right)).drop("sheets", "band")


def inspect(spark: SparkSession, path: str, sheet: str, where: str | Area) -> DataFrame:
    """A rectangle's cells by row and column; an error if it spans more than ``MAX_CELLS`` places."""
    top, left, bottom, right = area(where)
    if (bottom - top + 1) * (right - left + 1) > MAX_CELLS:
        raise ValueError("Inspection range is too large.")
    return read_rectangle(spark, path, sheet, where).orderBy("row", "col")


def read_rectangles(spark: SparkSession, path: str, rectangles: DataFrame) -> DataFrame:
    """``rect`` and the stored cells of each of ``rect, sheet, top, left, bottom, right``; only the folders that they name are read."""
    bands = F.explode(F.sequence(band_of(F.col("top")), band_of(F.col("bottom"))))
    asked = rectangles.select("rect", F.col("sheet").alias("own"), "top", "left", "bottom", "right", sheet_group(F.col("sheet")).alias("sheets"), bands.alias("band"))
    inside = (F.col("sheet") == F.col("own")) & F.col("row").between(F.col("top"), F.col("bottom")) & F.col("col").between(F.col("left"), F.col("right"))
    return spark.read.parquet(path).join(asked, ["sheets", "band"]).where(inside).drop("sheets", "band", "own", "top", "left", "bottom", "right")
