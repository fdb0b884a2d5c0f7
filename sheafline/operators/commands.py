"""Commands on a sheet in the order of their steps, for any number of commands a sheet."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.operators.rounds import running, stages
from sheafline.operators.workbook import RECTANGLE, oriented

#: Rows or columns of a sheet that make a block of a sweep.
BLOCK = 4096
#: Sweeps over rows and columns in turn.
SWEEPS = 4


def swept(rects: DataFrame, low: str, high: str) -> DataFrame:
    """``rects`` with each ``sheet, band`` cut where no rectangle goes on along one axis."""
    keys = ["sheet", "band"]
    lines = rects.groupBy(*keys, low).agg(F.max(high).alias("reach"))
    met = running(lines, keys, low, BLOCK, maxima={"met": F.col("reach")}, last=-1)
    cut = running(met, keys, low, BLOCK, sums={"cut": F.when(F.col("met") >= F.col(low), 0).otherwise(1)})
    joined = rects.join(cut.select(*keys, low, "cut"), [*keys, low])
    return joined.withColumn("band", F.xxhash64("band", "cut")).drop("cut")


def bands(rects: DataFrame, stage: Callable[..., DataFrame]) -> DataFrame:
    """Adds ``band``: rectangles of one sheet that share a cell, or a chain of them does, are of one band."""
    out = stage(rects.withColumn("band", F.lit(0).cast("long")))
    for sweep in range(SWEEPS):
        out = stage(swept(out, *(("left", "right") if sweep % 2 else ("top", "bottom"))))
    return out


class Alive:
    """The rectangles that stand at a step; all of them are disjoint."""

    def __init__(self) -> None:
        self.at: dict[tuple[int, ...], int] = {}
        self.rects = np.zeros((16, 4), np.int64)
        self.free: list[int] = list(range(16))
        self.rects[:] = (1, 1, 0, 0)  # nothing meets it

    def meets(self, top: int, left: int, bottom: int, right: int) -> bool:
        r = self.rects
        return bool(((r[:, 0] <= bottom) & (r[:, 2] >= top) & (r[:, 1] <= right) & (r[:, 3] >= left)).any())

    def add(self, rect: tuple[int, ...]) -> None:
        if not self.free:
            n = len(self.rects)
            self.rects = np.concatenate([self.rects, np.tile(np.array([[1, 1, 0, 0]]), (n, 1))])
            self.free = list(range(n, 2 * n))
        self.at[rect] = k = self.free.pop()
        self.rects[k] = rect

    def remove(self, rect: tuple[int, ...]) -> None:
        k = self.at.pop(rect, None)
        if k is not None:
            self.rects[k] = (1, 1, 0, 0)
            self.free.append(k)


def merge_decisions(merges: DataFrame, commands: DataFrame) -> DataFrame:
    """``sheet, step, kind, top, left, bottom, right, error_code`` of each command.

    ``merges`` has the disjoint rectangles that stand before, ``commands`` a rectangle,
    a ``step`` that is unique on its sheet and ``kind``: ``merge`` adds the rectangle,
    and is refused with ``overlap`` if it shares a cell with one that stands then;
    ``unmerge`` takes off the one that equals it, if there is one.

    Rectangles that no chain of shared cells joins can't affect each other.  Sweeps
    over rows and columns in turn cut a sheet into such bands; the commands of a
    band are taken in the order of their steps by a task that keeps the rectangles
    that stand, and no others.  A sheet whose commands are one chain is one band.
    """
    own = commands.select("sheet", F.col("step").cast("long").alias("step"), "kind", *(F.col(c).cast("long").alias(c) for c in RECTANGLE))
    old = merges.select("sheet", F.lit(None).cast("long").alias("step"), F.lit("merge").alias("kind"), *(F.col(c).cast("long").alias(c) for c in RECTANGLE))
    names = own.columns

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alive, place = Alive(), None
        for batch in batches:
            errors = []
            columns = [batch.column(n).to_pylist() for n in ("sheet", "band", "kind", *RECTANGLE)]
            for sheet, band, kind, *rect in zip(*columns, strict=True):
                if (sheet, band) != place:
                    alive, place = Alive(), (sheet, band)
                refused = kind == "merge" and alive.meets(*rect)
                if kind == "unmerge":
                    alive.remove(tuple(rect))
                elif not refused:
                    alive.add(tuple(rect))
                errors.append("overlap" if refused else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(errors, pa.string())], names=[*names, "error_code"])

    schema = ", ".join(f"{n} {t}" for n, t in own.dtypes) + ", error_code string"
    with stages(commands.sparkSession) as stage:
        banded = bands(oriented(own.unionByName(old)), stage)
        ordered = banded.select(*names, "band").repartition("sheet", "band").sortWithinPartitions("sheet", "band", F.asc_nulls_first("step"))
        return stage(ordered.mapInArrow(decide, schema).where("step is not null"), keep=True)


def merges_after(merges: DataFrame, decisions: DataFrame) -> DataFrame:
    """``sheet`` and rectangle of the merges that stand after all commands."""
    place = ["sheet", *RECTANGLE]
    old = oriented(merges.select("sheet", *(F.col(c).cast("long").alias(c) for c in RECTANGLE))).select(*place, F.lit(-(1 << 62)).alias("step"), F.lit("merge").alias("kind"))
    said = old.unionByName(decisions.where("error_code is null").select(*place, "step", "kind"))
    return said.groupBy(*place).agg(F.max_by("kind", "step").alias("kind")).where("kind = 'merge'").select(*place)
