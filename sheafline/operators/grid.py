"""Table cells to grid positions: spans carried from row to row, and cell edges clustered into columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheafline.operators.rounds import running, stages, tasks_for

#: Rows of a table that make a block.
BLOCK = 4096
#: Cells of a task.
PER_TASK = 50_000


def row_runs(rows: DataFrame, keys: Sequence[str], block: int = BLOCK, tasks: int | None = None) -> DataFrame:
    """Adds ``run`` to ``keys, row, reach``: consecutive rows whose spans end within them.

    A row starts a run if no earlier row's cell reaches it.
    """
    met = running(rows, keys, "row", block, maxima={"met": F.col("reach")}, last=-1, tasks=tasks)
    starts = F.when(F.col("met") > F.col("row"), 0).otherwise(1)
    return running(met, keys, "row", block, sums={"run": starts}, tasks=tasks).drop("met")


class Carry:
    """The spans that reach the present row of a table, as half-open rectangles."""

    def __init__(self) -> None:
        self.rects: list[tuple[int, int, int, int]] = []
        self.row, self.col = -1, 0

    def start(self, row: int) -> None:
        self.rects = [r for r in self.rects if r[2] > row]
        self.row, self.col = row, 0

    def place(self, row_span: int, col_span: int) -> tuple[int, int, int]:
        """Column and spans of the row's next cell: the first free place, spans cut where an earlier span is."""
        row, col = self.row, self.col
        here = sorted((left, right) for top, left, bottom, right in self.rects if top <= row < bottom)
        end = None  # where the next span of this row begins
        for left, right in here:
            if right <= col:
                continue
            if left > col:
                end = left
                break
            col = right
        wide = col_span if end is None else min(col_span, end - col)
        tops = [max(top, row + 1) for top, left, bottom, right in self.rects if left < col + wide and right > col and bottom > row + 1]
        tall = min([row_span, *(t - row for t in tops)])
        self.rects.append((row, col, row + tall, col + wide))
        self.col = col + wide
        return col, tall, wide


def placed_cells(cells: DataFrame, keys: Sequence[str], block: int = BLOCK) -> DataFrame:
    """Cells with their column ``c`` in the grid and the spans that they keep there.

    Takes any columns and ``keys, row, cell, row_span, col_span, last_row, filled`` with one row for
    each cell: ``cell`` orders a row's cells, a ``row_span`` of 0 ends with
    ``last_row``, the last row of the cell's row group, and ``filled`` says whether
    the cell shows anything.  A cell takes the first column that no earlier span
    covers; its own spans are cut where they would meet an earlier one.  Rows at
    the end in which no cell is filled go, and spans end with the last row left.
    Keys are not null.

    Rows that no span reaches and that start none need only a running sum of
    widths.  The others are placed in the order of their rows, run by run, by tasks
    that keep just the spans that are active.
    """
    spark = cells.sparkSession
    tall = F.when(F.col("row_span") == 0, F.greatest(F.col("last_row") - F.col("row") + 1, F.lit(1))).otherwise(F.greatest("row_span", F.lit(1)))
    own = cells.withColumns({"row_span": tall.cast("long"), "col_span": F.greatest("col_span", F.lit(1)).cast("long")})
    names = [*own.columns, "run"]
    schema = ", ".join(f"{n} {t}" for n, t in [*own.dtypes, ("run", "bigint"), ("c", "bigint")])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, key, row = Carry(), None, None
        for batch in batches:
            found = []
            columns = [batch.column(n).to_pylist() for n in [*keys, "run", "row", "row_span", "col_span"]]
            for *own_key, r, tall, wide in zip(*columns, strict=True):
                if own_key != key:
                    carry, key, row = Carry(), own_key, None
                if r != row:
                    carry.start(r)
                    row = r
                found.append(carry.place(tall, wide))
            c, tall, wide = (pa.array(v, pa.int64()) for v in zip(*found, strict=True)) if found else (pa.array([], pa.int64()),) * 3
            held = {n: batch.column(n) for n in names} | {"row_span": tall, "col_span": wide, "c": c}
            yield pa.RecordBatch.from_pydict({n: held[n] for n in [*names, "c"]})

    with stages(spark) as stage:
        own = stage(own)
        tasks = tasks_for(spark, own.count(), PER_TASK)
        rows = own.groupBy(*keys, "row").agg(F.max(F.col("row") + F.col("row_span")).alias("reach"), F.bool_or("filled").alias("shown"))
        runs = stage(row_runs(rows, keys, block, tasks).withColumn("place", F.floor(F.col("row") / block)))
        # what is known of a whole table or run meets its rows block by block, so that a tall table's rows stay apart
        ends = runs.where("shown").groupBy(*keys).agg(F.max("row").alias("end_row"))
        sizes = runs.groupBy(*keys, "run").agg((F.max(F.col("reach") - F.col("row")) > 1).alias("spanned"))
        blocks = runs.select(*keys, "place").distinct().join(ends, list(keys))
        at = runs.join(sizes, [*keys, "run"]).join(blocks, [*keys, "place"]).where("row <= end_row")
        known = own.repartition(tasks, *keys, "row").join(at.select(*keys, "row", "run", "spanned", "end_row"), [*keys, "row"])
        known = stage(known.withColumn("row_room", F.col("end_row") - F.col("row") + 1).drop("end_row"))

        widths = Window.partitionBy(*keys, "row").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        plain = known.where("not spanned").repartition(tasks, *keys, "row").withColumn("c", F.coalesce(F.sum("col_span").over(widths), F.lit(0)))
        tangled = known.where("spanned").select(*names).repartition(tasks, *keys, "run").sortWithinPartitions(*keys, "run", "row", "cell")
        both = plain.select(*names, "c").unionByName(tangled.mapInArrow(place, schema)).drop("run")
        ends = known.select(*keys, "row", "cell", "row_room")
        out = both.repartition(tasks, *keys, "row", "cell").join(ends, [*keys, "row", "cell"]).withColumn("row_span", F.least("row_span", "row_room")).drop("row_room", "last_row", "filled")
        return stage(out, keep=True)


def edge_columns(cells: DataFrame, keys: Sequence[str], tolerance: int) -> DataFrame:
    """Columns of cells that state only their right edges: ``keys, row, cell, c, col_span``.

    Takes ``keys, row, cell, right``.  In a row an edge at or left of the one before
    counts as one right of it.  A table's edges make clusters: from the least on,
    an edge more than ``tolerance`` over its cluster's first one starts the next.
    A cell ends in the cluster of its edge and begins where the one before ended,
    and has one column at least.

    Edges apart by more than the tolerance can't share a cluster, so clusters are
    cut island by island; only an island's distinct edges are looked at together.
    """
    place = [*keys, "row"]
    order = Window.partitionBy(*place).orderBy("cell")
    nth = F.row_number().over(order)
    # edge_i = max(right_i, edge_(i-1) + 1), so edge_i - i is a running maximum
    lifted = F.max(F.col("right") - F.col("nth")).over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("nth")
    own = cells.withColumn("nth", nth).withColumn("edge", lifted)
    edges = own.select(*keys, "edge").distinct()
    along = Window.partitionBy(*keys).orderBy("edge")
    apart = F.coalesce((F.col("edge") - F.lag("edge").over(along) > tolerance).cast("int"), F.lit(1))
    isles = edges.withColumn("apart", apart).withColumn("isle", F.sum("apart").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    firsts = F.aggregate(
        F.sort_array(F.collect_list("edge")), F.array().cast("array<bigint>"),
        lambda done, e: F.when(F.coalesce(e - F.try_element_at(done, F.lit(-1)) > tolerance, F.lit(True)), F.concat(done, F.array(e))).otherwise(done),
    )
    clusters = isles.groupBy(*keys, "isle").agg(firsts.alias("firsts")).select(*keys, F.explode("firsts").alias("first"))
    # an edge's column is the number of clusters that begin more than the tolerance before it
    points = edges.select(*keys, F.col("edge").alias("at"), F.lit(0).alias("first")).unionByName(clusters.select(*keys, (F.col("first") + tolerance).alias("at"), F.lit(1).alias("first")))
    counted = points.withColumn("before", F.sum("first").over(Window.partitionBy(*keys).orderBy("at", "first").rowsBetween(Window.unboundedPreceding, 0)))
    columns = counted.where("first = 0").select(*keys, F.col("at").alias("edge"), "before")
    known = own.join(columns, [*keys, "edge"])
    end = F.max(F.col("before") + 1 - F.col("nth")).over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("nth")
    c = F.coalesce(F.lag("end").over(order), F.lit(0))
    return known.withColumn("end", end).withColumn("c", c).select(*place, "cell", "c", (F.col("end") - F.col("c")).alias("col_span"))
