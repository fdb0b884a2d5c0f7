"""What formulas depend on: references and ranges, the order of evaluation, cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.functions.coordinates import address_parts
from sheafline.functions.formulas import tokens
from sheafline.operators.rounds import stages

PLACE = ("sheet", "row", "col")


def formula_words(formula: Column) -> Column:
    """A formula's tokens but white space."""
    return F.filter(tokens(formula), lambda t: ~t.rlike(r"^\s+$"))


def references(words: str) -> Column:
    """``sheet, top, left, bottom, right`` of each reference or range among a column's ``formula_words``; ``sheet`` is null for the own one.

    A word before a parenthesis is a function, whatever it looks like.  The words are
    a column of their own, as each one is read with its neighbours.
    """
    all_tokens = F.col(words)

    def read(t: Column, i: Column) -> Column:
        near = lambda k: F.get(all_tokens, i + k)
        bare = F.substring_index(t, "!", -1)
        quoted = F.coalesce(F.endswith(near(-1), F.lit("'!")), F.lit(False))
        written = F.when(quoted, F.replace(F.substr(near(-1), F.lit(2), F.length(near(-1)) - 3), F.lit("''"), F.lit("'"))).when(F.contains(t, F.lit("!")), F.substr(t, F.lit(1), F.length(t) - F.length(bare) - 1))
        at = F.when(~F.coalesce(near(1) == "(", F.lit(False)), address_parts(bare))
        # the other end of a range may name its sheet again
        ends = F.coalesce(near(1) == ":", F.lit(False))
        far = F.when(ends & F.endswith(near(2), F.lit("'!")), near(3)).when(ends, F.substring_index(near(2), "!", -1))
        end = F.coalesce(address_parts(far), at)
        starts = F.coalesce(F.when(quoted, near(-2)).otherwise(near(-1)) == ":", F.lit(False))
        box = F.struct(
            F.lower(written).alias("sheet"), F.least(at["row"], end["row"]).alias("top"), F.least(at["column"], end["column"]).alias("left"),
            F.greatest(at["row"], end["row"]).alias("bottom"), F.greatest(at["column"], end["column"]).alias("right"),
        )
        return F.when(at.isNotNull() & ~starts, box)

    return F.filter(F.transform(all_tokens, read), lambda b: b.isNotNull())


#: Nodes of the halved rows of a column and columns of a row: ``axis, line, size, nth``.
ROWS, COLUMNS = 21, 15


def above(row: Column, col: Column) -> Column:
    """The nodes that hold a cell."""
    down = F.transform(F.sequence(F.lit(0), F.lit(ROWS)), lambda s: F.struct(F.lit("r").alias("axis"), col.cast("long").alias("line"), s.alias("size"), F.floor(row / F.pow(F.lit(2), s)).alias("nth")))
    along = F.transform(F.sequence(F.lit(0), F.lit(COLUMNS)), lambda s: F.struct(F.lit("c").alias("axis"), row.cast("long").alias("line"), s.alias("size"), F.floor(col / F.pow(F.lit(2), s)).alias("nth")))
    return F.concat(down, along)


def halves(first: Column, last: Column, sizes: int) -> Column:
    """The fewest aligned stretches of 1, 2, 4, ... places that make up an interval, as ``size, nth``.

    From the smallest size on, an end that does not lie on the next size's border is
    a stretch of its own.
    """

    def step(done: Column, s: Column) -> Column:
        lo, hi = done["lo"], done["hi"]
        odd = (lo <= hi) & (lo % 2 == 1)
        even = (lo <= hi) & (hi % 2 == 0) & ~(odd & (lo == hi))
        one = lambda test, n: F.when(test, F.array(F.struct(s.alias("size"), n.alias("nth")))).otherwise(F.array().cast("array<struct<size:int,nth:bigint>>"))
        after = (F.floor((lo + 1) / 2), F.floor((hi - 1) / 2))
        return F.struct(F.concat(done["out"], one(odd, lo), one(even, hi)).alias("out"), after[0].alias("lo"), F.floor((hi + 1) / 2 - 1).alias("hi"))

    begin = F.struct(F.array().cast("array<struct<size:int,nth:bigint>>").alias("out"), first.cast("long").alias("lo"), last.cast("long").alias("hi"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(sizes)), begin, step, lambda done: done["out"])


def below(box: Column) -> Column:
    """The nodes that make up a rectangle: halved along its longer side, line by line along the shorter one."""
    tall = box["bottom"] - box["top"] >= box["right"] - box["left"]
    lines = F.when(tall, F.sequence(box["left"], box["right"])).otherwise(F.sequence(box["top"], box["bottom"]))
    parts = F.when(tall, halves(box["top"], box["bottom"], ROWS)).otherwise(halves(box["left"], box["right"], COLUMNS))
    axis = F.when(tall, "r").otherwise("c")
    return F.flatten(F.transform(lines, lambda n: F.transform(parts, lambda p: F.struct(axis.alias("axis"), n.cast("long").alias("line"), p["size"].alias("size"), p["nth"].alias("nth")))))


def formula_levels(cells: DataFrame) -> DataFrame:
    """``sheet, row, col, level, error_code`` of each cell of ``sheet, row, col, formula`` that has a formula.

    Level 0 depends on no formula, each other one on the level before at the latest.
    Cells on a cycle, and those that depend on one, have no level and ``#CYCLE!``; a
    cell with a reference to a sheet that has no cell has ``#REF!``.  Sheets are
    told apart without case.

    A range is never made into its cells: it is a few aligned stretches of rows or
    columns, and a cell lies in one stretch of each size.  A round gives a level to
    the cells whose stretches hold no open formula, so the rounds are the levels.
    """
    spark = cells.sparkSession
    node = ["of", "axis", "line", "size", "nth"]
    big = lambda df: df.hint("merge")  # noqa: E731  (small on disk, not in memory: the driver would build it for a broadcast)
    with stages(spark) as stage:
        named = cells.withColumn("of", F.lower(F.col("sheet").cast("string")))
        formulas = named.where("formula is not null").select(*PLACE, "of", formula_words(F.col("formula")).alias("words"))
        formulas = stage(formulas.select(*PLACE, "of", references("words").alias("refs")))
        boxes = formulas.select(*PLACE, "of", F.explode("refs").alias("box")).withColumn("of", F.coalesce("box.sheet", "of"))
        broken = boxes.join(big(named.select("of").distinct()), "of", "left_anti").select(*PLACE).distinct().withColumn("error_code", F.lit("#REF!"))
        needs = boxes.select(*PLACE, "of", F.explode(below(F.col("box"))).alias("n")).select(*PLACE, "of", "n.*")
        holds = formulas.select(*PLACE, "of", F.explode(above(F.col("row"), F.col("col"))).alias("n")).select(*PLACE, "of", "n.*")
        needs = stage(needs.join(big(holds.select(*node).distinct()), node, "left_semi"))  # stretches without formulas never wait
        holds = stage(holds.join(big(needs.select(*node).distinct()), node, "left_semi"))
        open_, done, level = formulas.select(*PLACE), None, 0
        while True:
            waiting = needs.join(big(open_), list(PLACE), "left_semi").join(big(holds.join(big(open_), list(PLACE), "left_semi").select(*node).distinct()), node, "left_semi").select(*PLACE).distinct()
            split = stage(open_.join(big(waiting.withColumn("waits", F.lit(True))), list(PLACE), "left"))
            ready = split.where("waits is null").select(*PLACE, F.lit(level).alias("level"))
            if ready.isEmpty():
                break
            done = ready if done is None else done.unionByName(ready)
            open_ = split.where("waits").select(*PLACE)
            level += 1
        stuck = open_.select(*PLACE, F.lit(None).cast("int").alias("level"), F.lit("#CYCLE!").alias("cycle"))
        levels = stuck if done is None else done.withColumn("cycle", F.lit(None).cast("string")).unionByName(stuck)
        out = levels.join(big(broken), list(PLACE), "left").select(*PLACE, "level", F.coalesce("cycle", "error_code").alias("error_code"))
        return stage(out, keep=True)
