"""Whether a table's first row names its columns, by what stands below it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Body rows that are looked at, the share of a column that must be of one kind, the longest label.
SAMPLE_ROWS, MOST_LABEL = 50, 64
SHARE = (9, 10)
TRUTH = ("true", "false", "yes", "no")
CLOCK = r"[0-9]{1,4}:[0-9]{1,4}(?::[0-9]{1,4})?"
MOMENT = rf"^(?:[0-9]{{1,4}}([-/.])[0-9]{{1,4}}\1[0-9]{{1,4}}(?:[T ](?:{CLOCK})?(?:\..*)?Z*)?|{CLOCK}(?:[T ](?:\..*)?Z*)?)$"
NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


def folded(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def cell_kind(c: Column) -> Column:
    """number, bool, date or text; null where the cell is blank."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")
    digits = F.regexp_replace(F.regexp_replace(t, "%$", ""), "[, _\u00a0]", "")
    return F.when(t == "", None).when(digits.rlike(NUMBER), "number").when(F.lower(t).isin(*TRUTH), "bool").when(t.rlike(MOMENT), "date").otherwise("text")


def header_rows(cells: DataFrame, keys: Sequence[str], declared: str | None = None) -> DataFrame:
    """``keys, header_rows`` of each table: what a column ``declared`` says if above 0, else 1 or 0.

    ``cells`` has ``keys, row, col, row_span, col_span, text``, rows and columns from
    0.  The first row names the columns if it has no spans and the width that most
    of the first 50 rows below have, if its labels are single lines, all different
    and, but for the first one, filled up to the last column with content, and if
    more columns say so than say no: a column of numbers, dates or truth values
    says yes under a text and no under a label of its kind, a text column says no
    if its label stands in it again.  Where no column says anything, short labels
    do.  Only a table's first 51 rows are looked at, so a task holds no long table.
    """
    keys = list(keys)
    own = cells.where(F.col("row") <= SAMPLE_ROWS).withColumns({"kind": cell_kind(F.col("text")), "fold": folded(F.coalesce("text", F.lit("")))})
    reach = own.select(*keys, (F.col("col") + F.col("col_span")).alias("end"), F.explode(F.sequence(F.col("row").cast("long"), F.least(F.col("row") + F.col("row_span") - 1, F.lit(SAMPLE_ROWS)).cast("long"))).alias("r"))
    widths = reach.groupBy(*keys, "r").agg(F.max("end").alias("width"))
    shape = widths.groupBy(*keys).agg(F.max(F.when(F.col("r") == 0, F.col("width"))).alias("head_width"), F.count("*").alias("rows"))
    modal = widths.where("r > 0").groupBy(*keys, "width").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.max_by("width", F.struct("n", "width")).alias("modal"))
    content = own.groupBy(*keys).agg((F.max(F.when(F.col("kind").isNotNull(), F.col("col"))) + 1).alias("content"))
    heads = own.where("row = 0").select(*keys, "col", F.col("text").alias("label"), F.col("fold").alias("label_fold"), F.col("kind").alias("label_kind"), ((F.col("row_span") != 1) | (F.col("col_span") != 1)).alias("spans"))
    named = heads.join(content, keys).where("col < content")
    filled = F.col("label_kind").isNotNull()
    labels = named.groupBy(*keys).agg(
        F.count(F.when(~filled & (F.col("col") > 0), 1)).alias("gaps"), F.count(F.when(F.contains("label", F.lit("\n")), 1)).alias("tall"),
        (F.count(F.when(filled, 1)) - F.count_distinct(F.when(filled, F.col("label_fold")))).alias("twice"), F.max(F.coalesce(F.length("label"), F.lit(0))).alias("longest"),
    )
    spanned = heads.groupBy(*keys).agg(F.bool_or("spans").alias("spanned"))

    body = own.where("row > 0 and kind is not null").join(heads.select(*keys, "col", "label_fold", "label_kind"), [*keys, "col"])
    kinds = ("number", "bool", "date", "text")
    tally = body.groupBy(*keys, "col", "label_kind").agg(F.count("*").alias("n"), F.bool_or(F.col("fold") == F.col("label_fold")).alias("again"), *(F.count_if(F.col("kind") == k).alias(k) for k in kinds))
    most = F.coalesce(*(F.when(F.col(k) * SHARE[1] >= F.col("n") * SHARE[0], F.lit(k)) for k in kinds))
    typed = F.coalesce(most != "text", F.lit(False))
    yes = typed & (F.col("label_kind") == "text")
    said = tally.withColumns({"yes": F.coalesce(yes, F.lit(False)), "no": F.when(typed, ~F.coalesce(yes, F.lit(False))).otherwise(F.col("again"))})
    votes = said.groupBy(*keys).agg(F.count_if("yes").alias("yes"), F.count_if("no").alias("no"))

    facts = shape
    for part in (modal, content, labels, spanned, votes):
        facts = facts.join(part, keys, "left")
    shaped = (F.col("rows") >= 2) & ~F.col("spanned") & (F.col("head_width") == F.col("modal")) & (F.col("content") <= F.col("head_width")) & (F.col("gaps") == 0) & (F.col("tall") == 0) & (F.col("twice") == 0)
    ayes, noes = F.coalesce("yes", F.lit(0)), F.coalesce("no", F.lit(0))
    vote = F.when((ayes == 0) & (noes == 0), F.col("longest") <= MOST_LABEL).otherwise(ayes > noes)
    found = F.when(F.coalesce(shaped & vote, F.lit(False)), 1).otherwise(0)
    if declared is None:
        return facts.select(*keys, found.alias("header_rows"))
    told = cells.groupBy(*keys).agg(F.max(declared).alias("told"), (F.max(F.col("row") + F.col("row_span"))).alias("height"))
    return facts.join(told, keys, "left").select(*keys, F.when(F.col("told") > 0, F.least("told", "height")).otherwise(found).cast("int").alias("header_rows"))
