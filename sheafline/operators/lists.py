"""Lists and runs of a document from flat entries: gaps and islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 9


def list_islands(entries: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``doc_id, position, level, list_start, item, start``: each entry's list, named by its first entry.

    Takes ``doc_id, position, level`` (0 to ``levels`` - 1), ``key, ordered,
    number``.  An entry goes on its last sibling's list, which is the last entry of
    its level with no lower one in between, if the key is the same and, in ordered
    lists, the number is the next one.
    """
    before = Window.partitionBy("doc_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("doc_id", "level").orderBy("position")
    lower = F.array(*(F.max(F.when(F.col("level") < k, F.col("position"))).over(before) for k in range(levels)))
    seen = entries.select("doc_id", "position", "level", "key", "ordered", "number", F.element_at(lower, F.col("level").cast("int") + 1).alias("lower"))
    sibling = F.lag(F.struct("position", "key", "number")).over(same)
    seen = seen.withColumn("s", sibling)
    inside = F.col("s").isNotNull() & (F.col("lower").isNull() | (F.col("lower") < F.col("s.position")))
    goes_on = inside & F.col("s.key").eqNullSafe(F.col("key")) & (~F.col("ordered") | (F.col("number") == F.col("s.number") + 1))
    so_far = same.rowsBetween(Window.unboundedPreceding, 0)
    named = seen.withColumn("first", ~F.coalesce(goes_on, F.lit(False))).withColumn("list_start", F.max(F.when(F.col("first"), F.col("position"))).over(so_far))
    own = Window.partitionBy("doc_id", "level", "list_start").orderBy("position")
    start = F.when(F.col("ordered"), F.first("number").over(own)).otherwise(1)
    return named.select("doc_id", "position", "level", "list_start", F.row_number().over(own).alias("item"), start.cast("long").alias("start"))


def merged_runs(runs: DataFrame) -> DataFrame:
    """``paragraph, position, kind, style, text``: the runs of a paragraph, joined where nothing tells them apart.

    Takes runs of these columns; ``style`` is empty for plain text and only runs of
    kind ``text`` are joined.  Empty runs go and blank ones lose their style.
    Neighbours of one style are one run, and so are two styled ones, but for
    ``code``, with nothing but white space between them.  A run keeps the place of
    its first part.
    """
    text = F.col("kind") == "text"
    blank = F.trim(F.regexp_replace("text", r"(?U)\s+", " ")) == ""
    own = runs.where(~text | (F.coalesce("text", F.lit("")) != "")).withColumn("style", F.when(text & blank, "").otherwise(F.coalesce("style", F.lit(""))))
    order = Window.partitionBy("paragraph").orderBy("position")

    def joined(rows: DataFrame, starts: Column) -> DataFrame:
        isles = rows.withColumn("starts", starts.cast("int")).withColumn("isle", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        parts = F.array_sort(F.collect_list(F.struct("position", "text", "style", "kind")))
        one = isles.groupBy("paragraph", "isle").agg(parts.alias("p"))  # a paragraph's runs
        return one.select("paragraph", F.element_at("p", 1)["position"].alias("position"), F.element_at("p", 1)["kind"].alias("kind"), F.element_at("p", 1)["style"].alias("style"), F.array_join(F.transform("p", lambda x: F.coalesce(x["text"], F.lit(""))), "").alias("text"))

    before = lambda c: F.lag(c).over(order)
    alike = F.coalesce(text & (before("kind") == "text") & (before("style") == F.col("style")), F.lit(False))
    isles = joined(own, ~alike)
    held = F.lead("style").over(order)
    bridge = text & blank & (F.col("style") == "") & (before("kind") == "text") & (F.lead("kind").over(order) == "text") & (before("style") == held) & (held != "") & (held != "code")
    marked = isles.withColumn("bridge", F.coalesce(bridge, F.lit(False)))
    return joined(marked, ~(F.col("bridge") | F.coalesce(before("bridge"), F.lit(False))))
