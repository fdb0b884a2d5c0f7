"""Documents as flat tables: HTML pages to blocks, links, lists, tables and Markdown.

A page becomes one row per block, in page order, by splitting its markup with
native expressions; lists and tables are told by running counts of their tags
along the page, and Markdown is put together from the blocks of one page.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafline.functions.text import backtick_fence, marker_ordinal
from sheafline.operators.grid import placed_cells
from sheafline.operators.rounds import tasks_for

#: Elements whose text is never shown.
HIDDEN = r"(?is)<(script|style|head|template|noscript)\b.*?</\1\s*>|<!--.*?-->"
BLOCK = (
    r"(?i)<(?=/?(?:h[1-6]|p|li|ul|ol|dl|dt|dd|div|nav|main|section|article|aside|header|footer|body|html|blockquote|pre|figure|figcaption|form|hr|table|caption|thead|tbody|tfoot|tr|td|th)\b)"
)
#: What follows a tag's name: attributes, whose quoted values may hold a bracket.
REST = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
TAG = rf"</?[A-Za-z!]{REST}|</?[A-Za-z!][^>]*>"
HREF = r"""(?i)\b{}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


@F.pandas_udf(T.StringType())
def unescaped(text: pd.Series) -> pd.Series:
    """Character references decoded, named and numeric."""
    return text.map(lambda t: html.unescape(t) if isinstance(t, str) and "&" in t else t)


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value in a start tag, quoted or not; empty where there is none."""
    values = [F.regexp_extract(tag, HREF.format(name), k) for k in (1, 2, 3)]
    return F.trim(F.concat(*values))


def plain(markup: Column) -> Column:
    """Text of a piece of markup: tags dropped, references decoded, space collapsed."""
    return F.trim(F.regexp_replace(unescaped(F.regexp_replace(markup, TAG, " ")), r"(?U)\s+", " "))


def pieces(pages: DataFrame) -> DataFrame:
    """``page_id, position, tag, attributes, body``: markup from one block tag to the next."""
    shown = F.regexp_replace(F.coalesce("html", F.lit("")), HIDDEN, " ")
    cut = pages.select("page_id", F.posexplode(F.split(shown, BLOCK)).alias("position", "piece"))
    opening = F.regexp_extract("piece", rf"(?s)^(/?[A-Za-z0-9]+{REST}|/?[A-Za-z0-9]+[^>]*>)", 1)
    own = cut.withColumn("opening", F.when(F.col("position") > 0, opening).otherwise(F.lit("")))
    body = F.substr("piece", F.length("opening") + 1)
    return own.select("page_id", "position", F.lower(F.regexp_extract("opening", r"^(/?[A-Za-z0-9]+)", 1)).alias("tag"), F.col("opening").alias("attributes"), body.alias("body"))


def heading_level(tag: Column) -> Column:
    return F.when(tag.rlike("^h[1-6]$"), F.substring(tag, 2, 1).cast("int")).otherwise(0)


def html_blocks(pages: DataFrame) -> DataFrame:
    """``page_id, position, tag, level, text`` of each block that has text."""
    blocks = pieces(pages).select("page_id", "position", "tag", plain(F.col("body")).alias("text")).where(F.col("text") != "")
    return blocks.select("page_id", "position", "tag", heading_level(F.col("tag")).alias("level"), "text")


def html_links(pages: DataFrame) -> DataFrame:
    """``page_id, position, target, label`` of each link, in page order."""
    shown = F.regexp_replace(F.coalesce("html", F.lit("")), HIDDEN, " ")
    found = pages.select("page_id", F.posexplode(F.regexp_extract_all(shown, F.lit(rf"(?is)(<a\b{REST}.*?</a\s*>)"), F.lit(1))).alias("position", "link"))
    opening = F.regexp_extract("link", rf"(?is)^<a\b{REST}", 0)
    return found.select("page_id", "position", unescaped(attribute(opening, "href")).alias("target"), plain(F.col("link")).alias("label"))


#: Characters of markup for a task: its pieces take some ten times that, in each of several sorts.
PER_TASK = 4_000_000


def page_tasks(pages: DataFrame) -> int:
    size = pages.agg(F.sum(F.length("html"))).first()[0]
    return tasks_for(pages.sparkSession, size or 0, PER_TASK)


def placed(cut: DataFrame, tasks: int) -> DataFrame:
    """Pieces of pages with their list (``depth, list_no, item_no, ordered, form, number``) and table (``table_depth, table_no, row_no, group_no, in_head, cells, cell_no``)."""
    cut = cut.repartition(tasks, "page_id")
    page = Window.partitionBy("page_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    count = lambda test, w: F.sum(test.cast("int")).over(w)
    tag = F.col("tag")
    opens, table = tag.isin("ul", "ol"), tag == "table"
    own = cut.withColumns({"depth": count(opens, page) - count(tag.isin("/ul", "/ol"), page), "table_depth": count(table, page) - count(tag == "/table", page)})
    at = Window.partitionBy("page_id", "depth").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("list_no", count(opens, at))
    at = Window.partitionBy("page_id", "depth", "list_no").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("page_id", "depth", "list_no")
    given = lambda name: F.regexp_extract("attributes", rf"""(?i)\b{name}\s*=\s*["']?(-?[0-9]{{1,9}})""", 1).try_cast("int")
    carried = lambda c: F.last(F.when(opens, c), ignorenulls=True).over(at)
    backward = F.col("attributes").rlike(r"(?i)\sreversed(?=[\s=>/])")
    form = F.regexp_extract("attributes", r"""(?i)\btype\s*=\s*["']?(?-i:([aAiI]))(?=["'\s>])""", 1)
    own = own.withColumns({"item_no": count(tag == "li", at), "ordered": carried(tag == "ol"), "first_number": carried(F.struct(given("start").alias("n"))), "step": carried(F.when(backward, -1).otherwise(1)), "form": carried(form)})
    own = own.withColumns({"items": F.max("item_no").over(whole), "told": F.last(F.when((tag == "li") & given("value").isNotNull(), F.struct("item_no", given("value").alias("n"))), ignorenulls=True).over(at)})
    first = F.coalesce("first_number.n", F.when(F.col("step") < 0, F.col("items")).otherwise(1))
    number = F.when(F.col("told").isNotNull(), F.col("told.n") + F.col("step") * (F.col("item_no") - F.col("told.item_no"))).otherwise(first + F.col("step") * (F.col("item_no") - 1))
    own = own.withColumn("number", number).drop("first_number", "step", "items", "told")
    at = Window.partitionBy("page_id", "table_depth").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("table_no", count(table, at))
    at = Window.partitionBy("page_id", "table_depth", "table_no").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    groups = tag.isin("thead", "tbody", "tfoot", "/thead", "/tbody", "/tfoot")
    own = own.withColumns({"row_no": count(tag == "tr", at), "group_no": count(groups, at), "cells": count(tag.isin("td", "th"), at), "in_head": count(tag == "thead", at) > count(tag == "/thead", at) + count(tag.isin("tbody", "tfoot"), at)})
    at = Window.partitionBy("page_id", "table_depth", "table_no", "row_no").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    return own.withColumn("cell_no", count(tag.isin("td", "th"), at))


def in_order(text: Column, separator: str = " ") -> Column:
    """Aggregate: the group's texts, by position; a group is one item or cell of a page."""
    parts = F.array_sort(F.collect_list(F.struct("position", text.alias("t"))))
    return F.array_join(F.filter(F.transform(parts, lambda p: p["t"]), lambda t: t != ""), separator)


def html_lists(pages: DataFrame) -> DataFrame:
    """``page_id, depth, list_no, item_no, ordered, number, text`` of each list item.

    An item's text is its own, without that of the lists inside it; ``number`` is
    null in lists without numbers.  Numbers begin at ``start``, or at the number of
    items where a list is ``reversed``, and go on from an item's own ``value``.
    """
    items = placed(pieces(pages), page_tasks(pages)).where("depth > 0 AND item_no > 0").withColumn("text", plain(F.col("body")))
    one = items.groupBy("page_id", "depth", "list_no", "item_no").agg(F.first("ordered").alias("ordered"), F.first("number").alias("number"), in_order(F.col("text")).alias("text"))
    return one.select("page_id", "depth", "list_no", "item_no", "ordered", F.when(F.col("ordered"), F.col("number")).alias("number"), "text")


def span(name: str) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract("attributes", rf"""(?i)\b{name}\s*=\s*["']?([0-9]{{1,5}})""", 1), F.lit("")).cast("int"), F.lit(1))


def html_tables(pages: DataFrame) -> DataFrame:
    """``page_id, table_depth, table_no, row_no, cell_no, header, in_head, last_row, row_span, col_span, text`` of each table cell.

    Spans are kept in the bounds that browsers set: 1,000 columns, 65,534 rows; a
    row span of 0 means all rows to ``last_row``, the last one of the row group.
    """
    group = Window.partitionBy("page_id", "table_depth", "table_no", "group_no")
    tasks = page_tasks(pages)
    own = placed(pieces(pages), tasks).where("table_depth > 0").withColumn("last_row", F.max("row_no").over(group))
    cells = own.where("cell_no > 0").withColumn("text", plain(F.col("body")))
    is_cell = F.col("tag").isin("td", "th")
    spans = {"row_span": F.least(span("rowspan"), F.lit(65_534)), "col_span": F.greatest(F.lit(1), F.least(span("colspan"), F.lit(1000))), "last_row": F.col("last_row"), "in_head": F.col("in_head")}
    return cells.repartition(tasks, "page_id").groupBy("page_id", "table_depth", "table_no", "row_no", "cell_no").agg(
        F.bool_or(F.col("tag") == "th").alias("header"), *(F.max(F.when(is_cell, c)).alias(n) for n, c in spans.items()), in_order(F.col("text")).alias("text")
    )


TABLE = ["page_id", "table_depth", "table_no"]


def html_table_grid(pages: DataFrame) -> DataFrame:
    """``page_id, table_depth, table_no, r, c, row_span, col_span, header_row, text`` of each cell, at its place in the grid.

    ``r`` and ``c`` are counted from 0.  ``header_row`` marks the rows at a table's
    head that are in ``thead`` or hold header cells only.
    """
    row, whole = Window.partitionBy(*TABLE, "row_no"), Window.partitionBy(*TABLE)
    heads = html_tables(pages).withColumn("head", F.bool_and(F.col("in_head") | F.col("header")).over(row))
    marked = heads.withColumn("body_row", F.min(F.when(~F.col("head"), F.col("row_no"))).over(whole))  # a table is of one page
    cells = marked.select(
        *TABLE, F.col("row_no").alias("row"), F.col("cell_no").alias("cell"), "row_span", "col_span", "last_row", (F.col("text") != "").alias("filled"),
        (F.col("row_no") < F.coalesce("body_row", F.lit(1 << 40))).alias("header_row"), "text",
    )
    return placed_cells(cells, TABLE).select(*TABLE, (F.col("row") - 1).alias("r"), "c", "row_span", "col_span", "header_row", "text")


#: Inline elements and their Markdown marks, and the private characters that stand for them and for links until text is escaped.
INLINE = (("strong|b", "**", "\ue000"), ("em|i", "*", "\ue001"), ("del|s|strike", "~~", "\ue002"), ("code|kbd|samp|tt", "`", "\ue003"))
LABEL, TARGET, END = "\ue010", "\ue011", "\ue012"


#: An attribute's value, quoted or not, as one of three groups.
VALUE = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
LINK = rf"""(?is)<a\b(?:[^>"']|"[^"]*"|'[^']*')*?\bhref{VALUE}(?:[^>"']|"[^"]*"|'[^']*')*>(.*?)</a\s*>"""
PICTURE = rf"""(?is)<img\b(?:[^>"']|"[^"]*"|'[^']*')*?\balt{VALUE}(?:[^>"']|"[^"]*"|'[^']*')*>"""


def signed(markup: Column) -> Column:
    """Markup with private characters in place of inline elements, links and pictures."""
    out = F.regexp_replace(markup, "[\ue000-\ue012]", "")
    for names, _, sign in INLINE:
        out = F.regexp_replace(out, rf"(?is)<(?:{names})(?:\s[^>]*)?>(\s*)(.*?)(\s*)</(?:{names})\s*>", f"$1{sign}$2{sign}$3")
    out = F.regexp_replace(out, LINK, f"{LABEL}$4{TARGET}$1$2$3{END}")
    return F.regexp_replace(out, PICTURE, "$1$2$3")


def settled(text: Column) -> Column:
    """Markdown of a text with those characters; what else could be a mark is escaped, targets with spaces or parentheses get brackets."""
    inside = rf"(?=[^{LABEL}{TARGET}]*{END})"
    out = F.regexp_replace(text, rf"([\\`*_\[\]<])(?![^{LABEL}{TARGET}]*{END})", r"\\$1")
    for raw, code in (("<", "%3C"), (">", "%3E"), (r"\|", "%7C")):
        out = F.regexp_replace(out, raw + inside, code)
    out = F.regexp_replace(out, rf"{TARGET} ?([^{END}]*[\s()][^{END}]*){END}", f"{TARGET}<$1>{END}")
    for _, mark, sign in INLINE:
        out = F.replace(F.replace(out, F.lit(sign * 2), F.lit("")), F.lit(sign), F.lit(mark))
    for sign, mark in ((LABEL, "["), (TARGET, "]("), (END, ")")):
        out = F.replace(out, F.lit(sign), F.lit(mark))
    return out


def inline_markdown(markup: Column) -> Column:
    """Markdown of a block's markup: emphasis, code, links and picture texts; all other marks in the text are escaped."""
    return settled(plain(signed(markup)))


def fenced(text: Column) -> Column:
    """A code block: the text as it is, in a fence longer than any in it."""
    own = F.regexp_replace(text, r"^\n|\s+$", "")
    fence = backtick_fence(own)
    return F.concat(fence, F.lit("\n"), own, F.lit("\n"), fence)


def html_markdown(pages: DataFrame) -> DataFrame:
    """``page_id, markdown``: the blocks of a page, a blank line between them; items and rows follow each other.

    Items are indented by their depth and numbered where their list is; letters and
    Roman numerals are text after a dash, as is a number below one.  An item's
    further blocks are indented without a mark.  ``pre`` is a code block.  A table's
    first row is its header.

    One pass: what stands between a block and the one before depends on these two
    alone, so a page is its blocks' texts with their beginnings, joined in order.
    """
    code = F.col("tag") == "pre"
    markup = F.when(code, F.regexp_replace("body", TAG, "")).otherwise(F.regexp_replace(signed(F.col("body")), TAG, " "))
    # texts are read before pages are dealt, as a Python step would hide how its rows lie
    read = placed(pieces(pages).withColumn("raw", unescaped(markup)).drop("body"), page_tasks(pages))
    text = F.when(code, F.when(F.trim(F.regexp_replace("raw", r"\s+", " ")) != "", fenced(F.col("raw"))).otherwise("")).otherwise(settled(F.trim(F.regexp_replace("raw", r"(?U)\s+", " "))))
    cell = (F.col("table_depth") > 0) & (F.col("cell_no") > 0)
    item = ~cell & (F.col("depth") > 0) & (F.col("item_no") > 0) & (F.col("table_depth") <= 0)
    kind = F.when(cell, F.concat_ws(".", F.lit("table"), "table_depth", "table_no")).when(item, "list").otherwise("")
    own = read.withColumns({"text": text, "glue": kind}).withColumn("used", (F.col("text") != "") | (cell & F.col("tag").isin("td", "th")))
    page = Window.partitionBy("page_id", "used").orderBy("position")
    was = lambda c: F.lag(c).over(page)
    seen = own.withColumns({
        "was": was(F.struct("glue", "row_no", "cell_no", "cells", (F.col("text") == "").alias("blank"))), "first": F.row_number().over(Window.partitionBy("page_id", "used", "depth", "list_no", "item_no", "glue").orderBy("position")) == 1, "last": F.lead("position").over(page).isNull(),
    })

    same = F.coalesce((F.col("was.glue") == F.col("glue")) & (F.col("glue") != ""), F.lit(False))
    table = lambda c: F.coalesce(F.startswith(c, F.lit("table")), F.lit(False))
    rule = lambda n: F.concat(F.lit("\n|"), F.repeat(F.lit(" --- |"), n))
    # the row that ends here is the table's first one if it has all of the table's cells so far
    ended = F.concat(F.lit(" |"), F.when(F.col("was.cells") == F.col("was.cell_no"), rule(F.col("was.cell_no"))).otherwise(""))
    left = F.concat(F.when(table(F.col("was.glue")), ended).otherwise(""), F.when(F.col("was").isNull(), "").otherwise("\n\n"))
    in_table = F.when(~same, F.concat(left, F.lit("| "))).when(F.col("was.row_no") != F.col("row_no"), F.concat(ended, F.lit("\n| "))).when(F.col("was.cell_no") != F.col("cell_no"), " | ").otherwise(F.when((F.col("text") == "") | F.col("was.blank"), "").otherwise(" "))
    opening = F.when(table(F.col("glue")), in_table).when(same, "\n").otherwise(left)

    number = F.col("number")
    forms = F.create_map(*(F.lit(x) for pair in LIST_FORMS.items() for x in pair))
    label = F.concat(marker_ordinal(F.try_element_at(forms, F.col("form")), number), F.lit(". "))
    mark = F.when(~F.col("ordered"), "- ").when(number < 0, F.concat(F.lit("- "), label)).when(number == 0, "- 0\\. ").when(F.col("form") != "", F.concat(F.lit("- "), label)).otherwise(label)
    indent = F.repeat(F.lit("  "), F.greatest(F.col("depth") - 1, F.lit(0)))
    inner = F.replace("text", F.lit("\n"), F.concat(F.lit("\n  "), indent))
    level = heading_level(F.col("tag"))
    block = F.when(level > 0, F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.col("text"))).when(F.col("tag") == "blockquote", F.concat(F.lit("> "), F.col("text"))).otherwise(F.col("text"))
    shown = F.when(table(F.col("glue")), F.replace(F.replace("text", F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))).when(F.col("glue") == "list", F.concat(indent, F.when(F.col("first"), mark).otherwise("  "), inner)).otherwise(block)
    rest = F.when(F.col("last") & table(F.col("glue")), F.concat(F.lit(" |"), F.when(F.col("cells") == F.col("cell_no"), rule(F.col("cell_no"))).otherwise(""))).otherwise("")
    lines = F.collect_list(F.when(F.col("used"), F.struct("position", F.concat(opening, shown, rest).alias("line"))))  # one page's blocks
    return seen.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(lines), lambda x: x["line"]), "").alias("markdown"))


#: List types and the marker forms that they stand for.
LIST_FORMS = {"a": "lower-alpha", "A": "upper-alpha", "i": "lower-roman", "I": "upper-roman"}


def markdown_counts(docs: DataFrame, column: str = "text") -> DataFrame:
    """Characters, lines, headings, table rows, list items and links of Markdown."""
    c = F.col(column)
    hits = lambda pattern: F.regexp_count(c, F.lit(pattern))
    return docs.select(
        "*",
        F.length(c).alias("chars"),
        hits(r"(?m)^#{1,6} ").alias("headings"),
        hits(r"(?m)^\|").alias("table_rows"),
        hits(r"(?m)^ *(?:[-*+]|[0-9]+\.) ").alias("list_items"),
        hits(r"\]\(").alias("links"),
        hits(r"(?m)^\[\^[^\]]+\]:").alias("footnotes"),
    )


def matching_lines(docs: DataFrame, needle: str, key: str = "doc_id") -> DataFrame:
    """``key, line_no, line`` of the lines that contain the text, without regard to case."""
    lines = docs.select(key, F.posexplode(F.split("text", "\r?\n")).alias("line_no", "line"))
    return lines.where(F.contains(F.lower("line"), F.lit(needle.lower())))


def runs_of_roles(turns: DataFrame) -> DataFrame:
    """Consecutive turns of one role in a conversation, as one row each (gaps and islands)."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    change = F.coalesce((F.col("role") != F.lag("role").over(order)).cast("int"), F.lit(1))
    numbered = turns.withColumn("change", change).withColumn("run", F.sum("change").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("conv_id", "run", "role").agg(F.min("turn").alias("first_turn"), F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))


def trigrams(rows: DataFrame, key: str) -> DataFrame:
    """``key, g``: a 64-bit hash of each word trigram of each text, repeated ones included.

    The words are a column of their own, so they are split once and not again for
    each trigram.
    """
    words = rows.select(key, F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "").alias("w")).where(F.size("w") >= 3)
    at = lambda i: F.get("w", i)
    return words.select(key, F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)))).alias("g"))


def containment(docs: DataFrame, probes: DataFrame) -> DataFrame:
    """Share of each probe's distinct word trigrams that each document has.

    Trigrams meet as 64-bit hashes, so only hits are made distinct and counted;
    pairs without a shared trigram give no row.  A document's trigram counts wrongly
    as one of ``n`` probes' with a chance of n in 2 ** 64.
    """
    asked = trigrams(probes, "item_id").distinct()
    sizes = asked.groupBy("item_id").agg(F.count("*").alias("n"))
    hits = trigrams(docs, "doc_id").join(asked, "g").distinct().groupBy("doc_id", "item_id").agg(F.count("*").alias("hits"))
    return hits.join(sizes, "item_id").select("doc_id", "item_id", (F.col("hits") / F.col("n")).alias("containment"))


def trigram_set(text: Column) -> Column:
    """The distinct word trigrams of a text; null: none."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    many = F.greatest(F.size(words) - 2, F.lit(0))
    triples = F.arrays_zip(F.slice(words, 1, many).alias("a"), F.slice(words, 2, many).alias("b"), F.slice(words, 3, many).alias("c"))
    return F.array_distinct(F.transform(triples, lambda p: F.concat_ws(" ", p["a"], p["b"], p["c"])))


def text_containment(expected: Column, actual: Column) -> Column:
    """Share of one text's distinct word trigrams that another text of the row has; 1.0 where there are none."""
    asked = trigram_set(expected)
    return F.when(F.size(asked) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(asked, trigram_set(actual))) / F.size(asked))
