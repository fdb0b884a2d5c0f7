"""Queries on changed cells and sheets, lists, job states and single values."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafline.functions import text as X
from sheafline.functions import values as V
from sheafline.operators import commands as C
from sheafline.operators import documents as D
from sheafline.operators import lists as I
from sheafline.operators import sheet as S
from sheafline.operators import table as T_
from sheafline.operators import workbook as W
from sheafline.plans.table_queries import load
from sheafline.sources.files import delimiter_score
from sheafline.streaming import jobs as J


def sheet_rows(s, d):
    """Parts as rectangles: sheet, merge id, top, left, bottom, right."""
    key, size = F.col("p_partkey"), F.col("p_size")
    return load(s, d, "part").select(F.floor(key / 200).alias("sheet"), key.alias("id"), key.alias("top"), (size % 5 + 1).cast("long").alias("left"), (key + size % 4).alias("bottom"), (size % 5 + 2).cast("long").alias("right"))


def tall_sheet_rows(s, d):
    """The same rectangles on three sheets, which grow with the table."""
    return sheet_rows(s, d).withColumn("sheet", F.col("id") % 3)


def format_ranges(s, d):
    part = load(s, d, "part")
    cells = part.select(F.floor(F.col("p_partkey") / 200).alias("sheet"), F.col("p_partkey").alias("row"), F.lit(2).cast("long").alias("col"), F.col("p_name").alias("str"), F.create_map(F.lit("font"), F.col("p_brand"), F.lit("fill"), F.lit("none")).alias("style"))
    commands = sheet_rows(s, d).select("sheet", F.col("id").alias("step"), *W.RECTANGLE, F.create_map(F.lit("fill"), F.col("id").cast("string")).alias("style"))
    out = W.formatted_ranges(cells, commands)
    return out.select("sheet", "row", "col", "str", F.try_element_at("style", F.lit("fill")).alias("fill"), F.try_element_at("style", F.lit("font")).alias("font"))


def axis_sizes(s, d):
    part = load(s, d, "part")
    axes = part.select(F.floor(F.col("p_partkey") / 200).alias("sheet"), F.lit("row").alias("axis"), F.col("p_partkey").alias("index"), F.col("p_size").cast("double").alias("size"), F.lit(False).alias("hidden"))
    commands = sheet_rows(s, d).select("sheet", F.lit("row").alias("axis"), F.col("top").alias("first"), F.col("bottom").alias("last"), F.col("id").alias("step"), F.when(F.col("id") % 2 == 0, F.col("right").cast("double")).alias("size"), F.when(F.col("id") % 5 == 0, F.lit(True)).alias("hidden"))
    return W.resized(axes, commands)


def merge_changes(s, d):
    """Every third rectangle is stored; some of the stored ones are taken off, then others added."""
    own = sheet_rows(s, d).withColumn("sheet", F.floor(F.col("id") / 3).cast("long"))
    stored, new = own.where("id % 3 = 0"), own.where("id % 3 = 1").select("sheet", F.col("id").alias("step"), F.lit("merge").alias("kind"), *W.RECTANGLE)
    gone = stored.where("id % 2 = 0").select("sheet", F.col("id").alias("step"), F.lit("unmerge").alias("kind"), F.col("bottom").alias("top"), F.col("right").alias("left"), F.col("top").alias("bottom"), F.col("left").alias("right"))
    decided = C.merge_decisions(stored, new.unionByName(gone)).select("sheet", "kind", *W.RECTANGLE, "error_code")
    kept = stored.join(decided.where("kind = 'unmerge'"), ["sheet", *W.RECTANGLE], "left_anti").select("sheet", *W.RECTANGLE, F.lit(None).cast("string").alias("error_code"))
    return kept.unionByName(decided.where("kind = 'merge'").drop("kind"))


def clipped_ranges(s, d):
    own = sheet_rows(s, d)
    cells = own.where("id % 2 = 0").select("sheet", F.col("top").alias("row"), F.col("left").alias("col"))
    swapped = own.select("sheet", "id", F.col("bottom").alias("top"), F.col("right").alias("left"), F.col("top").alias("bottom"), F.col("left").alias("right"))
    return W.clipped(swapped, W.used_range(cells))


def object_collisions(s, d):
    own = tall_sheet_rows(s, d)
    cells = own.where("id % 2 = 1").select("sheet", F.col("bottom").alias("row"), F.col("right").alias("col")).distinct()
    return W.content_under_objects(cells, own.where("id % 2 = 0").withColumnRenamed("id", "object"))


def workbook_sheets(s, d):
    """Suppliers as sheets of their nations' workbooks; created, moved, deleted and hidden in this order."""
    own = load(s, d, "supplier")
    sheets = W.renumbered(own.select(F.col("s_nationkey").alias("workbook"), F.col("s_suppkey").alias("sheet"), F.col("s_name").alias("name"), F.lit(0).cast("long").alias("position"), F.lit(False).alias("hidden")), F.col("sheet"))
    first = own.groupBy(F.col("s_nationkey").alias("workbook")).agg(F.min("s_suppkey").alias("low"), F.max("s_suppkey").alias("sheet"))
    now = W.sheets_created(sheets, first.select("workbook", F.lit("new").alias("name"), F.lit(1).alias("position")))
    now = W.sheets_moved(now, first.select("workbook", "sheet", F.lit(0).alias("position")))
    now = W.sheets_deleted(now, first.select("workbook", F.col("low").alias("sheet")))
    return W.sheets_shown(now, now.select("workbook", "sheet", (F.col("workbook") % 2 == 0) | (F.col("position") == 0)).toDF("workbook", "sheet", "hidden"))


def rule_ids(s, d):
    own = tall_sheet_rows(s, d)
    rules = own.where("id % 4 = 0").select("sheet", F.col("id").alias("step"), F.concat(F.lit("own-"), F.col("id").cast("string")).alias("id"), *W.RECTANGLE)
    new = own.where("id % 4 <> 0").select("sheet", F.col("id").alias("step"), F.when(F.col("id") % 4 == 1, F.concat(F.lit("given-"), F.col("id").cast("string"))).alias("id"), *W.RECTANGLE)
    return W.rules_added(rules, new, "cf").select("sheet", "step", "id")


def validation_rules(s, d):
    """Parts as validations of their sheets, every fourth stored; values with commas or beyond the room are refused."""
    own = sheet_rows(s, d).withColumn("sheet", F.floor(F.col("id") / 40).cast("long"))
    rules = own.where("id % 4 = 0").select("sheet", F.col("id").alias("step"), F.concat(F.lit("own-"), F.col("id").cast("string")).alias("id"), *W.RECTANGLE)
    listed = F.when(F.col("id") % 4 == 1, F.array(F.lit("a"), F.when(F.col("id") % 3 == 0, "b,c").otherwise("b"))).when(F.col("id") % 4 == 2, F.array_repeat(F.lit("twelve chars"), (F.col("id") % 30).cast("int")))
    new = own.where("id % 4 <> 0").select("sheet", F.col("id").alias("step"), F.lit(None).cast("string").alias("id"), *W.RECTANGLE, listed.alias("listed"))
    return W.validations_added(rules, new).select("sheet", "step", "id", "error_code")


def tables_created(s, d):
    """Suppliers as tables of their nations' workbooks, headed by the customers of the same number."""
    k = F.col("s_suppkey")
    own = load(s, d, "supplier").select(
        F.col("s_nationkey").alias("workbook"), (k % 3).alias("sheet"), k.alias("step"), F.concat(F.get(F.array(*map(F.lit, ("T", "t", "1", "_x.", "a b"))), (k % 5).cast("int")), (k % 4).cast("string")).alias("name"),
        (k % 9 + 1).alias("top"), F.lit(2).cast("long").alias("left"), (k % 9 + 1 + F.when(k % 7 == 0, 0).otherwise(3)).alias("bottom"), (k % 3 + 3).alias("right"),
    )
    c = F.col("c_custkey")
    cells = load(s, d, "customer").select(F.col("c_nationkey").alias("workbook"), (c % 3).alias("sheet"), (F.floor(c / 3) % 9 + 1).alias("row"), (F.floor(c / 27) % 6 + 1).alias("col"), F.when(c % 5 == 0, "").otherwise(F.col("c_name")).alias("display"), "c_custkey")
    least = cells.groupBy("workbook", "sheet", "row", "col").agg(F.min_by("display", "c_custkey").alias("display"))
    old = own.where("step % 11 = 0").select("workbook", F.lower("name").alias("name"))
    made = W.tables_created(old, least, own.where("step % 11 <> 0"))
    return made.withColumn("columns", F.array_join("columns", "|"))


def pivot_cells(s, d):
    """Orders pivoted by status and priority, written over cells of the nations."""
    orders = load(s, d, "orders").withColumn("place", F.col("o_orderkey"))
    nation = load(s, d, "nation")
    cells = S.to_cells(nation, F.col("n_nationkey") + 1, ["n_nationkey", "n_name", "n_regionkey"])
    out = S.pivot_written(cells, orders, ["o_orderstatus", "o_orderpriority"], [T_.Metric("count", "o_orderkey", "n"), T_.Metric("maximum", "o_custkey", "last")], "place", "B3:C4", source_at=("data", "A1:Z99"))
    return out.select("sheet", "row", "col", "num", "str")


def filled_formulas(s, d):
    """A formula filled down all rows of the parts' sheet, over cells that stand there."""
    cells = S.to_cells(load(s, d, "part"), F.col("p_partkey") + 1, ["p_partkey", "p_size"])
    last = load(s, d, "part").agg(F.max("p_partkey")).first()[0] + 1
    return S.fill_formula(cells, (2, 2, last, 3), "=A1*$A$1+B$1").select("row", "col", "num", "formula")


def merged_runs(s, d):
    """Ten parts a paragraph as runs of three styles, some of them blank."""
    k, size = F.col("p_partkey"), F.col("p_size")
    style = F.get(F.array(*map(F.lit, ("bold", "", "bold", "code", "bold"))), (size % 5).cast("int"))
    text = F.when(size % 3 == 0, " ").when(size % 13 == 0, "").otherwise(F.concat(F.lit("p"), k.cast("string")))
    runs = load(s, d, "part").select(F.floor(k / 10).alias("paragraph"), k.alias("position"), F.when(size == 50, "link").otherwise("text").alias("kind"), style.alias("style"), text.alias("text"))
    return I.merged_runs(runs).select("paragraph", "position", "kind", "style", "text")


def delimiter_scores(s, d):
    """How well comma, semicolon and tab part each document's lines."""
    own = load(s, d, "documents")
    return own.select("doc_id", *(delimiter_score(F.col("text"), c).alias(n) for n, c in (("comma", ","), ("semicolon", ";"), ("tab", "\t"))))


def list_items(s, d):
    """Conversation turns as list entries."""
    size = F.length("text")
    own = load(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("position"), (size % 3).alias("level"), (size % 2).alias("key"), (size % 2 == 0).alias("ordered"), F.floor(F.col("turn") / 2).cast("long").alias("number"))
    return I.list_islands(own)


def started_jobs(s, d):
    e = F.col("event_id")
    state = F.element_at(F.array(*map(F.lit, ("running", "running", "running", "succeeded", "queued"))), (e % 5 + 1).cast("int"))
    return load(s, d, "events").select(e.alias("job_id"), state.alias("state"), (F.col("user_id") % 4 + 1).alias("attempt"), F.col("event_type"))


def job_results(s, d):
    """Events as jobs, some with results, some of them cancelled, with the changes that observers see."""
    jobs = started_jobs(s, d)
    results = jobs.where("job_id % 7 <> 0").select("job_id", F.when(F.col("job_id") % 3 == 0, "fetch-failed").when(F.col("job_id") % 3 == 1, "no such code").alias("error_code"), (F.col("job_id") % 2 == 0).alias("retryable"))
    after = J.after_results(jobs, results, F.lit(1000))
    final = J.cancelled(after, jobs.where("job_id % 11 = 0"))
    return final.join(J.transitions(jobs, final).withColumn("seen", F.lit(True)).select("job_id", "was", "seen"), "job_id", "left")


def failure_texts(s, d):
    own = load(s, d, "documents").select("doc_id", "text", J.encoded_failure(F.lit("malformed"), F.col("text"), F.col("doc_id") % 2 == 0, F.lit("csv"), F.lit(415)).alias("line"))
    got = J.decoded_failure(F.concat(F.lit("worker said "), "line"))
    lost = J.decoded_failure(F.replace("line", F.lit("version"), F.lit("revision")))
    return own.select("doc_id", F.sha2(got["message"], 256).alias("message"), got["code"].alias("code"), got["retryable"].alias("retryable"), got["status"].alias("status"), lost.isNull().alias("lost"))


def cell_texts(s, d):
    own = load(s, d, "part").withColumns({"n": F.col("p_retailprice") / 7, "f": F.when(F.col("p_partkey") % 2 == 0, "A1+1")})
    return own.select(
        "p_partkey", V.float_text(F.col("n")).alias("digits"), V.float_text(F.col("p_partkey") / F.lit(2.0**40)).cast("double").alias("small"),
        V.joined_text((F.col("p_name"), T.StringType()), (F.when(F.col("p_size") > 9, F.col("p_size")), T.IntegerType())).alias("joined"),
        V.cell_value(F.col("p_brand"), F.col("f"), F.col("p_name")).alias("value"),
        V.projected_value(F.col("p_size"), T.IntegerType(), F.when(F.col("p_partkey") % 3 == 0, F.col("p_size").cast("string")).otherwise("shown"))["display"].alias("display"),
        X.time_of_day(F.col("p_partkey") / 977).alias("clock"),
        X.container_format(F.concat(F.lit("application/vnd.oasis.opendocument."), F.element_at(F.array(*map(F.lit, ("text", "spreadsheet-template", "graphics"))), (F.col("p_partkey") % 3 + 1).cast("int")))).alias("format"),
    )


def turn_containment(s, d):
    """How much of each turn's trigrams the same conversation's next turn of that place has."""
    own = load(s, d, "conversations")
    after = own.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("later"))
    return own.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(D.text_containment(F.col("text"), F.col("later")), 9).alias("share"))


RECT = "r AS (SELECT p_partkey // 200 AS sheet, p_partkey AS id, p_partkey AS t, (p_size % 5 + 1)::BIGINT AS l, p_partkey + p_size % 4 AS b, (p_size % 5 + 2)::BIGINT AS rt FROM part)"
TALL = RECT.replace("p_partkey // 200", "p_partkey % 3")
GRAMS = "list_distinct(list_transform(range(1, len({w}) - 1), lambda i: array_to_string({w}[i:i + 2], ' ')))"

QUERIES = {
    "format_ranges": (
        format_ranges,
        f"WITH {RECT}, p AS (SELECT sheet, id, unnest(range(t, b + 1)) AS y, l, rt FROM r), q AS (SELECT sheet, id, y, unnest(range(l, rt + 1)) AS x FROM p), f AS (SELECT sheet, y, x, max(id)::VARCHAR AS fill FROM q GROUP BY 1, 2, 3), c AS (SELECT p_partkey // 200 AS sheet, p_partkey AS y, 2 AS x, p_name, p_brand FROM part) "
        "SELECT coalesce(c.sheet, f.sheet) AS sheet, coalesce(c.y, f.y) AS \"row\", coalesce(c.x, f.x) AS col, p_name AS str, coalesce(f.fill, 'none') AS fill, p_brand AS font FROM c FULL JOIN f ON c.sheet = f.sheet AND c.y = f.y AND c.x = f.x",
    ),
    "axis_sizes": (
        axis_sizes,
        f"WITH {RECT}, c AS (SELECT sheet, unnest(range(t, b + 1)) AS i, id, CASE WHEN id % 2 = 0 THEN rt::DOUBLE END AS size, CASE WHEN id % 5 = 0 THEN true END AS hidden FROM r UNION ALL SELECT p_partkey // 200, p_partkey, -1, p_size::DOUBLE, false FROM part) "
        "SELECT sheet, 'row' AS axis, i AS \"index\", arg_max(size, id) FILTER (WHERE size IS NOT NULL) AS size, coalesce(arg_max(hidden, id) FILTER (WHERE hidden IS NOT NULL), false) AS hidden FROM c GROUP BY 1, 3",
    ),
    "merge_changes": (
        merge_changes,
        f"WITH {RECT}, k AS (SELECT id // 3 AS sheet, t, l, b, rt FROM r WHERE id % 3 = 0 AND id % 2 = 1), n AS (SELECT id // 3 AS sheet, t, l, b, rt FROM r WHERE id % 3 = 1) "
        "SELECT sheet, t AS top, l AS \"left\", b AS bottom, rt AS \"right\", NULL::VARCHAR AS error_code FROM k UNION ALL SELECT sheet, t, l, b, rt, CASE WHEN EXISTS (SELECT 1 FROM k WHERE k.sheet = n.sheet AND k.t <= n.b AND n.t <= k.b AND k.l <= n.rt AND n.l <= k.rt) THEN 'overlap' END FROM n",
    ),
    "clipped_ranges": (
        clipped_ranges,
        f"WITH {RECT}, u AS (SELECT sheet, min(t) AS ut, min(l) AS ul, max(t) AS ub, max(l) AS ur FROM r WHERE id % 2 = 0 GROUP BY 1) SELECT r.sheet, id, greatest(t, ut) AS top, greatest(l, ul) AS \"left\", least(b, ub) AS bottom, least(rt, ur) AS \"right\" FROM r JOIN u ON r.sheet = u.sheet WHERE greatest(t, ut) <= least(b, ub) AND greatest(l, ul) <= least(rt, ur)",
    ),
    "object_collisions": (
        object_collisions,
        f"WITH {TALL}, c AS (SELECT DISTINCT sheet, b AS y, rt AS x FROM r WHERE id % 2 = 1) SELECT c.sheet, y AS \"row\", x AS col, min(o.id) AS object FROM c JOIN r o ON o.sheet = c.sheet AND o.id % 2 = 0 AND y BETWEEN o.t AND o.b AND x BETWEEN o.l AND o.rt GROUP BY 1, 2, 3",
    ),
    "workbook_sheets": (
        workbook_sheets,
        "WITH g AS (SELECT s_nationkey AS workbook, min(s_suppkey) AS low, max(s_suppkey) AS high FROM supplier GROUP BY 1), a AS (SELECT s_nationkey AS workbook, s_suppkey AS sheet, s_name AS name, s_suppkey::DOUBLE AS k FROM supplier UNION ALL SELECT workbook, high + 1, 'new', low + 0.5 FROM g), "
        "m AS (SELECT a.*, CASE WHEN sheet = high THEN -1 ELSE k END AS o FROM a JOIN g USING (workbook) WHERE sheet <> low), p AS (SELECT *, row_number() OVER (PARTITION BY workbook ORDER BY o) - 1 AS position, count(*) OVER (PARTITION BY workbook) AS n FROM m) SELECT workbook, sheet, name, position, workbook % 2 = 1 AND n > 1 AND position = 0 AS hidden FROM p",
    ),
    "rule_ids": (
        rule_ids,
        f"WITH {TALL}, n AS (SELECT sheet, count(*) AS n FROM r WHERE id % 4 = 0 GROUP BY 1) SELECT sheet, id AS step, 'own-' || id AS id FROM r WHERE id % 4 = 0 UNION ALL SELECT r.sheet, id, CASE WHEN id % 4 = 1 THEN 'given-' || id ELSE 'cf-' || (row_number() OVER (PARTITION BY r.sheet ORDER BY id) + coalesce(n, 0)) END FROM r LEFT JOIN n ON n.sheet = r.sheet WHERE id % 4 <> 0",
    ),
    "validation_rules": (
        validation_rules,
        "WITH p AS (SELECT p_partkey // 40 AS sheet, p_partkey AS id FROM part), n AS (SELECT sheet, count(*) AS n FROM p WHERE id % 4 = 0 GROUP BY 1), b AS (SELECT *, (id % 4 = 1 AND id % 3 = 0) OR (id % 4 = 2 AND (id % 30) * 13 - 1 > 255) AS bad FROM p WHERE id % 4 <> 0) SELECT sheet, id AS step, 'own-' || id AS id, NULL::VARCHAR AS error_code FROM p WHERE id % 4 = 0 "
        "UNION ALL SELECT b.sheet, id, CASE WHEN NOT bad THEN 'validation-' || (coalesce(n, 0) + row_number() OVER (PARTITION BY b.sheet, bad ORDER BY id)) END, CASE WHEN bad THEN 'invalid-values' END FROM b LEFT JOIN n ON n.sheet = b.sheet",
    ),
    "tables_created": (
        tables_created,
        "WITH s AS (SELECT s_nationkey AS w, s_suppkey % 3 AS sh, s_suppkey AS k, ['T', 't', '1', '_x.', 'a b'][s_suppkey % 5 + 1] || (s_suppkey % 4) AS name, s_suppkey % 9 + 1 AS t, 2::BIGINT AS l, s_suppkey % 9 + 1 + CASE WHEN s_suppkey % 7 = 0 THEN 0 ELSE 3 END AS b, s_suppkey % 3 + 3 AS r FROM supplier), "
        "c AS (SELECT c_nationkey AS w, c_custkey % 3 AS sh, c_custkey // 3 % 9 + 1 AS y, c_custkey // 27 % 6 + 1 AS x, arg_min(CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name END, c_custkey) AS v FROM customer GROUP BY 1, 2, 3, 4), "
        "e AS (SELECT *, CASE WHEN k % 7 = 0 THEN 'no-rows' WHEN k % 5 IN (2, 4) THEN 'invalid-name' WHEN EXISTS (SELECT 1 FROM s o WHERE o.w = s.w AND o.k % 11 = 0 AND lower(o.name) = lower(s.name)) OR EXISTS (SELECT 1 FROM s o WHERE o.w = s.w AND o.k % 11 <> 0 AND o.k % 7 <> 0 AND o.k % 5 NOT IN (2, 4) AND o.k < s.k AND lower(o.name) = lower(s.name)) THEN 'name-taken' END AS bad FROM s WHERE k % 11 <> 0), "
        "h AS (SELECT e.w, e.k, list(coalesce(nullif(v, ''), 'Column' || (x.x - 1)) ORDER BY x.x) AS cols FROM e JOIN (SELECT unnest([2, 3, 4, 5]) AS x) x ON x.x <= e.r LEFT JOIN c ON c.w = e.w AND c.sh = e.sh AND c.y = e.t AND c.x = x.x WHERE bad IS NULL GROUP BY 1, 2) "
        "SELECT e.w AS workbook, sh AS sheet, e.k AS step, name, t AS top, l AS \"left\", b AS bottom, r AS \"right\", array_to_string(cols, '|') AS columns, bad AS error_code FROM e LEFT JOIN h ON h.w = e.w AND h.k = e.k",
    ),
    "pivot_cells": (
        pivot_cells,
        "WITH g AS (SELECT o_orderstatus AS s, o_orderpriority AS p, count(*)::DOUBLE AS n, max(o_custkey)::DOUBLE AS m, min(o_orderkey) AS f FROM orders GROUP BY 1, 2), r AS (SELECT *, 3 + row_number() OVER (ORDER BY f) AS y FROM g), "
        "v AS (SELECT y, 2 AS x, NULL::DOUBLE AS num, s AS str FROM r UNION ALL SELECT y, 3, NULL, p FROM r UNION ALL SELECT y, 4, n, NULL FROM r UNION ALL SELECT y, 5, m, NULL FROM r UNION ALL SELECT 3, unnest([2, 3, 4, 5]), NULL, unnest(['o_orderstatus', 'o_orderpriority', 'n', 'last'])), "
        "c AS (SELECT n_nationkey + 1 AS y, 1 AS x, n_nationkey::DOUBLE AS num, NULL::VARCHAR AS str FROM nation UNION ALL SELECT n_nationkey + 1, 2, NULL, n_name FROM nation UNION ALL SELECT n_nationkey + 1, 3, n_regionkey, NULL FROM nation) "
        "SELECT 'sheet1' AS sheet, y AS \"row\", x AS col, num, str FROM v UNION ALL SELECT 'sheet1', y, x, num, str FROM c WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.y = c.y AND v.x = c.x)",
    ),
    "filled_formulas": (
        filled_formulas,
        "WITH m AS (SELECT max(p_partkey) + 1 AS last FROM part) SELECT p_partkey + 1 AS \"row\", 1 AS col, p_partkey::DOUBLE AS num, NULL::VARCHAR AS formula FROM part UNION ALL SELECT p_partkey + 1, 2, p_size, NULL FROM part WHERE p_partkey = 0 "
        "UNION ALL SELECT y, x, NULL, CASE WHEN y - 1 > 1048576 THEN '#REF!' ELSE ['A', 'B'][x - 1] || (y - 1) END || '*$A$1+' || ['B', 'C'][x - 1] || '$1' FROM (SELECT unnest(range(2, last + 1)) AS y FROM m), (SELECT unnest([2, 3]) AS x)",
    ),
    "merged_runs": (
        merged_runs,
        "WITH RECURSIVE r AS (SELECT p_partkey // 10 AS g, p_partkey AS p, CASE WHEN p_size = 50 THEN 'link' ELSE 'text' END AS kind, ['bold', '', 'bold', 'code', 'bold'][p_size % 5 + 1] AS st, CASE WHEN p_size % 3 = 0 THEN ' ' WHEN p_size % 13 = 0 THEN '' ELSE 'p' || p_partkey END AS t FROM part), "
        "x AS (SELECT g, p, kind, CASE WHEN kind = 'text' AND trim(t) = '' THEN '' ELSE st END AS st, t, row_number() OVER (PARTITION BY g ORDER BY p) AS i FROM r WHERE kind = 'link' OR t <> ''), "
        "w AS (SELECT DISTINCT g, 0::BIGINT AS i, []::STRUCT(p BIGINT, kind VARCHAR, st VARCHAR, t VARCHAR)[] AS o FROM x UNION ALL SELECT w.g, x.i, CASE WHEN x.kind = 'text' AND len(o) >= 1 AND o[-1].kind = 'text' AND o[-1].st = x.st THEN list_append(o[:-2], {'p': o[-1].p, 'kind': 'text', 'st': x.st, 't': o[-1].t || x.t}) "
        "WHEN x.kind = 'text' AND x.st <> '' AND x.st <> 'code' AND len(o) >= 2 AND o[-1].kind = 'text' AND o[-1].st = '' AND trim(o[-1].t) = '' AND o[-2].kind = 'text' AND o[-2].st = x.st THEN list_append(o[:-3], {'p': o[-2].p, 'kind': 'text', 'st': x.st, 't': o[-2].t || o[-1].t || x.t}) ELSE list_append(o, {'p': x.p, 'kind': x.kind, 'st': x.st, 't': x.t}) END FROM w JOIN x ON x.g = w.g AND x.i = w.i + 1) "
        "SELECT g AS paragraph, q.p AS position, q.kind AS kind, q.st AS style, q.t AS text FROM (SELECT g, unnest(o) AS q FROM w QUALIFY i = max(i) OVER (PARTITION BY g))",
    ),
    "delimiter_scores": (
        delimiter_scores,
        "WITH l AS (SELECT doc_id, string_split(regexp_replace(text, '\"([^\"]|\"\")*(\"|$)', '', 'g'), chr(10)) AS ls FROM documents), k AS (SELECT doc_id, d, list_filter(list_transform(ls, lambda x: length(x) - length(replace(x, d, ''))), lambda n: n > 0)[:20] AS ns FROM l, (SELECT unnest([',', ';', chr(9)]) AS d)), "
        "u AS (SELECT doc_id, d, n, count(*) AS f FROM (SELECT doc_id, d, unnest(ns) AS n FROM k) GROUP BY 1, 2, 3), b AS (SELECT doc_id, d, arg_max(n * f, [f, n]) AS score FROM u GROUP BY 1, 2) "
        "SELECT doc_id, coalesce(max(CASE WHEN d = ',' THEN score END), 0)::INT AS comma, coalesce(max(CASE WHEN d = ';' THEN score END), 0)::INT AS semicolon, coalesce(max(CASE WHEN d = chr(9) THEN score END), 0)::INT AS tab FROM documents LEFT JOIN b USING (doc_id) GROUP BY 1",
    ),
    "list_islands": (
        list_items,
        "WITH e AS (SELECT conv_id AS doc_id, turn AS position, length(text) % 3 AS level, length(text) % 2 AS k, turn // 2 AS number FROM conversations), p AS (SELECT *, CASE level WHEN 0 THEN NULL WHEN 1 THEN max(CASE WHEN level < 1 THEN position END) OVER w ELSE max(CASE WHEN level < 2 THEN position END) OVER w END AS lower_at FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), "
        "q AS (SELECT *, lag(position) OVER v AS sp, lag(k) OVER v AS sk, lag(number) OVER v AS sn FROM p WINDOW v AS (PARTITION BY doc_id, level ORDER BY position)), f AS (SELECT *, NOT (sp IS NOT NULL AND (lower_at IS NULL OR lower_at < sp) AND sk = k AND (k = 1 OR number = sn + 1)) AS first FROM q), "
        "g AS (SELECT *, max(CASE WHEN first THEN position END) OVER (PARTITION BY doc_id, level ORDER BY position) AS list_start FROM f) SELECT doc_id, position, level::INTEGER AS level, list_start, (row_number() OVER o)::INTEGER AS item, CASE WHEN k = 0 THEN first_value(number) OVER o ELSE 1 END AS start FROM g WINDOW o AS (PARTITION BY doc_id, level, list_start ORDER BY position)",
    ),
    "job_results": (
        job_results,
        "WITH j AS (SELECT event_id AS id, ['running', 'running', 'running', 'succeeded', 'queued'][event_id % 5 + 1] AS was, user_id % 4 + 1 AS attempt FROM events), r AS (SELECT *, was = 'running' AND id % 7 <> 0 AS live, id % 2 = 0 AND attempt < 4 AS again, floor(least(60.0, pow(2, attempt - 1)) * 1000 * (0.8 + ('0x' || substr(md5(id || ':' || attempt), 1, 8))::BIGINT / 4294967296.0::DOUBLE * 0.4) + 0.5)::BIGINT AS delay FROM j), "
        "s AS (SELECT *, CASE WHEN NOT live THEN was WHEN id % 3 = 2 THEN 'succeeded' WHEN again THEN 'retry' ELSE 'failed' END AS mid FROM r), f AS (SELECT *, CASE WHEN id % 11 = 0 AND mid NOT IN ('succeeded', 'failed') THEN 'cancelled' ELSE mid END AS state FROM s) "
        "SELECT id AS job_id, state, attempt, CASE WHEN mid = 'retry' THEN 1000 + delay END AS due_at, CASE WHEN live THEN CASE id % 3 WHEN 0 THEN 'fetch-failed' WHEN 1 THEN 'processing-failed' END END AS error_code, CASE WHEN was <> state THEN was END AS was, CASE WHEN was <> state THEN true END AS seen FROM f",
    ),
    "failure_texts": (failure_texts, "SELECT doc_id, sha256(substr(text, 1, 2048)) AS message, 'malformed' AS code, doc_id % 2 = 0 AS retryable, 415.0::DOUBLE AS status, true AS lost FROM documents"),
    "cell_texts": (
        cell_texts,
        "SELECT p_partkey, regexp_replace(format('{:.14e}', p_retailprice / 7)::DOUBLE::VARCHAR, '[.]0$', '') AS digits, format('{:.14e}', p_partkey / 1099511627776.0::DOUBLE)::DOUBLE AS small, p_name || CASE WHEN p_size > 9 THEN p_size::VARCHAR ELSE '' END AS joined, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_brand END AS value, "
        "CASE WHEN p_partkey % 3 <> 0 THEN 'shown' END AS display, strftime(TIMESTAMP '2000-01-01' + to_seconds(floor(p_partkey / 977 * 86400 + 0.5)::BIGINT % 86400), '%H:%M:%S') AS clock, ['odt', 'ods', NULL][p_partkey % 3 + 1] AS format FROM part",
    ),
    "turn_containment": (
        turn_containment,
        "WITH w AS (SELECT conv_id, turn, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS w FROM conversations), g AS (SELECT conv_id, turn, " + GRAMS.format(w="w") + " AS g FROM w) "
        "SELECT a.conv_id, a.turn, CASE WHEN len(a.g) = 0 THEN 1.0::DOUBLE ELSE round(len(list_intersect(a.g, b.g)) / len(a.g)::DOUBLE, 9) END AS share FROM g a JOIN g b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1",
    ),
}
