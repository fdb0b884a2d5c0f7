"""Queries whose results depend on an order: grids, counters, commands, chains, dependencies."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from sheafline.operators import chains as H
from sheafline.operators import commands as C
from sheafline.operators import dependencies as Y
from sheafline.operators import documents as D
from sheafline.operators import grid as G
from sheafline.operators import headers as B
from sheafline.operators import numbering as N
from sheafline.operators import portable as V
from sheafline.operators import structure as R
from sheafline.operators import styles as A
from sheafline.operators.rounds import dealt, shared_dir
from sheafline.operators.workbook import RECTANGLE
from sheafline.plans.table_queries import load
from sheafline.sources.tiles import read_rectangles, write_tiles
from sheafline.streaming import job_states as J
from sheafline.streaming.ingest import keyed
from sheafline.streaming.keyed_store import KeyedStore


def order_lines(s, d):
    """One line for each order and line number: the least of those that share them."""
    return load(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"), F.min("l_quantity").cast("long").alias("quantity"))


def table_pages(s, d):
    """Eight orders a page as an HTML table: the first one is the head, the last three the foot; lines are cells with spans."""
    k = F.col("l_orderkey")
    own = order_lines(s, d)
    text = F.when((k % 8 >= 5) & (F.floor(k / 8) % 2 == 0), "").otherwise(F.concat(F.lit("p"), F.col("part").cast("string")))
    cell = F.concat(F.lit("<td rowspan="), (F.col("quantity") % 4).cast("string"), F.lit(' colspan="'), (F.col("part") % 3 + 1).cast("string"), F.lit('">'), text, F.lit("</td>"))
    rows = own.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", cell.alias("t")))), lambda x: x["t"]), "").alias("t"))  # seven lines at most
    group = F.when(k % 8 == 0, "thead").when(k % 8 < 5, "tbody").otherwise("tfoot")
    marked = rows.withColumn("g", group).groupBy(F.floor(k / 8).alias("page_id"), "g").agg(F.min(k).alias("k"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "t"))), lambda x: F.concat(F.lit("<tr>"), x["t"], F.lit("</tr>"))), "").alias("t"))  # eight rows at most
    whole = F.transform(F.array_sort(F.collect_list(F.struct("k", "g", "t"))), lambda x: F.concat(F.lit("<"), x["g"], F.lit(">"), x["t"], F.lit("</"), x["g"], F.lit(">")))
    return marked.groupBy("page_id").agg(F.concat(F.lit("<p>x</p><table>"), F.array_join(whole, ""), F.lit("</table>")).alias("html"))


def html_table_grid(s, d):
    return D.html_table_grid(table_pages(s, d)).select("page_id", "r", "c", "row_span", "col_span", "header_row", "text")


def level_numbers(s, d):
    """A customer's orders as entries of four levels, some with a start of their own."""
    k = F.col("o_orderkey")
    entries = load(s, d, "orders").select(F.col("o_custkey").alias("doc_id"), k.alias("position"), (F.length("o_orderpriority") % 4).alias("level"), F.when(k % 11 == 0, 5).alias("start"))
    doc = F.col("doc_id")
    restarts = F.array(F.lit(None).cast("int"), F.lit(None).cast("int"), F.when(doc % 3 == 0, 0), F.when(doc % 3 == 1, 2))
    levels = entries.select("doc_id").distinct().select("doc_id", F.array(F.lit(1), F.lit(1), (doc % 4).cast("int"), F.lit(3)).alias("starts"), restarts.alias("restarts"))
    out = N.level_numbers(entries, levels, ["doc_id"])
    patterns = F.array(F.lit("%1."), F.lit("%1.%2)"), F.lit("(%3%)"), F.lit("%1-%2-%3-%4"))
    markers = F.array(F.lit("decimal"), F.lit("upper-roman"), F.lit("lower-alpha"), F.lit("decimal"))
    return out.select("doc_id", "position", "level", "number", N.composite_label(F.get(patterns, F.col("level")), F.col("values"), markers).alias("label"))


def sheet_commands(s, d):
    """Sixty parts a sheet: five merges that stand, then merges and unmerges in the order of their keys."""
    k, size = F.col("p_partkey"), F.col("p_size")
    n = k % 60
    own = load(s, d, "part").select(F.floor(k / 60).alias("sheet"), k.alias("step"), n.alias("n"), (size % 40 + 1).alias("top"), (k % 3 + 1).alias("left"), (size % 40 + 1 + k % 4).alias("bottom"), (k % 3 + 1 + size % 2).alias("right"))
    old = own.where("n < 5").select("sheet", (F.col("n") * 8 + 1).alias("top"), F.lit(1).alias("left"), (F.col("n") * 8 + 2).alias("bottom"), F.lit(2).alias("right"))
    new = own.where("n >= 5").select("sheet", "step", F.lit("merge").alias("kind"), *RECTANGLE)
    # an unmerge takes the rectangle of the step three before
    gone = own.where("n >= 8 and n % 4 = 0").select("sheet", "step").join(own.select("sheet", (F.col("step") + 3).alias("step"), *RECTANGLE), ["sheet", "step"])
    return old, new.join(gone.select("sheet", "step"), ["sheet", "step"], "left_anti").select(*new.columns).unionByName(gone.select("sheet", "step", F.lit("unmerge").alias("kind"), *RECTANGLE))


def merge_commands(s, d):
    old, commands = sheet_commands(s, d)
    return C.merge_decisions(old, commands)


def merges_left(s, d):
    old, commands = sheet_commands(s, d)
    return C.merges_after(old, C.merge_decisions(old, commands))


def style_chains(s, d):
    """Customers as styles, each based on the one before, with ends, missing parents and cycles."""
    k = F.col("c_custkey")
    parent = F.when(k % 40 == 1, None).when(k % 97 == 5, k + 10**9).when(k % 500 == 3, k + 2).otherwise(k - 1)
    entries = [(F.lit(name), F.when(k % every == 0, k.cast("string"))) for name, every in (("font", 7), ("size", 3), ("color", 11))]
    nodes = load(s, d, "customer").select(k.alias("id"), parent.alias("parent"), F.create_map(*(c for e in entries for c in e)).alias("props"))
    got = H.parent_chains(nodes)
    return got.select("id", "root", "depth", *(F.try_element_at("props", F.lit(n)).alias(n) for n in ("font", "size", "color")), "error_code")


def formula_levels(s, d):
    """Two hundred parts a sheet as formulas over ranges some rows above; two of them in a circle."""
    k, size = F.col("p_partkey"), F.col("p_size")
    row = k % 200 + 1
    cell = lambda r, c="A": F.concat(F.lit(c), r.cast("string"))
    above = F.concat(F.lit("SUM("), cell(row - 19), F.lit(":$C$"), (row - 15).cast("string"), F.lit(')*2&"A1:C200"+LOG10('), cell(F.greatest(row - 30, F.lit(1)), "B"), F.lit(")"))
    circle = F.when(row == 150, "1+A151+C151").when(row == 151, "SUM(A150:C150)")
    other = F.when(size == 7, F.concat(F.lit("'no such'!A1+"), above)).when(size == 8, F.concat(F.lit("'S"), F.floor(k / 200).cast("string"), F.lit("'!A1+"), above)).otherwise(above)
    formula = F.when(row >= 20, F.coalesce(circle, other))
    cells = load(s, d, "part").select(F.concat(F.lit("S"), F.floor(k / 200).cast("string")).alias("sheet"), row.alias("row"), (k % 3 + 1).alias("col"), formula.alias("formula"))
    return Y.formula_levels(cells)


def edge_columns(s, d):
    """Lines as cells of four-row tables that state their right edges only."""
    cells = order_lines(s, d).select(F.floor(F.col("l_orderkey") / 4).alias("table_id"), F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("cell"), (F.col("l_linenumber") * 40 + F.col("part") % 37).alias("right"))
    return G.edge_columns(cells, ["table_id"], 10).select("table_id", "row", "cell", "c", "col_span")


def keyed_store(s, d):
    """Documents stored by their digest in three batches; the first batch that brings a key keeps it, the last one runs twice."""
    docs = keyed(load(s, d, "documents").select("doc_id", "text", "source"))
    store = KeyedStore(s, f"{shared_dir(s)}/sheafline/keyed-{uuid.uuid4().hex}")
    for number in (0, 1, 2, 2):
        store.write(docs.where(F.col("doc_id") % 3 == number).select("sha256", "doc_id", "source"), number, "doc_id")
    return store.rows().select("sha256", "doc_id", "source")


def sheet_rectangles(s, d):
    """Lines stored as cells in tiles, seven sheets; of each sheet the rectangle below row nine and right of column one is read."""
    k = F.col("l_orderkey")
    cells = order_lines(s, d).select(F.concat(F.lit("s"), (k % 7).cast("string")).alias("sheet"), (F.floor(k / 7) + 1).alias("row"), F.col("l_linenumber").cast("long").alias("col"), F.col("quantity").alias("num"))
    path = f"{shared_dir(s)}/sheafline/tiles-{uuid.uuid4().hex}"
    write_tiles(cells, path)
    bottoms = cells.groupBy("sheet").agg(F.max("row").alias("bottom"))
    return read_rectangles(s, path, bottoms.select(F.concat(F.lit("r"), "sheet").alias("rect"), "sheet", F.lit(10).cast("long").alias("top"), F.lit(2).alias("left"), F.greatest("bottom", F.lit(10)).alias("bottom"), F.lit(99).alias("right")))


def job_states(s, d):
    """A user's events as commands on one job: creations, claims, renewals, updates under guessed tokens, cancellations."""
    e, user = F.col("event_id"), F.col("user_id").cast("string")
    k, at = e % 6, F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    kind = F.when(k == 0, "create").when(k == 3, "renew").when(k == 4, "update").when((k == 5) & (e % 5 == 0), "cancel").otherwise("claim")
    retry = F.concat(F.lit('{"state":"retry-scheduled","nextAttemptAt":'), (at + 2 * 86_400_000).cast("string"), F.lit(',"errorCode":"fetch-failed"}'))
    patch = F.when(e % 4 == 0, '{"state":"succeeded","phase":"complete"}').when(e % 4 == 1, retry).when(e % 4 == 2, '{"phase":"process"}').otherwise('{"attempt":9}')
    commands = load(s, d, "events").select(
        user.alias("job_id"), e.alias("seq"), F.timestamp_millis(at).alias("at"), kind.alias("kind"), F.concat(F.lit("k"), user, F.when(e % 14 == 0, "x").otherwise("")).alias("key"), (F.col("user_id") % 2 + 3).cast("int").alias("max_attempts"),
        F.lit("w").alias("worker"), F.concat(F.lit("w:"), (F.floor(e / 6) % 3 + 1).cast("string")).alias("token"), ((e % 10 + 1) * 86_400_000).alias("duration_ms"), patch.alias("patch"),
    )
    return J.job_transitions(commands).drop("kind")


def style_cascade(s, d):
    """Twenty parts a page as elements under the page's style sheet, some with a style of their own."""
    k, size = F.col("p_partkey"), F.col("p_size")
    own = load(s, d, "part").withColumn("page_id", F.floor(k / 20))
    css = F.concat(
        F.lit("/* a } */ p, b.c1 { font-weight: 700; display:none }\n.c2{font-style:italic!important;text-decoration:underline} P.c"), (F.col("page_id") % 4).cast("string"),
        F.lit("{font-weight:normal ! important; text-decoration: line-through} div p {display:block} .c3:hover{display:none} h1{display:none} h1 { Display : BLOCK } .c1{font-weight:600} /* .c0{display:none}"),
    )
    style = F.when(size % 5 == 0, "font-style: normal; display:none !important").when(size % 7 == 0, "font-weight:bold")
    tag = F.get(F.array(*map(F.lit, ("p", "b", "h1", "i"))), (k % 4).cast("int"))
    classes = F.array(F.concat(F.lit("c"), (size % 4).cast("string")), F.concat(F.lit("c"), (size % 3).cast("string")))
    elements = own.select("page_id", k.alias("element"), tag.alias("tag"), classes.alias("classes"), style.alias("style"))
    sheets = dealt(own.select("page_id"), own.count(), 100_000, "page_id").distinct()
    return A.cascaded(elements, A.style_rules(sheets.select("page_id", css.alias("css"))))


def note_order(s, d):
    """Turns of a conversation as notes that refer to one another, every third from the body; every fifth is blank."""
    turn = F.col("turn")
    own = load(s, d, "conversations").withColumnRenamed("conv_id", "doc_id")
    notes = own.select("doc_id", F.concat(F.lit("n"), turn.cast("string")).alias("note_id"), turn.alias("position"), F.when(turn % 5 == 4, " \n").otherwise(F.col("text")).alias("text"))
    inside = F.when(turn % 3 != 0, F.concat(F.lit("n"), F.floor(turn / 2).cast("string")))
    to = F.concat(F.lit("n"), ((turn * 7 + F.col("doc_id")) % 6).cast("string"))
    got = R.nested_notes(notes, own.select("doc_id", inside.alias("inside"), (100 - turn).alias("position"), to.alias("note_id")))
    return got.select("doc_id", "note_id", "number", R.footnote_lines(F.col("number"), F.col("definition")).alias("line"))


def portable_values(s, d):
    """Events' properties inside eight forms of JSON, two of them invalid and one too deep."""
    e, name = F.col("event_id"), F.col("event_type")
    form = F.array(
        F.lit('{"k": 1'), F.col("props"), F.concat(F.lit('{"a": ['), "props", F.lit(', "é", null, true, false, -1.5]}')),
        F.concat(F.lit('{"data": "'), F.base64(name.cast("binary")), F.lit('", "$binary": "binary/base64"}')), F.lit('{"x": {"$binary": "binary/base64", "data": "QUJ="}}'),
        F.concat(F.lit("[[[[["), "props", F.lit("]]]]]")), F.concat(F.lit('"'), name, F.lit('"')), F.lit("[]"),
    )
    return V.measured_values(load(s, d, "events").select(e.alias("id"), F.get(form, (e % 8).cast("int")).alias("json")), V.Limits(max_depth=4))


def header_rows(s, d):
    """A nation's customers as a table under six kinds of first rows."""
    n, k = F.col("c_nationkey"), F.col("c_custkey")
    own = load(s, d, "customer").withColumn("row", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")))
    body = F.array(F.when(n % 6 == 5, F.col("c_mktsegment")).otherwise(k.cast("string")), F.col("c_name"), F.when(n % 6 == 5, "x").otherwise(F.format_number("c_acctbal", 2)))
    rows = own.select(n.alias("table_id"), "row", F.posexplode(body).alias("col", "text"))
    heads = F.array(*(F.array(*map(F.lit, h)) for h in (("Id", "Name", "Balance"), ("a", " A", "b"), ("1", "2", "3"), ("Id", "", "Balance"), ("Id", "Name", "a\nb"), ("BUILDING", "Name", "Mark"))))
    first = load(s, d, "customer").select(n.alias("table_id")).distinct().select("table_id", F.lit(0).alias("row"), F.posexplode(F.get(heads, F.col("table_id") % 6)).alias("col", "text"))
    cells = rows.unionByName(first).select("*", F.lit(1).alias("row_span"), F.lit(1).alias("col_span"))
    return B.header_rows(cells, ["table_id"])


LINES = "o AS (SELECT l_orderkey AS k, l_linenumber AS n, min(l_partkey) AS part, min(l_quantity)::BIGINT AS q FROM lineitem GROUP BY 1, 2)"
COVERS = "len(list_filter(active, lambda a: a.t <= {row} AND {row} < a.b AND a.l <= {col} AND {col} < a.r)) > 0"

#: Cells are placed one by one: the first free column, then spans up to what is covered.
GRID = f"""WITH RECURSIVE {LINES}, x AS (SELECT k // 8 AS page_id, dense_rank() OVER (PARTITION BY k // 8 ORDER BY k) - 1 AS r, CASE WHEN k % 8 = 0 THEN 0 WHEN k % 8 < 5 THEN 1 ELSE 2 END AS g, n, q % 4 AS tall, part % 3 + 1 AS wide,
  CASE WHEN k % 8 >= 5 AND (k // 8) % 2 = 0 THEN '' ELSE 'p' || part END AS text FROM o),
y AS (SELECT *, max(r) OVER (PARTITION BY page_id, g) AS last, row_number() OVER (PARTITION BY page_id ORDER BY r, n) AS i FROM x),
z AS (SELECT page_id, i, r, g, text, wide, CASE WHEN tall = 0 THEN last - r + 1 ELSE tall END AS tall FROM y),
p AS (SELECT page_id, 0::BIGINT AS i, -1::BIGINT AS r, 0::BIGINT AS c, 0::BIGINT AS w, 0::BIGINT AS h, 0::BIGINT AS next, []::STRUCT(t BIGINT, l BIGINT, b BIGINT, r BIGINT)[] AS active FROM (SELECT DISTINCT page_id FROM z)
  UNION ALL SELECT page_id, i, row, c, w, h, c + w, list_append(active, {{'t': row, 'l': c, 'b': row + h, 'r': c + w}}) FROM (
    SELECT *, coalesce(list_min(list_filter(range(1, tall), lambda dh: len(list_filter(active, lambda a: a.t <= row + dh AND row + dh < a.b AND a.l < c + w AND c < a.r)) > 0)), tall) AS h FROM (
    SELECT *, coalesce(list_min(list_filter(range(1, wide), lambda dw: len(list_filter(active, lambda a: a.t <= row AND row < a.b AND a.l <= c + dw AND c + dw < a.r)) > 0)), wide) AS w FROM (
    SELECT *, list_min(list_filter(range(here, here + 200), lambda v: len(list_filter(active, lambda a: a.t <= row AND row < a.b AND a.l <= v AND v < a.r)) = 0)) AS c FROM (
    SELECT p.page_id, z.i, z.r AS row, z.tall, z.wide, CASE WHEN z.r = p.r THEN p.next ELSE 0 END AS here, p.active FROM p JOIN z ON z.page_id = p.page_id AND z.i = p.i + 1))))),
e AS (SELECT page_id, max(r) AS last FROM z WHERE text <> '' GROUP BY 1),
hd AS (SELECT page_id, min(CASE WHEN g > 0 THEN r END) AS body FROM z GROUP BY 1)
SELECT p.page_id, p.r, c, least(h, last - p.r + 1) AS row_span, w AS col_span, p.r < coalesce(body, 1000) AS header_row, text FROM p JOIN z ON z.page_id = p.page_id AND z.i = p.i JOIN e ON e.page_id = p.page_id JOIN hd ON hd.page_id = p.page_id WHERE p.r <= last"""

#: For each entry and level: where the level began anew, and how many entries it has had since.
NUMBERS = """WITH e AS (SELECT o_custkey AS d, o_orderkey AS p, length(o_orderpriority) % 4 AS l, CASE WHEN o_orderkey % 11 = 0 THEN 5 END AS s FROM orders),
k AS (SELECT * FROM (VALUES (0), (1), (2), (3)) k(k)),
f AS (SELECT e.d, e.p, e.l, k, CASE k WHEN 2 THEN e.d % 4 WHEN 3 THEN 3 ELSE 1 END AS base, CASE WHEN k = 2 AND e.d % 3 = 0 THEN 0 WHEN k = 3 AND e.d % 3 = 1 THEN 2 ELSE 99 END AS rule FROM e, k),
t AS (SELECT f.d, f.p, f.l, k, base, max(x.p) AS cut, arg_max(CASE WHEN x.l = k THEN x.s END, x.p) AS given FROM f LEFT JOIN e x ON x.d = f.d AND x.p <= f.p AND ((x.l < k AND x.l < rule) OR (x.l = k AND x.s IS NOT NULL)) GROUP BY ALL),
g AS (SELECT t.d, t.p, t.l, k, base, coalesce(max(CASE WHEN x.p = cut AND x.l = k THEN x.s END), base) AS first, count(CASE WHEN x.l = k THEN 1 END) AS n FROM t LEFT JOIN e x ON x.d = t.d AND x.p <= t.p AND x.p >= coalesce(cut, -1) GROUP BY t.d, t.p, t.l, k, base),
v AS (SELECT d, p, l, list(CASE WHEN n > 0 THEN first + n - 1 ELSE base END ORDER BY k) AS v FROM g GROUP BY 1, 2, 3),
rn AS (SELECT d, p, l, v, ['I','II','III','IV','V','VI','VII','VIII','IX','X','XI','XII','XIII','XIV','XV','XVI','XVII','XVIII','XIX','XX','XXI','XXII','XXIII','XXIV','XXV','XXVI','XXVII','XXVIII','XXIX','XXX'][v[2]] AS two, CASE WHEN v[3] = 0 THEN '0' WHEN v[3] > 26 THEN chr((96 + (v[3] - 1) // 26)::INT) || chr((97 + (v[3] - 1) % 26)::INT) ELSE chr((96 + v[3])::INT) END AS three FROM v)
SELECT d AS doc_id, p AS position, l::INT AS level, v[l + 1]::BIGINT AS number, CASE l WHEN 0 THEN v[1] || '.' WHEN 1 THEN v[1] || '.' || two || ')' WHEN 2 THEN '(' || three || '%)' ELSE v[1] || '-' || two || '-' || three || '-' || v[4] END AS label FROM rn"""

#: Commands are taken one by one on the list of rectangles that stand.
MERGES = """WITH RECURSIVE a AS (SELECT p_partkey // 60 AS sheet, p_partkey AS step, p_partkey % 60 AS n, p_size % 40 + 1 AS t, p_partkey % 3 + 1 AS l, p_size % 40 + 1 + p_partkey % 4 AS b, p_partkey % 3 + 1 + p_size % 2 AS r FROM part),
m AS (SELECT x.sheet, x.step, CASE WHEN x.n >= 8 AND x.n % 4 = 0 THEN 'unmerge' ELSE 'merge' END AS kind, CASE WHEN x.n >= 8 AND x.n % 4 = 0 THEN {'t': y.t, 'l': y.l, 'b': y.b, 'r': y.r} ELSE {'t': x.t, 'l': x.l, 'b': x.b, 'r': x.r} END AS q FROM a x LEFT JOIN a y ON y.sheet = x.sheet AND y.step = x.step - 3 WHERE x.n >= 5),
i AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY step) AS i FROM m),
s AS (SELECT sheet, 0::BIGINT AS i, NULL::BOOLEAN AS bad, list({'t': n * 8 + 1, 'l': 1::BIGINT, 'b': n * 8 + 2, 'r': 2::BIGINT}) AS now FROM a WHERE n < 5 GROUP BY sheet
  UNION ALL SELECT sheet, i, bad, CASE WHEN kind = 'unmerge' THEN list_filter(now, lambda z: NOT (z.t = q.t AND z.l = q.l AND z.b = q.b AND z.r = q.r)) WHEN bad THEN now ELSE list_append(now, q) END FROM (
    SELECT s.sheet, i.i, i.kind, i.q, s.now, i.kind = 'merge' AND len(list_filter(s.now, lambda z: z.t <= i.q.b AND i.q.t <= z.b AND z.l <= i.q.r AND i.q.l <= z.r)) > 0 AS bad FROM s JOIN i ON i.sheet = s.sheet AND i.i = s.i + 1))"""

CHAINS = """WITH RECURSIVE n AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 40 = 1 THEN NULL WHEN c_custkey % 97 = 5 THEN c_custkey + 1000000000 WHEN c_custkey % 500 = 3 THEN c_custkey + 2 ELSE c_custkey - 1 END AS up,
  CASE WHEN c_custkey % 7 = 0 THEN c_custkey::VARCHAR END AS font, CASE WHEN c_custkey % 3 = 0 THEN c_custkey::VARCHAR END AS size, CASE WHEN c_custkey % 11 = 0 THEN c_custkey::VARCHAR END AS color FROM customer),
w AS (SELECT id, id AS top, up, 0::BIGINT AS depth, font, size, color, [id] AS seen, false AS cycle FROM n
  UNION ALL SELECT w.id, CASE WHEN list_contains(seen, w.up) THEN w.top ELSE n.id END, CASE WHEN list_contains(seen, w.up) THEN NULL ELSE n.up END, w.depth + 1, coalesce(w.font, n.font), coalesce(w.size, n.size), coalesce(w.color, n.color), list_append(seen, n.id), list_contains(seen, w.up) FROM w JOIN n ON n.id = w.up),
z AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY id ORDER BY depth DESC) = 1)
SELECT id, CASE WHEN NOT cycle THEN top END AS root, CASE WHEN NOT cycle THEN depth END AS depth, font, size, color, CASE WHEN cycle THEN 'malformed' END AS error_code FROM z"""

#: Paths of each length; one longer than any without a circle tells a circle.
LEVELS = """WITH RECURSIVE c AS (SELECT p_partkey // 200 AS s, p_partkey % 200 + 1 AS r, p_partkey % 3 + 1 AS c, p_size FROM part), f AS (SELECT * FROM c WHERE r >= 20),
b AS (SELECT s, r, c, r - 19 AS t, r - 15 AS b, 1 AS l, 3 AS rt FROM f WHERE r NOT IN (150, 151)
  UNION ALL SELECT s, r, c, 1, 1, 1, 1 FROM f WHERE p_size = 8 AND r NOT IN (150, 151) UNION ALL SELECT s, r, c, r - 30, r - 30, 2, 2 FROM f WHERE r > 30 AND r NOT IN (150, 151) UNION ALL SELECT s, r, c, 151, 151, 1, 1 FROM f WHERE r = 150 UNION ALL SELECT s, r, c, 151, 151, 3, 3 FROM f WHERE r = 150 UNION ALL SELECT s, r, c, 150, 150, 1, 3 FROM f WHERE r = 151),
e AS (SELECT DISTINCT b.s, b.r, b.c, f.r AS pr, f.c AS pc FROM b JOIN f ON f.s = b.s AND f.r BETWEEN b.t AND b.b AND f.c BETWEEN b.l AND b.rt),
w AS (SELECT s, r, c, 0 AS n FROM f UNION SELECT e.s, e.r, e.c, w.n + 1 FROM w JOIN e ON e.s = w.s AND e.pr = w.r AND e.pc = w.c WHERE w.n < 20),
z AS (SELECT s, r, c, max(n) AS n FROM w GROUP BY 1, 2, 3)
SELECT 'S' || s AS sheet, r AS "row", c AS col, CASE WHEN n < 20 THEN n END::INT AS level, CASE WHEN n = 20 THEN '#CYCLE!' WHEN p_size = 7 AND r NOT IN (150, 151) THEN '#REF!' END AS error_code FROM z JOIN f USING (s, r, c)"""

#: Edges are lifted cell by cell, clusters cut edge by edge.
EDGES = f"""WITH RECURSIVE {LINES}, x AS (SELECT k // 4 AS t, k AS r, n, n * 40 + part % 37 AS e, row_number() OVER (PARTITION BY k ORDER BY n) AS i FROM o),
u AS (SELECT t, r, n, i, e FROM x WHERE i = 1 UNION ALL SELECT x.t, x.r, x.n, x.i, greatest(x.e, u.e + 1) FROM u JOIN x ON x.r = u.r AND x.i = u.i + 1),
d AS (SELECT t, list(DISTINCT e ORDER BY e) AS es FROM u GROUP BY t),
cl AS (SELECT t, 1::BIGINT AS j, [es[1]] AS firsts, es FROM d UNION ALL SELECT t, j + 1, CASE WHEN es[j + 1] - firsts[-1] > 10 THEN list_append(firsts, es[j + 1]) ELSE firsts END, es FROM cl WHERE j < len(es)),
fin AS (SELECT t, firsts FROM cl WHERE j = len(es)),
q AS (SELECT u.t, u.r, u.n, u.i, len(list_filter(firsts, lambda f: f < u.e - 10)) AS place FROM u JOIN fin ON fin.t = u.t),
v AS (SELECT t, r, n, i, 0::BIGINT AS c, place + 1 AS done FROM q WHERE i = 1 UNION ALL SELECT q.t, q.r, q.n, q.i, v.done, greatest(q.place + 1, v.done + 1) FROM v JOIN q ON q.r = v.r AND q.i = v.i + 1)
SELECT t AS table_id, r AS "row", n AS cell, c, done - c AS col_span FROM v"""

JOBS = """WITH RECURSIVE c AS (SELECT user_id AS u, event_id AS e, (epoch_us(ts) // 1000) AS tm, CASE WHEN e % 6 = 0 THEN 'create' WHEN e % 6 = 3 THEN 'renew' WHEN e % 6 = 4 THEN 'update' WHEN e % 6 = 5 AND e % 5 = 0 THEN 'cancel' ELSE 'claim' END AS kind,
  'k' || user_id || CASE WHEN event_id % 14 = 0 THEN 'x' ELSE '' END AS k, user_id % 2 + 3 AS most, 'w:' || (event_id // 6 % 3 + 1) AS tok, (event_id % 10 + 1) * 86400000 AS dur, row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) AS i FROM events),
s AS (SELECT DISTINCT u, 0::BIGINT AS i, NULL::BIGINT AS e, NULL::BIGINT AS tm, NULL::VARCHAR AS outcome, NULL::VARCHAR AS k, NULL::VARCHAR AS state, NULL::VARCHAR AS phase, NULL::BIGINT AS rev, NULL::BIGINT AS att, NULL::BIGINT AS most, NULL::VARCHAR AS tok, NULL::BIGINT AS lease, NULL::BIGINT AS due, NULL::VARCHAR AS err FROM c
  UNION ALL SELECT u, i, e, tm, o, CASE WHEN o = 'created' THEN nk ELSE k END,
    CASE WHEN o = 'created' THEN 'queued' WHEN o = 'claimed' THEN 'running' WHEN o = 'lease-lost' THEN 'failed' WHEN o = 'cancelled' THEN 'cancelled' WHEN o = 'updated' AND e % 4 = 0 THEN 'succeeded' WHEN o = 'updated' AND e % 4 = 1 THEN 'retry-scheduled' ELSE state END,
    CASE WHEN o = 'created' THEN 'queued' WHEN o = 'claimed' THEN 'acquire-source' WHEN o = 'lease-lost' THEN 'failed' WHEN o = 'cancelled' THEN 'cancelled' WHEN o = 'updated' AND e % 4 = 0 THEN 'complete' WHEN o = 'updated' AND e % 4 = 2 THEN 'process' ELSE phase END,
    CASE WHEN o = 'created' THEN 0 WHEN o IN ('claimed', 'lease-lost', 'cancelled', 'renewed', 'updated') THEN rev + 1 ELSE rev END, CASE WHEN o = 'created' THEN 0 WHEN o = 'claimed' THEN att + 1 ELSE att END, CASE WHEN o = 'created' THEN nmost ELSE most END,
    CASE WHEN o = 'claimed' THEN 'w:' || (rev + 1) WHEN o IN ('lease-lost', 'cancelled') OR (o = 'updated' AND e % 4 < 2) THEN NULL ELSE tok END,
    CASE WHEN o IN ('claimed', 'renewed') THEN tm + dur WHEN o IN ('lease-lost', 'cancelled') OR (o = 'updated' AND e % 4 < 2) THEN NULL ELSE lease END,
    CASE WHEN o IN ('claimed', 'lease-lost', 'cancelled') THEN NULL WHEN o = 'updated' AND e % 4 = 1 THEN tm + 172800000 ELSE due END,
    CASE WHEN o IN ('claimed', 'cancelled') THEN NULL WHEN o = 'lease-lost' THEN 'lease-lost' WHEN o = 'updated' AND e % 4 = 1 THEN 'fetch-failed' ELSE err END
  FROM (SELECT *, CASE WHEN kind = 'create' THEN CASE WHEN state IS NULL THEN 'created' WHEN k = nk THEN 'existing' ELSE 'job-conflict' END WHEN state IS NULL THEN 'unknown'
      WHEN kind = 'claim' THEN CASE WHEN NOT (state = 'queued' OR (state = 'retry-scheduled' AND due <= tm) OR over) THEN 'refused' WHEN att < most THEN 'claimed' WHEN over THEN 'lease-lost' ELSE 'refused' END
      WHEN kind = 'cancel' THEN CASE WHEN state = 'cancelled' THEN 'existing' WHEN state IN ('succeeded', 'failed') THEN 'refused' ELSE 'cancelled' END
      WHEN NOT (state = 'running' AND tok = given AND lease > tm) THEN 'refused' WHEN kind = 'renew' THEN 'renewed' WHEN e % 4 = 3 THEN 'job-conflict' ELSE 'updated' END AS o
    FROM (SELECT s.u, c.i, c.e, c.tm, c.kind, c.k AS nk, c.most AS nmost, c.tok AS given, c.dur, s.k, s.state, s.phase, s.rev, s.att, s.most, s.tok, s.lease, s.due, s.err, coalesce(s.state = 'running' AND s.lease <= c.tm, false) AS over FROM s JOIN c ON c.u = s.u AND c.i = s.i + 1)))
SELECT u::VARCHAR AS job_id, e AS seq, tm AS at_ms, outcome, state, phase, rev AS revision, att::INT AS attempt, tok AS token, lease AS lease_until, due AS next_attempt_at, err AS error_code FROM s WHERE i > 0"""

CASCADE = """WITH e AS (SELECT p_partkey // 20 AS page_id, p_partkey AS element, ['p', 'b', 'h1', 'i'][p_partkey % 4 + 1] AS tag, ['c' || (p_size % 4), 'c' || (p_size % 3)] AS cl, p_size FROM part),
r(tag, c, w, n, prop, val) AS (VALUES ('p', '', 1, 1, 'bold', true), ('p', '', 1, 1, 'hidden', true), ('b', 'c1', 11, 2, 'bold', true), ('b', 'c1', 11, 2, 'hidden', true), ('', 'c2', 10010, 3, 'italic', true), ('p', 'own', 10011, 4, 'bold', false),
  ('p', 'own', 11, 4, 'strike', true), ('h1', '', 1, 5, 'hidden', true), ('h1', '', 1, 6, 'hidden', false), ('', 'c1', 10, 7, 'bold', true)),
m AS (SELECT page_id, element, w, n, prop, val FROM e JOIN r ON (r.tag = '' OR r.tag = e.tag) AND (c = '' OR list_contains(cl, CASE WHEN c = 'own' THEN 'c' || (page_id % 4) ELSE c END))
  UNION ALL SELECT page_id, element, 1000, 0, 'italic', false FROM e WHERE p_size % 5 = 0 UNION ALL SELECT page_id, element, 11000, 0, 'hidden', true FROM e WHERE p_size % 5 = 0 UNION ALL SELECT page_id, element, 1000, 0, 'bold', true FROM e WHERE p_size % 5 <> 0 AND p_size % 7 = 0),
b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY element, prop ORDER BY w DESC, n DESC) = 1)
SELECT page_id, element, bool_or(val) FILTER (prop = 'bold') AS bold, bool_or(val) FILTER (prop = 'italic') AS italic, bool_or(val) FILTER (prop = 'strike') AS strike, bool_or(val) FILTER (prop = 'hidden') AS hidden FROM b GROUP BY 1, 2"""

#: All paths without a note twice; the least one leads to a note's first visit.
NOTES = r"""WITH RECURSIVE n AS (SELECT conv_id AS d, 'n' || turn AS id, turn AS p, text FROM conversations WHERE turn % 5 <> 4 AND trim(text, ' ' || chr(10)) <> ''),
f AS (SELECT conv_id AS d, CASE WHEN turn % 3 <> 0 THEN 'n' || (turn // 2) END AS src, 100 - turn AS p, 'n' || ((turn * 7 + conv_id) % 6) AS dst FROM conversations),
w AS (SELECT f.d, dst AS id, [f.p] AS path, [dst] AS seen FROM f JOIN n ON n.d = f.d AND n.id = dst WHERE src IS NULL
  UNION ALL SELECT w.d, dst, list_append(path, f.p), list_append(seen, dst) FROM w JOIN f ON f.d = w.d AND f.src = w.id JOIN n ON n.d = f.d AND n.id = dst WHERE NOT list_contains(seen, dst)),
b AS (SELECT d, id, min(path) AS path FROM w GROUP BY 1, 2),
o AS (SELECT n.d, n.id, row_number() OVER (PARTITION BY n.d ORDER BY path NULLS LAST, n.p) AS k, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM n LEFT JOIN b ON b.d = n.d AND b.id = n.id)
SELECT d AS doc_id, id AS note_id, k::INT AS number, '[^' || k || ']: ' || regexp_replace(text, '\n([^\n])', E'\n    \\1', 'g') AS line FROM o"""

PORTABLE = """WITH e AS (SELECT event_id AS id, event_id % 8 AS k, replace(props, ' ', '') AS p, event_type AS t, to_base64(encode(event_type)) AS b FROM events)
SELECT id, CASE k WHEN 1 THEN 2 WHEN 2 THEN 9 WHEN 3 THEN 1 WHEN 6 THEN 1 WHEN 7 THEN 1 END::BIGINT AS entries, CASE k WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 0 WHEN 6 THEN 0 WHEN 7 THEN 0 END::INT AS depth,
  CASE k WHEN 1 THEN 11 WHEN 2 THEN 51 WHEN 3 THEN length(b) + 32 WHEN 6 THEN length(t) WHEN 7 THEN 2 END::BIGINT AS total_bytes, CASE k WHEN 1 THEN 1 WHEN 2 THEN 4 WHEN 3 THEN 0 WHEN 6 THEN length(t) WHEN 7 THEN 0 END::BIGINT AS text_bytes,
  CASE WHEN k = 3 THEN length(t) WHEN k IN (1, 2, 6, 7) THEN 0 END::BIGINT AS binary_bytes, CASE k WHEN 1 THEN p WHEN 2 THEN '{"a":[' || p || ',"é",null,true,false,-1.5]}' WHEN 3 THEN '{"$binary":"binary/base64","data":"' || b || '"}' WHEN 6 THEN '"' || t || '"' WHEN 7 THEN '[]' END AS canonical,
  CASE WHEN k IN (0, 4) THEN 'invalid-persistence' WHEN k = 5 THEN 'output-too-large' END AS error_code FROM e"""

QUERIES = {
    "html_table_grid": (html_table_grid, GRID),
    "level_numbers": (level_numbers, NUMBERS),
    "merge_commands": (merge_commands, MERGES + " SELECT s.sheet, step, kind, q.t AS top, q.l AS \"left\", q.b AS bottom, q.r AS \"right\", CASE WHEN bad THEN 'overlap' END AS error_code FROM s JOIN i USING (sheet, i)"),
    "merges_left": (merges_left, MERGES + ", z AS (SELECT sheet, unnest(now) AS q FROM s QUALIFY i = max(i) OVER (PARTITION BY sheet)) SELECT DISTINCT sheet, q.t AS top, q.l AS \"left\", q.b AS bottom, q.r AS \"right\" FROM z"),
    "style_chains": (style_chains, CHAINS),
    "formula_levels": (formula_levels, LEVELS),
    "edge_columns": (edge_columns, EDGES),
    "header_rows": (header_rows, "WITH c AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer) SELECT c_nationkey AS table_id, CASE WHEN c_nationkey % 6 = 0 THEN 1 WHEN c_nationkey % 6 = 5 AND NOT bool_or(r <= 50 AND c_mktsegment = 'BUILDING') THEN 1 ELSE 0 END::INT AS header_rows FROM c GROUP BY 1"),
    "ingest_keyed_store": (keyed_store, "SELECT sha256(text) AS sha256, arg_min(doc_id, [doc_id % 3, doc_id]) AS doc_id, arg_min(source, [doc_id % 3, doc_id]) AS source FROM documents GROUP BY 1"),
    "job_states": (job_states, JOBS),
    "note_order": (note_order, NOTES),
    "portable_values": (portable_values, PORTABLE),
    "style_cascade": (style_cascade, CASCADE),
    "sheet_rectangles": (sheet_rectangles, f"WITH {LINES} SELECT 'rs' || (k % 7) AS rect, 's' || (k % 7) AS sheet, k // 7 + 1 AS \"row\", n::BIGINT AS col, q AS num FROM o WHERE k // 7 >= 9 AND n >= 2"),
}
