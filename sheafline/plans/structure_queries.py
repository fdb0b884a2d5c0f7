"""Markup, structure, report and event queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheafline.functions import formulas as L
from sheafline.functions import markup as M
from sheafline.functions import text as X
from sheafline.functions.coordinates import address_column, column_number, letters_column
from sheafline.operators import documents as D
from sheafline.operators import structure as R
from sheafline.operators.rounds import dealt
from sheafline.plans.table_queries import load
from sheafline.sources.files import delimited_rows
from sheafline.streaming import events as E


def xml_codec(s, d):
    own = load(s, d, "documents").select("doc_id", F.concat("text", F.lit("<a b=\"c\"> & 'd'")).alias("t"))
    return own.select("doc_id", F.sha2(M.escape_xml(F.col("t")), 256).alias("escaped"), (M.unescape_xml(M.escape_xml(F.col("t"))) == F.col("t")).alias("same"))


def link_targets(s, d):
    own = load(s, d, "pages").withColumn("t", F.when(F.col("page_id") % 4 == 0, "#top").when(F.col("page_id") % 4 == 1, "C:\\x").when(F.col("page_id") % 4 == 2, F.col("url")).otherwise("a (b)|<c>"))
    return own.select("page_id", M.target_kind(F.col("t")).alias("kind"), M.markdown_url(F.col("t")).alias("target"))


def base64_codec(s, d):
    own = load(s, d, "documents").select("doc_id", F.base64(F.col("text").cast("binary")).alias("b"))
    clean = F.replace("b", F.lit("\r\n"), F.lit(""))
    return own.select("doc_id", F.sha2(clean, 256).alias("digest"), F.octet_length(M.canonical_base64(clean)).alias("n"), M.canonical_base64(F.concat(clean, F.lit("A"))).isNull().alias("rejected"))


def sha256_names(s, d):
    own = load(s, d, "part").withColumn("h", F.sha2("p_name", 256))
    return own.select("p_partkey", M.normal_sha256(F.concat(F.lit(" SHA256:"), F.upper("h"))).alias("h"), M.normal_sha256(F.substring("h", 1, 63)).alias("short"))


def number_formats(s, d):
    c = F.col("c_acctbal")
    return load(s, d, "customer").select("c_custkey", M.number_display(c, 2, True, accounting=True).alias("money"), M.number_display(c / 10000, 1, percent=True).alias("share"), M.number_display(c, 0).alias("whole"))


def markdown_table(s, d):
    return load(s, d, "nation").select("n_nationkey", M.table_line(F.col("n_nationkey"), F.concat("n_name", F.lit("|x\ny")), F.nullif("n_regionkey", F.lit(0))).alias("line"))


def addresses(s, d):
    n = F.pmod(F.col("l_orderkey"), F.lit(16384)) + 1
    own = load(s, d, "lineitem").select("l_orderkey", "l_linenumber", letters_column(n).alias("name"), n.alias("n"))
    return own.select("l_orderkey", "l_linenumber", address_column(F.col("l_linenumber"), F.col("n")).alias("address"), (column_number(F.col("name")) == F.col("n")).alias("same"))


def note_numbers(s, d):
    """Conversation turns as references to notes named by role and length."""
    own = load(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("position"), F.concat("role", (F.length("text") % 5).cast("string")).alias("note_id"))
    return R.numbered_notes(own)


def unique_slugs(s, d):
    own = load(s, d, "part").select(F.floor(F.col("p_partkey") / 100).alias("doc_id"), F.col("p_partkey").alias("position"), X.heading_slug(F.col("p_brand")).alias("slug"))
    return R.claimed_slugs(own)


def link_audit(s, d):
    anchors = unique_slugs(s, d)
    links = load(s, d, "supplier").select(F.floor(F.col("s_suppkey") / 5).alias("doc_id"), F.concat(F.lit("brand"), (F.col("s_nationkey") + 1).cast("string")).alias("anchor"), F.col("s_suppkey").alias("link"))
    return R.resolved_links(links, anchors).select("doc_id", "link", F.col("target_position").isNotNull().alias("found"))


def asset_budget(s, d):
    own = load(s, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("position"), (F.col("l_partkey") % 4).cast("string").alias("part"), F.col("l_quantity").cast("long").alias("size"))
    # the least order of a part's lines stands for ties
    own = own.groupBy("doc_id", "position").agg(F.min("part").alias("part"), F.min("size").alias("size"))
    return R.distinct_assets(own, 60).select("doc_id", "part", "total", "kept")


def covered_cells(s, d):
    own = load(s, d, "part").select((F.col("p_partkey") % 5).alias("table_id"), F.col("p_partkey").cast("int").alias("row"), F.lit(1).alias("col"), (F.col("p_size") % 3 + 1).alias("row_span"), (F.col("p_size") % 2 + 1).alias("col_span"))
    return R.covered_grid(own).select("table_id", "row", "r", "c", "origin")


def header_vote(s, d):
    own = load(s, d, "customer")
    cells = own.select((F.col("c_custkey") + 1).cast("int").alias("row"), F.explode(F.array(F.struct(F.lit(1).alias("col"), F.col("c_name").alias("text")), F.struct(F.lit(2).alias("col"), F.col("c_nationkey").cast("string").alias("text")), F.struct(F.lit(3).alias("col"), F.format_number("c_acctbal", 2).alias("text")))).alias("c")).select("c.col", "row", "c.text")
    names = own.limit(1).select(F.lit(0).alias("row"), F.posexplode(F.array(F.lit("name"), F.lit("nation"), F.lit("balance"))).alias("i", "text")).select((F.col("i") + 1).alias("col"), "row", "text")
    return R.header_votes(cells.unionByName(names))


def modal_widths(s, d):
    own = load(s, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("int").alias("width"))
    return R.modal_width(own.select((F.col("l_orderkey") % 20).alias("table_id"), "width"))


def due_jobs(s, d):
    own = load(s, d, "events").select(
        F.col("event_id").alias("job_id"), F.element_at(F.array(*map(F.lit, ("queued", "retry", "running", "done"))), (F.col("event_id") % 4 + 1).cast("int")).alias("state"),
        (F.col("user_id") % 4 + 1).alias("attempt"), F.lit(4).alias("max_attempts"), F.col("value").alias("due_at"), (F.col("value") + 1).alias("lease_until"),
    )
    return R.due_jobs(own, F.lit(20.0))


def number_patterns(s, d):
    """Numbers and serial dates under format strings."""
    c = F.col("c_acctbal")
    own = load(s, d, "customer")
    return own.select(
        "c_custkey", M.formatted(c, '#,##0.00;[Red](#,##0.00)').alias("money"), M.formatted(c / 10000, "0.0%").alias("share"), M.formatted(c, '0" kg"').alias("weight"),
        M.formatted(F.when(F.col("c_custkey") % 3 == 0, F.lit(0.0)).otherwise(F.col("c_nationkey")), '0;-0;"none"').alias("parts"), M.formatted(F.col("c_custkey") + 40000.0, "dd/mm/yyyy").alias("day"),
        M.formatted(F.col("c_custkey") + 40000.0 + F.col("c_custkey") % 1440 / 1440, 'yyyy-mm-dd "at" h:mm:ss am/pm').alias("moment"), M.formatted(c, '"EUR" 000.0').alias("price"),
    )


def escaped_names(s, d):
    own = load(s, d, "part").withColumn("t", F.concat(F.when(F.col("p_partkey") % 3 == 0, "1. ").when(F.col("p_partkey") % 3 == 1, "# ").otherwise("- "), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(" *"), "p_brand", F.lit("* [x] &amp; a` _y_ ~z ~ <b> < c")))
    return own.select("p_partkey", M.escaped_text(F.col("t")).alias("shown"), M.code_span(F.col("t")).alias("code"))


def html_table_cells(s, d):
    """Parts written as HTML tables, read back as cells."""
    names = F.concat(F.lit("<tr><th>name<th>brand &amp; size</tr><tr><td>"), "p_name", F.lit("</td><td colspan="), (F.col("p_size") % 3 + 1).cast("string"), F.lit("><b>"), "p_brand", F.lit("</b> "), F.col("p_size").cast("string"), F.lit("</table>"))
    own = load(s, d, "part").select(F.col("p_partkey").alias("page_id"), F.concat(F.lit("<p>x<table>"), names, F.lit("<p>y")).alias("html"))
    return D.html_tables(own).select("page_id", "row_no", "cell_no", "header", "col_span", "text")


def delimited_records(s, d):
    """Customers written as delimited texts of a hundred lines, read back as records."""
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('; ""q""\nx"'))
    line = F.concat_ws(";", F.col("c_custkey").cast("string"), quoted(F.col("c_name")), "c_mktsegment")
    own = load(s, d, "customer").select(F.floor(F.col("c_custkey") / 100).cast("long").alias("file"), "c_custkey", line.alias("line"))
    texts = own.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "line"))), lambda x: x["line"]), "\n").alias("text"))  # a hundred lines
    broken = F.when(F.col("file") % 4 == 3, F.concat("text", F.lit('\n"open'))).otherwise(F.col("text"))
    rows = delimited_rows(texts.select("file", broken.alias("text"), F.lit(";").alias("delimiter")), "file")
    return rows.select("file", "row_no", F.concat_ws("|", "cells").alias("cells"), "error_code")


def highlights(s, d):
    return load(s, d, "documents").select("doc_id", F.regexp_count(F.lower("text"), F.lit("the")).alias("hits"))


def report_means(s, d):
    """Medians by group and the mean of the groups' means, as a benchmark report has them."""
    own = load(s, d, "lineitem")
    by = own.groupBy("l_returnflag").agg(F.median("l_quantity").alias("median"), F.avg("l_discount").alias("mean"))
    macro = by.agg(F.avg("mean").alias("macro")).withColumn("one", F.lit(1))  # one row
    return by.withColumn("one", F.lit(1)).join(F.broadcast(macro), "one").select("l_returnflag", "median", F.round("mean", 8).alias("mean"), F.round(100 * F.col("macro"), 4).alias("macro_pct"))


def event_windows(s, d):
    """Extension: counts in hourly windows."""
    return E.windowed(load(s, d, "events")).withColumn("total", F.round("total", 4))


def event_sessions(s, d):
    """Extension: sessions of a user."""
    return E.sessions(load(s, d, "events"))


def source_limits(s, d):
    """Documents over a byte budget become error rows instead of failures."""
    own = load(s, d, "documents").select("doc_id", F.octet_length("text").alias("n_bytes"), F.when(F.octet_length("text") > 10_000, "resourceLimit").alias("error_code"))
    return own


def formula_shift(s, d):
    size = F.col("p_size").cast("string")
    part = load(s, d, "part").select("p_partkey", "p_size")
    own = dealt(part, part.count(), 5_000).select("p_partkey", F.concat(F.concat(F.lit("Q$"), (F.col("p_partkey") % 97 + 1).cast("string"), F.lit("-")), F.lit("SUM(A"), size, F.lit(":$B$"), size, F.lit(')+Other!c7&"A1"+D$2*XFD1')).alias("f"))
    return own.select("p_partkey", L.shifted(F.col("f"), 2, 3).alias("moved"), L.shifted(F.col("f"), -60, 0).alias("up"))


def sheet_rename(s, d):
    own = load(s, d, "nation").select("n_nationkey", F.concat(F.lit("'my data'!A1+Old!B2&\"Old!C3\"+older!D4+OLD!E"), (F.col("n_nationkey") + 1).cast("string")).alias("f"))
    return own.select("n_nationkey", L.renamed_sheet(F.col("f"), "Old", "it's new").alias("a"), L.renamed_sheet(F.col("f"), "My Data", "x").alias("b"))


def component_decoding(s, d):
    own = load(s, d, "customer").select("c_custkey", F.concat(F.get(F.array(*map(F.lit, ("a%20b+c%C3%A9", "a%C3%A9%FFb", "%zz%2%E2%82", "100%"))), (F.col("c_custkey") % 4).cast("int")), F.col("c_custkey").cast("string")).alias("t"))
    return own.select("c_custkey", M.decoded_component(F.col("t")).alias("decoded"))


def media_types(s, d):
    own = load(s, d, "part").withColumn("e", F.element_at(F.array(*map(F.lit, ("PNG", "jpg", "xyz"))), (F.col("p_partkey") % 3 + 1).cast("int")))
    return own.select("p_partkey", M.media_type(F.col("e")).alias("media_type"))


def path_resolution(s, d):
    own = load(s, d, "supplier").withColumn("t", F.element_at(F.array(*map(F.lit, ("../media/i.png", "x/./y.xml#a", "/abs/z.xml", "../../../../up.xml"))), (F.col("s_suppkey") % 4 + 1).cast("int")))
    return own.select("s_suppkey", M.resolved_path(F.lit("word/sub/document.xml"), F.col("t")).alias("path"))


def iso_durations(s, d):
    own = load(s, d, "part").withColumn("t", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("PT"), F.col("p_size").cast("string"), F.lit("H5M"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("-P1DT"), F.col("p_size").cast("string"), F.lit("S"))).otherwise("P1M"))
    return own.select("p_partkey", M.duration_clock(F.col("t")).alias("clock"))


def merge_overlaps(s, d):
    own = load(s, d, "part").select((F.col("p_partkey") % 3).alias("sheet"), F.col("p_partkey").alias("merge_id"), F.col("p_partkey").alias("top"), (F.col("p_size") % 5).alias("left"), (F.col("p_partkey") + F.col("p_size")).alias("bottom"), (F.col("p_size") % 5 + 1).alias("right"))
    return R.overlapping_merges(own)


def features(s, d):
    return R.feature_manifest(load(s, d, "events").select((F.col("user_id") % 10).alias("workbook"), F.col("event_type").alias("feature")))


SLUGS = "s AS (SELECT p_partkey // 100 AS doc_id, p_partkey AS position, replace(regexp_replace(lower(trim(p_brand)), '[^\\p{L}\\p{N}\\p{M}\\p{Pc} -]', '', 'g'), ' ', '-') AS slug FROM part), a AS (SELECT doc_id, position, slug || CASE WHEN row_number() OVER (PARTITION BY doc_id, slug ORDER BY position) = 1 THEN '' ELSE '-' || (row_number() OVER (PARTITION BY doc_id, slug ORDER BY position) - 1) END AS anchor FROM s)"
LETTERS = "CASE WHEN n > 702 THEN chr((65 + ((n - 703) // 676) % 26)::INTEGER) ELSE '' END || CASE WHEN n > 26 THEN chr((65 + ((n - 27) // 26) % 26)::INTEGER) ELSE '' END || chr((65 + (n - 1) % 26)::INTEGER)"

QUERIES = {
    "xml_codec": (xml_codec, "WITH t AS (SELECT doc_id, text || '<a b=\"c\"> & ''d''' AS t FROM documents) SELECT doc_id, sha256(replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')) AS escaped, true AS same FROM t"),
    "link_targets": (link_targets, "SELECT page_id, ['anchor', 'relative', 'external', 'relative'][page_id % 4 + 1] AS kind, CASE page_id % 4 WHEN 0 THEN '#top' WHEN 1 THEN 'C:\\x' WHEN 2 THEN CASE WHEN regexp_matches(url, '[ ()]') THEN '<' || url || '>' ELSE url END ELSE '<a (b)%7C%3Cc%3E>' END AS target FROM pages"),
    "base64_codec": (base64_codec, "SELECT doc_id, sha256(to_base64(encode(text))) AS digest, octet_length(encode(text))::INTEGER AS n, true AS rejected FROM documents"),
    "sha256_names": (sha256_names, "SELECT p_partkey, sha256(p_name) AS h, NULL::VARCHAR AS short FROM part"),
    "number_formats": (
        number_formats,
        "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '(' || format('{:,.2f}', abs(c_acctbal)) || ')' ELSE format('{:,.2f}', c_acctbal) END AS money, CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END || format('{:.1f}', abs(c_acctbal / 10000 * 100)) || '%' AS share, CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END || format('{:.0f}', abs(c_acctbal)) AS whole FROM customer",
    ),
    "number_patterns": (
        number_patterns,
        "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '(' || format('{:,.2f}', abs(c_acctbal)) || ')' ELSE format('{:,.2f}', c_acctbal) END AS money, CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END || format('{:.1f}', abs(c_acctbal / 10000 * 100)) || '%' AS share, CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END || format('{:.0f}', abs(c_acctbal)) || ' kg' AS weight, CASE WHEN c_custkey % 3 = 0 OR c_nationkey = 0 THEN 'none' ELSE c_nationkey::VARCHAR END AS parts, CASE WHEN c_custkey + 40000 > 2958465 THEN (c_custkey + 40000)::VARCHAR ELSE strftime(DATE '1899-12-30' + (c_custkey + 40000)::INTEGER, '%d/%m/%Y') END AS day, CASE WHEN c_custkey + 40000 > 2958465 THEN regexp_replace((c_custkey + 40000.0::DOUBLE + c_custkey % 1440 / 1440)::VARCHAR, '[.]0$', '') ELSE strftime(DATE '1899-12-30' + (c_custkey + 40000)::INTEGER + to_minutes(c_custkey % 1440), '%Y-%m-%d at %-I:%M:%S %p') END AS moment, CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END || 'EUR ' || lpad(format('{:.1f}', abs(c_acctbal)), greatest(5, length(format('{:.1f}', abs(c_acctbal)))::INT), '0') AS price FROM customer",
    ),
    "escaped_text": (
        escaped_names,
        "SELECT p_partkey, ['1\\. ', '\\# ', '\\- '][p_partkey % 3 + 1] || replace(p_name, ' ', '_') || ' \\*' || p_brand || '* \\[x] &amp;amp; a` \\_y_ \\~z ~ \\<b> < c' AS shown, '``' || ['1. ', '# ', '- '][p_partkey % 3 + 1] || replace(p_name, ' ', '_') || ' *' || p_brand || '* [x] &amp; a` _y_ ~z ~ <b> < c``' AS code FROM part",
    ),
    "html_table_cells": (
        html_table_cells,
        "SELECT p_partkey AS page_id, 1 AS row_no, 1 AS cell_no, true AS header, 1 AS col_span, 'name' AS text FROM part UNION ALL SELECT p_partkey, 1, 2, true, 1, 'brand & size' FROM part UNION ALL SELECT p_partkey, 2, 1, false, 1, p_name FROM part UNION ALL SELECT p_partkey, 2, 2, false, p_size % 3 + 1, p_brand || ' ' || p_size FROM part",
    ),
    "delimited_records": (
        delimited_records,
        "SELECT c_custkey // 100 AS file, row_number() OVER (PARTITION BY c_custkey // 100 ORDER BY c_custkey) - 1 AS row_no, c_custkey || '|' || c_name || '; \"q\"' || chr(10) || 'x|' || c_mktsegment AS cells, NULL::VARCHAR AS error_code FROM customer WHERE c_custkey // 100 % 4 <> 3 UNION ALL SELECT DISTINCT c_custkey // 100, NULL::BIGINT, '', 'malformed' FROM customer WHERE c_custkey // 100 % 4 = 3",
    ),
    "markdown_table": (markdown_table, "SELECT n_nationkey, '| ' || n_nationkey || ' | ' || n_name || '\\|x<br>y | ' || coalesce(nullif(n_regionkey, 0)::VARCHAR, '') || ' |' AS line FROM nation"),
    "cell_addresses": (addresses, f"WITH t AS (SELECT l_orderkey, l_linenumber, l_orderkey % 16384 + 1 AS n FROM lineitem) SELECT l_orderkey, l_linenumber, {LETTERS} || l_linenumber AS address, true AS same FROM t"),
    "note_numbers": (
        note_numbers,
        "WITH f AS (SELECT conv_id AS doc_id, role || (length(text) % 5) AS note_id, min(turn) AS first FROM conversations GROUP BY 1, 2) SELECT doc_id, note_id, row_number() OVER (PARTITION BY doc_id ORDER BY first, note_id)::INTEGER AS number FROM f",
    ),
    "unique_slugs": (unique_slugs, f"WITH {SLUGS} SELECT * FROM a"),
    "link_audit": (link_audit, f"WITH {SLUGS}, l AS (SELECT s_suppkey // 5 AS doc_id, 'brand' || (s_nationkey + 1) AS anchor, s_suppkey AS link FROM supplier) SELECT l.doc_id, link, position IS NOT NULL AS found FROM l LEFT JOIN a ON l.doc_id = a.doc_id AND l.anchor = a.anchor"),
    "asset_budget": (
        asset_budget,
        "WITH o AS (SELECT l_orderkey AS doc_id, l_linenumber::BIGINT AS position, min((l_partkey % 4)::VARCHAR) AS part, min(l_quantity::BIGINT) AS size FROM lineitem GROUP BY 1, 2), f AS (SELECT doc_id, part, min(position) AS position, arg_min(size, position) AS size FROM o GROUP BY 1, 2), t AS (SELECT *, sum(size) OVER (PARTITION BY doc_id ORDER BY position, part ROWS UNBOUNDED PRECEDING)::BIGINT AS total FROM f) SELECT doc_id, part, total, total <= 60 AS kept FROM t",
    ),
    "covered_cells": (
        covered_cells,
        "WITH o AS (SELECT p_partkey % 5 AS table_id, p_partkey::INTEGER AS \"row\", unnest(range(p_partkey, p_partkey + p_size % 3 + 1))::INTEGER AS r, p_size FROM part) SELECT table_id, \"row\", r, c::INTEGER AS c, r = \"row\" AND c = 1 AS origin FROM (SELECT *, unnest(range(1, p_size % 2 + 2)) AS c FROM o)",
    ),
    "header_votes": (
        header_vote,
        "WITH c AS (SELECT 1 AS col, c_name AS v FROM customer UNION ALL SELECT 2, c_nationkey::VARCHAR FROM customer UNION ALL SELECT 3, format('{:,.2f}', c_acctbal) FROM customer), k AS (SELECT col, CASE WHEN regexp_matches(v, '^[-+]?[0-9][0-9,]*([.][0-9]+)?$') THEN 'number' ELSE 'text' END AS kind FROM c WHERE v IS NOT NULL), n AS (SELECT col, kind, count(*) AS n FROM k GROUP BY 1, 2), t AS (SELECT col, arg_max(kind, n) AS body_kind, max(n) AS top, sum(n) AS total FROM n GROUP BY 1) SELECT col, 'text' AS head_kind, body_kind, top * 10 >= total * 9 AND body_kind <> 'text' AS votes FROM t",
    ),
    "modal_width": (
        modal_widths,
        "WITH w AS (SELECT l_orderkey, count(*)::INTEGER AS width FROM lineitem GROUP BY 1), n AS (SELECT l_orderkey % 20 AS table_id, width, count(*) AS n FROM w GROUP BY 1, 2) SELECT table_id, width FROM (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY n DESC, width DESC) AS k FROM n) WHERE k = 1",
    ),
    "ingest_due_jobs": (
        due_jobs,
        "WITH j AS (SELECT event_id AS job_id, event_id % 4 AS k, user_id % 4 + 1 AS attempt, value FROM events) SELECT job_id, 'running' AS state, attempt + 1 AS attempt, NULL::VARCHAR AS error_code FROM j WHERE attempt < 4 AND (k = 0 OR (k = 1 AND value <= 20) OR (k = 2 AND value <= 19)) UNION ALL SELECT job_id, 'failed', attempt, 'lease-lost' FROM j WHERE attempt = 4 AND k = 2 AND value <= 19",
    ),
    "highlight_counts": (highlights, "SELECT doc_id, len(regexp_extract_all(lower(text), 'the'))::INTEGER AS hits FROM documents"),
    "report_means": (
        report_means,
        "WITH b AS (SELECT l_returnflag, median(l_quantity) AS median, avg(l_discount) AS mean FROM lineitem GROUP BY 1) SELECT l_returnflag, median, round(mean, 8) AS mean, round(100 * (SELECT avg(mean) FROM b), 4) AS macro_pct FROM b",
    ),
    "event_windows": (event_windows, "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"),
    "event_sessions": (
        event_sessions,
        "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k",
    ),
    "source_limits": (source_limits, "SELECT doc_id, octet_length(encode(text))::INTEGER AS n_bytes, CASE WHEN octet_length(encode(text)) > 10000 THEN 'resourceLimit' END AS error_code FROM documents"),
    "formula_shift": (
        formula_shift,
        "SELECT p_partkey, 'T$' || (p_partkey % 97 + 1) || '-SUM(D' || (p_size + 2) || ':$B$' || p_size || ')+Other!F9&\"A1\"+G$2*#REF!' AS moved, 'Q$' || (p_partkey % 97 + 1) || '-SUM(#REF!:$B$' || p_size || ')+#REF!&\"A1\"+D$2*#REF!' AS up FROM part",
    ),
    "sheet_rename": (
        sheet_rename,
        "SELECT n_nationkey, '''my data''!A1+''it''''s new''!B2&\"Old!C3\"+older!D4+''it''''s new''!E' || (n_nationkey + 1) AS a, '''x''!A1+Old!B2&\"Old!C3\"+older!D4+OLD!E' || (n_nationkey + 1) AS b FROM nation",
    ),
    "component_decoding": (component_decoding, "SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 AND c_custkey > 9 THEN '100' || chr(CASE WHEN substr(c_custkey::VARCHAR, 1, 1) < '8' THEN ('0x' || substr(c_custkey::VARCHAR, 1, 2))::INT ELSE 65533 END) || substr(c_custkey::VARCHAR, 3) ELSE ['a b+cé', 'aé' || chr(65533) || 'b', '%zz%2' || chr(65533), '100%'][c_custkey % 4 + 1] || c_custkey END AS decoded FROM customer"),
    "media_types": (media_types, "SELECT p_partkey, ['image/png', 'image/jpeg', 'application/octet-stream'][p_partkey % 3 + 1] AS media_type FROM part"),
    "path_resolution": (path_resolution, "SELECT s_suppkey, ['word/media/i.png', 'word/sub/x/y.xml', 'abs/z.xml', 'up.xml'][s_suppkey % 4 + 1] AS path FROM supplier"),
    "iso_durations": (
        iso_durations,
        "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN lpad(p_size::VARCHAR, 2, '0') || ':05:00' WHEN 1 THEN '-24:00:' || lpad(p_size::VARCHAR, 2, '0') ELSE 'P1M' END AS clock FROM part",
    ),
    "merge_overlaps": (
        merge_overlaps,
        "WITH m AS (SELECT p_partkey % 3 AS sheet, p_partkey AS id, p_partkey AS t, p_size % 5 AS l, p_partkey + p_size AS b FROM part) SELECT x.sheet, x.id AS a, y.id AS b FROM m x JOIN m y ON x.sheet = y.sheet AND x.id < y.id AND x.t <= y.b AND y.t <= x.b AND x.l <= y.l + 1 AND y.l <= x.l + 1",
    ),
    "feature_manifest": (features, "SELECT user_id % 10 AS workbook, event_type AS feature, count(*) AS n FROM events GROUP BY 1, 2"),
}
