"""Text, page, conversation and ingestion queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheafline.functions import text as X
from sheafline.functions.coordinates import letters_column
from sheafline.functions.values import number_text
from sheafline.operators import documents as D
from sheafline.plans.table_queries import load
from sheafline.sources.files import sniffed_delimiter
from sheafline.streaming import ingest as I


def search_text(s, d):
    docs = load(s, d, "documents")
    return docs.where(F.contains(F.lower("text"), F.lit("license"))).select("doc_id", "lang", "source")


def text_line_search(s, d):
    return D.matching_lines(load(s, d, "documents"), "license")


def clean_text(s, d):
    docs = load(s, d, "documents").select("doc_id", X.clean_text(F.concat(F.col("text"), F.lit(" ​\r\nend­\ttab"))).alias("t"))
    return docs.select("doc_id", F.sha2("t", 256).alias("digest"))


def collapse_space(s, d):
    docs = load(s, d, "documents").select("doc_id", X.collapse_space(F.concat(F.lit("  "), F.col("text"), F.lit("\n\n"))).alias("t"))
    return docs.select("doc_id", F.length("t").alias("n"), F.sha2("t", 256).alias("digest"))


def first_line():
    return F.element_at(F.split("text", "\n"), 1)


def heading_slug(s, d):
    return load(s, d, "documents").select("doc_id", X.heading_slug(first_line()).alias("slug"))


def anchor_id(s, d):
    return load(s, d, "documents").select("doc_id", X.anchor_id(first_line()).alias("anchor"))


def fold(s, d):
    return load(s, d, "part").select("p_partkey", X.fold(F.concat(F.lit(" "), "p_name", F.lit("  "))).alias("folded"))


def backtick_fence(s, d):
    own = load(s, d, "part").withColumn("t", F.concat("p_name", F.repeat(F.lit("`"), F.col("p_size") % 7), F.lit(" x `")))
    return own.select("p_partkey", X.backtick_fence(F.col("t")).alias("fence"))


def value_kind(s, d):
    own = load(s, d, "events")
    field = F.get_json_object("props", "$.page")
    return own.select("event_id", X.value_kind(F.when(F.col("event_id") % 5 == 0, F.date_format("ts", "yyyy-MM-dd")).when(F.col("event_id") % 5 == 1, F.date_format("ts", "HH:mm")).when(F.col("event_id") % 5 == 2, F.col("event_id").cast("string")).when(F.col("event_id") % 5 == 3, F.lit(" ")).otherwise(F.coalesce(field, F.lit("n/a")))).alias("kind")).groupBy("kind").count().withColumnRenamed("count", "n")


def column_letters(s, d):
    return load(s, d, "part").select("p_partkey", letters_column(F.pmod(F.col("p_partkey"), F.lit(16384)) + 1).alias("letters"))


def roman_markers(s, d):
    return load(s, d, "part").select("p_partkey", X.roman_marker(F.col("p_partkey").cast("int")).alias("marker"))


def alpha_markers(s, d):
    return load(s, d, "part").select("p_partkey", X.alpha_marker(F.pmod(F.col("p_partkey"), F.lit(16384)) + 1).alias("marker"))


def serial_dates(s, d):
    serial = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1899-12-30").cast("date")).cast("double")
    return load(s, d, "orders").select("o_orderkey", X.serial_to_date(serial).alias("day"), X.serial_to_date(F.lit(40.0) + F.col("o_orderkey") % 30).alias("early"))


def durations(s, d):
    return load(s, d, "events").select("event_id", X.clock_of_days(F.round(F.col("value") / 7, 3)).alias("clock"))


def number_texts(s, d):
    return load(s, d, "part").select("p_partkey", number_text(F.col("p_size") / 4).alias("quarter"), number_text(F.col("p_size") * F.lit(1e15)).alias("large"))


def sha256_verify(s, d):
    return I.keyed(load(s, d, "documents")).select("doc_id", "sha256", (F.col("sha256") == F.sha2("text", 256)).alias("ok"))


def url_formats(s, d):
    own = load(s, d, "pages").withColumn("path", F.concat("url", F.element_at(F.array(*map(F.lit, (".XLSX", ".docm", ".csv?x=1", ".zip"))), (F.col("page_id") % 4 + 1).cast("int"))))
    bare = F.regexp_replace("path", r"[?#][^.]*(?=\.)", "")
    return own.select("page_id", X.format_of(bare).alias("format"), X.safe_url(F.col("url")).alias("safe"), X.file_name(F.col("url")).alias("file_name"))


def markdown_counts(s, d):
    own = load(s, d, "documents").withColumn("text", F.concat(F.lit("# t\n- a [x](y)\n1. b\n| c |\n[^1]: d\n"), "text"))
    return D.markdown_counts(own).select("doc_id", "chars", "headings", "table_rows", "list_items", "links", "footnotes")


def trigram_containment(s, d):
    return D.containment(load(s, d, "documents"), load(s, d, "benchmark")).select("doc_id", "item_id", F.round("containment", 6).alias("containment"))


def html_blocks(s, d):
    return D.html_blocks(load(s, d, "pages"))


def html_links(s, d):
    return D.html_links(load(s, d, "pages"))


def html_lists(s, d):
    return D.html_lists(load(s, d, "pages"))


def html_markdown(s, d):
    return D.html_markdown(load(s, d, "pages"))


def role_runs(s, d):
    return D.runs_of_roles(load(s, d, "conversations")).select("conv_id", "run", "role", "first_turn", "turns", "chars")


def ingest_dedupe(s, d):
    return I.first_of_each(I.keyed(load(s, d, "documents")).select("sha256", "doc_id", "source")).select("sha256", "doc_id", "source")


def latest_state(s, d):
    own = load(s, d, "events").select("user_id", "event_id", "event_type")
    return I.latest_state(own, "user_id", "event_id").select("user_id", "event_id", "event_type")


def retry_delays(s, d):
    return load(s, d, "events").select("event_id", I.retry_delay(F.col("event_id") % 5 + 1).alias("delay"))


def delimiters(s, d):
    """The delimiter told from customers written as delimited text."""
    own = load(s, d, "customer").withColumn("sep", F.element_at(F.array(*map(F.lit, (",", ";", "\t", "|"))), (F.col("c_custkey") % 4 + 1).cast("int")))
    lines = F.concat_ws("\n", *(F.concat_ws("~", F.lit(h), "c_name", "c_mktsegment") for h in ("a", "b", "c")))
    return own.select("c_custkey", sniffed_delimiter(lines).alias("none"), sniffed_delimiter(F.replace(lines, F.lit("~"), F.col("sep"))).alias("told"))


QUERIES = {
    "search_text": (search_text, "SELECT doc_id, lang, source FROM documents WHERE contains(lower(text), 'license')"),
    "text_line_search": (
        text_line_search,
        "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents) SELECT doc_id, line_no::INTEGER AS line_no, line FROM l WHERE contains(lower(line), 'license')",
    ),
    "clean_text": (
        clean_text,
        "WITH t AS (SELECT doc_id, text || chr(160) || chr(8203) || chr(13) || chr(10) || 'end' || chr(173) || chr(9) || 'tab' AS t FROM documents), u AS (SELECT doc_id, replace(replace(replace(replace(t, chr(13) || chr(10), ' '), chr(13), ' '), chr(10), ' '), chr(160), ' ') AS t FROM t) SELECT doc_id, sha256(replace(replace(replace(t, chr(173), ''), chr(8203), ''), chr(65279), '')) AS digest FROM u",
    ),
    "collapse_space": (collapse_space, "WITH t AS (SELECT doc_id, regexp_replace('  ' || text || chr(10) || chr(10), '\\s+', ' ', 'g') AS t FROM documents) SELECT doc_id, length(t)::INTEGER AS n, sha256(t) AS digest FROM t"),
    "heading_slug": (
        heading_slug,
        "WITH t AS (SELECT doc_id, replace(regexp_replace(lower(trim(string_split(text, chr(10))[1])), '[^\\p{L}\\p{N}\\p{M}\\p{Pc} -]', '', 'g'), ' ', '-') AS s FROM documents) SELECT doc_id, CASE WHEN s = '' THEN 'section' ELSE s END AS slug FROM t",
    ),
    "anchor_id": (
        anchor_id,
        "WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(lower(string_split(text, chr(10))[1]), '[^a-z0-9_-]', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS s FROM documents) SELECT doc_id, CASE WHEN s = '' THEN 'anchor' ELSE s END AS anchor FROM t",
    ),
    "fold": (fold, "SELECT p_partkey, lower(trim(p_name)) AS folded FROM part"),
    "backtick_fence": (backtick_fence, "SELECT p_partkey, repeat('`', greatest(3, greatest(1, p_size % 7) + 1)) AS fence FROM part"),
    "value_kind": (
        value_kind,
        "WITH e AS (SELECT event_id % 5 AS k, json_extract_string(props, '$.page') AS p FROM events) SELECT CASE k WHEN 0 THEN 'date' WHEN 1 THEN 'time' WHEN 2 THEN 'number' WHEN 3 THEN 'blank' ELSE CASE WHEN regexp_matches(coalesce(p, 'n/a'), '^[0-9]+$') THEN 'number' ELSE 'text' END END AS kind, count(*) AS n FROM e GROUP BY 1",
    ),
    "column_letters": (
        column_letters,
        "WITH p AS (SELECT p_partkey, p_partkey % 16384 + 1 AS n FROM part) SELECT p_partkey, CASE WHEN n > 702 THEN chr((65 + ((n - 703) // 676) % 26)::INTEGER) ELSE '' END || CASE WHEN n > 26 THEN chr((65 + ((n - 27) // 26) % 26)::INTEGER) ELSE '' END || chr((65 + (n - 1) % 26)::INTEGER) AS letters FROM p",
    ),
    "marker_roman": (
        roman_markers,
        "SELECT p_partkey, CASE WHEN p_partkey NOT BETWEEN 1 AND 3999 THEN p_partkey::VARCHAR ELSE ['', 'm', 'mm', 'mmm'][p_partkey // 1000 % 10 + 1] || ['', 'c', 'cc', 'ccc', 'cd', 'd', 'dc', 'dcc', 'dccc', 'cm'][p_partkey // 100 % 10 + 1] || ['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'][p_partkey // 10 % 10 + 1] || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][p_partkey % 10 + 1] END AS marker FROM part",
    ),
    "marker_alpha": (
        alpha_markers,
        "WITH p AS (SELECT p_partkey, p_partkey % 16384 + 1 AS n FROM part) SELECT p_partkey, lower(CASE WHEN n > 702 THEN chr((65 + ((n - 703) // 676) % 26)::INTEGER) ELSE '' END || CASE WHEN n > 26 THEN chr((65 + ((n - 27) // 26) % 26)::INTEGER) ELSE '' END || chr((65 + (n - 1) % 26)::INTEGER)) AS marker FROM p",
    ),
    "excel_serial_to_date": (
        serial_dates,
        "SELECT o_orderkey, o_orderdate::DATE AS day, DATE '1899-12-30' + (40 + o_orderkey % 30 + CASE WHEN o_orderkey % 30 < 20 THEN 1 ELSE 0 END)::INTEGER AS early FROM orders",
    ),
    "duration_clock": (
        durations,
        "WITH t AS (SELECT event_id, round(abs(round(value / 7, 3)) * 86400)::BIGINT AS s, round(value / 7, 3) < 0 AS m FROM events) SELECT event_id, CASE WHEN m THEN '-' ELSE '' END || (s // 3600) || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS clock FROM t",
    ),
    "number_text": (
        number_texts,
        "SELECT p_partkey, regexp_replace((p_size / 4.0)::DOUBLE::VARCHAR, '\\.0$', '') AS quarter, (p_size * 1000000000000000)::VARCHAR AS large FROM part",
    ),
    "sha256_verify": (sha256_verify, "SELECT doc_id, sha256(text) AS sha256, true AS ok FROM documents"),
    "format_from_extension": (
        url_formats,
        "SELECT page_id, ['excel', 'docx', 'csv', NULL][page_id % 4 + 1] AS format, regexp_matches(url, '^(https?|mailto|tel):') AS safe, substr(trim(regexp_replace(url, '[\\x00-\\x1f\\x7f/\\\\]', '_', 'g')), 1, 240) AS file_name FROM pages",
    ),
    "markdown_counts": (
        markdown_counts,
        "WITH t AS (SELECT doc_id, '# t' || chr(10) || '- a [x](y)' || chr(10) || '1. b' || chr(10) || '| c |' || chr(10) || '[^1]: d' || chr(10) || text AS t FROM documents) SELECT doc_id, length(t)::INTEGER AS chars, len(regexp_extract_all(t, '(?m)^#{1,6} '))::INTEGER AS headings, len(regexp_extract_all(t, '(?m)^\\|'))::INTEGER AS table_rows, len(regexp_extract_all(t, '(?m)^ *(?:[-*+]|[0-9]+\\.) '))::INTEGER AS list_items, len(regexp_extract_all(t, '\\]\\('))::INTEGER AS links, len(regexp_extract_all(t, '(?m)^\\[\\^[^\\]]+\\]:'))::INTEGER AS footnotes FROM t",
    ),
    "trigram_containment": (
        trigram_containment,
        "WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents), g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS g FROM w), "
        "bw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM benchmark), bg AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS g FROM bw), n AS (SELECT item_id, count(*) AS n FROM bg GROUP BY 1) "
        "SELECT doc_id, item_id, round(count(*) / any_value(n), 6) AS containment FROM g JOIN bg USING (g) JOIN n USING (item_id) GROUP BY 1, 2",
    ),
    "html_blocks": (html_blocks, None),
    "html_links": (html_links, None),
    "html_lists": (html_lists, None),
    "html_to_markdown": (html_markdown, None),
    "role_runs": (
        role_runs,
        "WITH c AS (SELECT *, CASE WHEN role = lag(role) OVER w THEN 0 ELSE 1 END AS ch FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), r AS (SELECT *, sum(ch) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM c) SELECT conv_id, run::BIGINT AS run, role, min(turn) AS first_turn, count(*) AS turns, sum(length(text))::BIGINT AS chars FROM r GROUP BY 1, 2, 3",
    ),
    "ingest_dedupe": (ingest_dedupe, "SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY 1"),
    "ingest_latest_state": (latest_state, "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1"),
    "ingest_retry_delay": (retry_delays, "SELECT event_id, CASE WHEN event_id % 5 < 3 THEN least(60.0, pow(2.0, event_id % 5))::DOUBLE END AS delay FROM events"),
    "delimiter_sniff": (delimiters, "SELECT c_custkey, ',' AS none, [',', ';', chr(9), '|'][c_custkey % 4 + 1] AS told FROM customer"),
}
