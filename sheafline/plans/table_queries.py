"""Filter, cohort, aggregate, profile, pivot and sheet queries over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafline.operators import sheet as S
from sheafline.operators import table as T
from sheafline.operators.table import Cohort, Metric, Predicate

P = Predicate
#: Below any used row: ranges whose bottom edge is open.
BOTTOM = 1 << 40


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def equals_project(s, d):
    return T.query(load(s, d, "orders"), ["o_orderkey", "o_custkey", "o_totalprice"], [P("o_orderstatus", "equals", "f")])


def not_equals_blank_total(s, d):
    own = load(s, d, "customer").withColumn("segment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return T.query(own, ["c_custkey", "segment"], [P("segment", "not-equals", "MACHINERY")])


def contains(s, d):
    return T.query(load(s, d, "part"), ["p_partkey", "p_name"], [P("p_name", "contains", "D G")])


def starts_with(s, d):
    return T.query(load(s, d, "part"), ["p_partkey", "p_type"], [P("p_type", "starts-with", "s")])


def ends_with(s, d):
    return T.query(load(s, d, "part"), ["p_partkey", "p_brand"], [P("p_brand", "ends-with", "3")])


def numeric_range(s, d):
    return T.query(load(s, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_quantity"], [P("l_quantity", "greater-than-or-equal", 10), P("l_quantity", "less-than", 12), P("l_discount", "less-than-or-equal", 0.05)])


def less_than_keeps_blank(s, d):
    own = load(s, d, "events").withColumn("v", F.when(F.col("value") >= 5, F.col("value")))
    return T.query(own, ["event_id"], [P("v", "less-than", 7)])


def natural_order(s, d):
    return T.query(load(s, d, "customer"), ["c_custkey", "c_name"], [P("c_name", "less-than", "customer#99"), P("c_name", "greater-than", "CUSTOMER#9")])


def number_as_text(s, d):
    return T.query(load(s, d, "part"), ["p_partkey", "p_size"], [P("p_size", "starts-with", "4")])


def offset_limit(s, d):
    return T.query(load(s, d, "orders"), ["o_orderkey", "o_totalprice"], [P("o_orderstatus", "equals", "O")], order="o_orderkey", offset=5, limit=10)


def match_count(s, d):
    """How many rows match, and whether a bounded page of them is cut off."""
    full = T.match_summary(load(s, d, "lineitem"), [P("l_quantity", "greater-than", 45)], "l_orderkey", [EXISTS], offset=20)
    few = T.match_summary(load(s, d, "orders"), [P("o_totalprice", "less-than", -1)])
    return full.withColumn("page", F.lit("lineitem")).unionByName(few.withColumn("page", F.lit("orders")))


def is_blank(s, d):
    own = load(s, d, "events").withColumn("kind", F.when(F.col("event_type") == "click", "").when(F.col("event_type") != "error", F.col("event_type")))
    return T.query(own, ["event_id", "user_id"], [P("kind", "is-blank")])


def by_letter(s, d):
    return T.query(load(s, d, "supplier"), ["A", "d"], [P("C", "equals", 3)])


METRICS = [
    Metric("count", name="n"), Metric("count", "l_shipmode_", "n_filled"), Metric("count-distinct", "l_suppkey", "n_suppliers"), Metric("sum", "l_quantity", "sum_qty"),
    Metric("average", "l_discount", "avg_disc"), Metric("minimum", "l_extendedprice", "min_price"), Metric("maximum", "l_extendedprice", "max_price"),
]


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 4) for n in names})


def group_metrics(s, d):
    own = load(s, d, "lineitem").withColumn("l_shipmode_", F.when(F.col("l_linenumber") != 3, F.col("l_linestatus")))
    return rounded(T.aggregate(own, METRICS, ["l_returnflag", "l_linestatus"]), "sum_qty", "avg_disc")


def global_empty(s, d):
    return T.aggregate(load(s, d, "orders"), [Metric("count", name="n"), Metric("sum", "o_totalprice", "total")], predicates=[P("o_orderstatus", "equals", "missing")])


def sum_zero_not_null(s, d):
    own = load(s, d, "events").withColumn("v", F.when(F.col("event_type") != "click", F.col("value")))
    return rounded(T.aggregate(own, [Metric("sum", "v", "total"), Metric("average", "v", "mean"), Metric("minimum", "v", "low")], ["event_type"]), "total", "mean")


def first_seen_groups(s, d):
    return T.aggregate(load(s, d, "orders"), [Metric("count", name="n")], ["o_custkey"], order="o_orderkey", bounded=True)


EXISTS = Cohort("exists", [P("l_returnflag", "equals", "R")])
MISSING = Cohort("not-exists", [P("l_quantity", "greater-than", 45)])


def cohort_exists(s, d):
    return T.query(load(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], [P("l_linenumber", "equals", 1)], "l_orderkey", [EXISTS])


def cohort_not_exists(s, d):
    return T.query(load(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], (), "l_orderkey", [MISSING])


def cohort_mixed(s, d):
    both = [Cohort("exists", [P("event_type", "equals", "purchase"), P("value", "greater-than", 10)]), Cohort("not-exists", [P("event_type", "equals", "error"), P("value", "greater-than", 150)])]
    return T.query(load(s, d, "events"), ["event_id", "user_id"], (), "user_id", both)


def cohort_blank_keys(s, d):
    own = load(s, d, "orders").withColumn("clerk", F.when(F.col("o_custkey") % 3 == 0, "").when(F.col("o_custkey") % 3 == 1, F.col("o_custkey").cast("string")))
    return T.query(own, ["o_orderkey"], (), "clerk", [Cohort("not-exists", [P("o_orderstatus", "equals", "P")])])


def cohort_then_aggregate(s, d):
    own = load(s, d, "lineitem")
    return rounded(T.aggregate(own, [Metric("count-distinct", "l_orderkey", "orders"), Metric("sum", "l_extendedprice", "price")], ["l_linestatus"], [P("l_returnflag", "not-equals", "A")], "l_orderkey", [EXISTS, MISSING]), "price")


def profile_customer(s, d):
    own = load(s, d, "customer").withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    out = T.profile(own, "c_custkey", ["c_mktsegment", "c_nationkey", "c_acctbal"])
    return out.select("name", "type", "row_count", "blank_count", "non_blank_count", "distinct_count", F.round("minimum", 2).alias("minimum"), F.round("maximum", 2).alias("maximum"))


def profile_samples(s, d):
    return T.profile(load(s, d, "orders"), "o_orderkey", ["o_orderstatus", "o_orderpriority"]).select("name", "samples")


def pivot_orders(s, d):
    own = load(s, d, "orders").withColumn("price", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")))
    values = [Metric("count", "price", "n"), Metric("sum", "price", "total"), Metric("minimum", "price", "low"), Metric("average", "price", "mean")]
    return rounded(T.pivot_summary(own, ["o_orderstatus", "o_orderpriority"], values), "total", "mean")


def part_cells(s, d) -> DataFrame:
    return S.to_cells(load(s, d, "part"), F.col("p_partkey") + 1, ["p_name", "p_brand", "p_size", "p_retailprice"])


def selection_statistics(s, d):
    out = S.statistics(part_cells(s, d), [(1, 1, BOTTOM, 3), (10, 3, BOTTOM, 4)])
    return out.select("count", "numeric_count", F.round("sum", 2).alias("sum"), F.round("average", 4).alias("average"), "minimum", "maximum")


def statistics_without_numbers(s, d):
    return S.statistics(part_cells(s, d), [(1, 1, BOTTOM, 2)]).select("count", "numeric_count", "sum")


def search_cells(s, d):
    return S.search(part_cells(s, d), " Brand#1 ").select("row", "col", "preview", "address")


def duplicate_values(s, d):
    own = S.to_cells(load(s, d, "supplier"), F.col("s_suppkey") + 1, ["s_nationkey", "s_name"])
    return S.repeated_values(own, (1, 1, BOTTOM, 2)).select("row", "col", "n")


def unique_values(s, d):
    own = S.to_cells(load(s, d, "supplier"), F.col("s_suppkey") + 1, ["s_nationkey", "s_name"])
    return S.repeated_values(own, (1, 1, BOTTOM, 2), unique=True).select("row", "col")


def rule_cell_is(s, d):
    return S.cell_is(part_cells(s, d), (1, 3, BOTTOM, 4), "greater-than-or-equal", 45).select("row", "col", "num")


def range_functions(s, d):
    out = S.range_functions(part_cells(s, d), [(1, 3, BOTTOM, 3), (5, 4, BOTTOM, 4), (1, 1, BOTTOM, 2)])
    return out.select("area", F.round("sum", 2).alias("sum"), "count", "minimum", "maximum")


def column_widths(s, d):
    return S.axis_size(part_cells(s, d)).select("col", "width")


def copied_lines(s, d):
    return S.copied_lines(part_cells(s, d), (2, 1, BOTTOM, 3)).select("row", "line")


def write_range(s, d):
    out = S.fill_range(part_cells(s, d), "C1:C10", 7.0)
    return S.statistics(out, [(1, 3, BOTTOM, 3)]).select("count", F.round("sum", 2).alias("sum"))


def chart_series(s, d):
    """Orders and value by month: a chart's categories and two series."""
    own = load(s, d, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    return rounded(T.aggregate(own, [Metric("count", name="orders"), Metric("sum", "o_totalprice", "value")], ["month"]), "value")


PART_CELLS = """cells AS (SELECT p_partkey + 1 AS "row", 1 AS col, NULL::DOUBLE AS num, p_name AS str, p_name AS display FROM part
 UNION ALL SELECT p_partkey + 1, 2, NULL, p_brand, p_brand FROM part
 UNION ALL SELECT p_partkey + 1, 3, p_size::DOUBLE, NULL, p_size::VARCHAR FROM part
 UNION ALL SELECT p_partkey + 1, 4, p_retailprice, NULL, regexp_replace(p_retailprice::VARCHAR, '\\.0$', '') FROM part)"""
SUPPLIER_CELLS = """cells AS (SELECT s_suppkey + 1 AS "row", 1 AS col, s_nationkey::VARCHAR AS v, 'n' AS k FROM supplier UNION ALL SELECT s_suppkey + 1, 2, s_name, 's' FROM supplier)"""
NATURAL = "array_to_string(list_transform(regexp_extract_all(lower({0}), '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]+$') THEN lpad(ltrim(x, '0'), 20, '0') ELSE x END), '')"

QUERIES = {
    "query_equals_project": (equals_project, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE lower(o_orderstatus) = 'f'"),
    "query_not_equals_blank_total": (not_equals_blank_total, "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer WHERE nullif(c_mktsegment, 'BUILDING') IS DISTINCT FROM 'MACHINERY'"),
    "query_contains": (contains, "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'd g')"),
    "query_starts_with": (starts_with, "SELECT p_partkey, p_type FROM part WHERE starts_with(lower(p_type), 's')"),
    "query_ends_with": (ends_with, "SELECT p_partkey, p_brand FROM part WHERE ends_with(lower(p_brand), '3')"),
    "query_numeric_range": (numeric_range, "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 12 AND l_discount <= 0.05"),
    "query_less_than_keeps_blank": (less_than_keeps_blank, "SELECT event_id FROM events WHERE NOT (value >= 7)"),
    "query_natural_order": (natural_order, f"SELECT c_custkey, c_name FROM customer WHERE {NATURAL.format('c_name')} < {NATURAL.format(chr(39) + 'customer#99' + chr(39))} AND {NATURAL.format('c_name')} > {NATURAL.format(chr(39) + 'customer#9' + chr(39))}"),
    "query_number_as_text": (number_as_text, "SELECT p_partkey, p_size FROM part WHERE starts_with(p_size::VARCHAR, '4')"),
    "query_offset_limit": (offset_limit, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 10 OFFSET 5"),
    "query_match_count": (
        match_count,
        "WITH m AS (SELECT 'lineitem' AS page, count(*) AS matched, 20 AS skip FROM lineitem WHERE l_quantity > 45 AND l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') UNION ALL SELECT 'orders', count(*), 0 FROM orders WHERE o_totalprice < -1 OR o_totalprice IS NULL) SELECT page, matched, least(50, greatest(0, matched - skip)) AS returned, skip + least(50, greatest(0, matched - skip)) < matched AS truncated FROM m",
    ),
    "query_is_blank": (is_blank, "SELECT event_id, user_id FROM events WHERE event_type IN ('click', 'error')"),
    "query_by_letter": (by_letter, "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_nationkey = 3"),
    "agg_group_metrics": (
        group_metrics,
        "SELECT l_returnflag, l_linestatus, count(*) AS n, count(CASE WHEN l_linenumber <> 3 THEN 1 END) AS n_filled, count(DISTINCT l_suppkey) AS n_suppliers, round(sum(l_quantity), 4) AS sum_qty, round(avg(l_discount), 4) AS avg_disc, min(l_extendedprice) AS min_price, max(l_extendedprice) AS max_price FROM lineitem GROUP BY ALL",
    ),
    "agg_global_empty": (global_empty, "SELECT count(*) AS n, coalesce(sum(o_totalprice), 0.0) AS total FROM orders WHERE o_orderstatus = 'missing' HAVING count(*) > 0"),
    "agg_sum_zero_not_null": (
        sum_zero_not_null,
        "SELECT event_type, round(coalesce(sum(CASE WHEN event_type <> 'click' THEN value END), 0), 4) AS total, round(avg(CASE WHEN event_type <> 'click' THEN value END), 4) AS mean, min(CASE WHEN event_type <> 'click' THEN value END) AS low FROM events GROUP BY 1",
    ),
    "agg_first_seen_groups": (first_seen_groups, "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY min(o_orderkey) LIMIT 500"),
    "cohort_exists": (cohort_exists, "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber = 1 AND l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"),
    "cohort_not_exists": (cohort_not_exists, "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)"),
    "cohort_mixed": (
        cohort_mixed,
        "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 10) AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 150)",
    ),
    "cohort_blank_keys": (cohort_blank_keys, "SELECT o_orderkey FROM orders WHERE o_custkey % 3 = 1 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"),
    "cohort_then_aggregate": (
        cohort_then_aggregate,
        "SELECT l_linestatus, count(DISTINCT l_orderkey) AS orders, round(sum(l_extendedprice), 4) AS price FROM lineitem WHERE l_returnflag <> 'A' AND l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) GROUP BY 1",
    ),
    "profile_table": (
        profile_customer,
        "WITH c AS (SELECT nullif(c_mktsegment, 'BUILDING') AS m, c_nationkey AS n, c_acctbal AS a FROM customer) "
        "SELECT 'c_mktsegment' AS name, 'string' AS type, count(*) AS row_count, count(*) - count(m) AS blank_count, count(m) AS non_blank_count, count(DISTINCT m) AS distinct_count, NULL::DOUBLE AS minimum, NULL::DOUBLE AS maximum FROM c "
        "UNION ALL SELECT 'c_nationkey', 'number', count(*), count(*) - count(n), count(n), count(DISTINCT n), min(n), max(n) FROM c "
        "UNION ALL SELECT 'c_acctbal', 'number', count(*), count(*) - count(a), count(a), count(DISTINCT a), round(min(a), 2), round(max(a), 2) FROM c",
    ),
    "profile_samples": (
        profile_samples,
        "WITH f AS (SELECT 'o_orderstatus' AS name, o_orderstatus AS v, min(o_orderkey) AS o FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, min(o_orderkey) FROM orders GROUP BY 2), "
        "r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY o, v) AS k FROM f) SELECT name, string_agg(v, '|' ORDER BY o, v) AS samples FROM r WHERE k <= 5 GROUP BY 1",
    ),
    "pivot_summary": (
        pivot_orders,
        "WITH o AS (SELECT *, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price FROM orders) SELECT o_orderstatus, o_orderpriority, count(price) AS n, round(coalesce(sum(price), 0), 4) AS total, coalesce(min(price), 0) AS low, round(coalesce(avg(price), 0), 4) AS mean FROM o GROUP BY 1, 2",
    ),
    "selection_statistics": (
        selection_statistics,
        f'WITH {PART_CELLS} SELECT count(*) AS count, count(num) AS numeric_count, round(sum(num), 2) AS sum, round(avg(num), 4) AS average, min(num) AS minimum, max(num) AS maximum FROM cells WHERE col BETWEEN 1 AND 3 OR ("row" >= 10 AND col BETWEEN 3 AND 4)',
    ),
    "selection_without_numbers": (statistics_without_numbers, f'WITH {PART_CELLS} SELECT count(*) AS count, count(num) AS numeric_count, sum(num) AS sum FROM cells WHERE col <= 2'),
    "search_cells": (search_cells, f"WITH {PART_CELLS} SELECT \"row\", col, display AS preview, chr(64 + col) || \"row\" AS address FROM cells WHERE contains(lower(display), 'brand#1')"),
    "cf_duplicate_values": (duplicate_values, f'WITH {SUPPLIER_CELLS}, n AS (SELECT *, count(*) OVER (PARTITION BY v, k) AS n FROM cells) SELECT "row", col, n FROM n WHERE n > 1'),
    "cf_unique_values": (unique_values, f'WITH {SUPPLIER_CELLS}, n AS (SELECT *, count(*) OVER (PARTITION BY v, k) AS n FROM cells) SELECT "row", col FROM n WHERE n = 1'),
    "cf_cell_is": (rule_cell_is, f'WITH {PART_CELLS} SELECT "row", col, num FROM cells WHERE col >= 3 AND num >= 45'),
    "formula_range_functions": (
        range_functions,
        f'WITH {PART_CELLS}, a(area, t, l, b, r) AS (VALUES (0, 1, 3, 1099511627776, 3), (1, 5, 4, 1099511627776, 4), (2, 1, 1, 1099511627776, 2)) SELECT area, round(coalesce(sum(num), 0), 2) AS sum, count(num) AS count, coalesce(min(num), 0) AS minimum, coalesce(max(num), 0) AS maximum FROM a LEFT JOIN cells ON "row" BETWEEN t AND b AND col BETWEEN l AND r GROUP BY 1',
    ),
    "column_widths": (column_widths, f"WITH {PART_CELLS} SELECT col, least(60, greatest(8, max(length(display)) + 2)) AS width FROM cells GROUP BY 1"),
    "copied_lines": (copied_lines, "SELECT p_partkey + 1 AS \"row\", p_name || chr(9) || p_brand || chr(9) || p_size AS line FROM part WHERE p_partkey + 1 >= 2"),
    "fill_range_statistics": (write_range, "SELECT 10 + count(*) AS count, round(70 + sum(p_size), 2) AS sum FROM part WHERE p_partkey + 1 NOT BETWEEN 1 AND 10"),
    "chart_series": (chart_series, "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS orders, round(sum(o_totalprice), 4) AS value FROM orders GROUP BY 1"),
}
