"""Table semantics on small tables: totality, cohorts, headers, first-seen order."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from sheafline.functions import coordinates as C
from sheafline.functions import values as V
from sheafline.operators import sheet as S
from sheafline.operators import table as T
from sheafline.operators.table import Cohort, Metric, Predicate

CASES = [
    ("A", "Enterprise", "Rental", 100.0), ("A", "Taxi Co", "Taxi", 25.0), ("B", "Enterprise", "Rental", 120.0), ("B", "Enterprise", "Pickup", 10.0),
    ("C", "Taxi Co", "Taxi", 30.0), ("D", "Enterprise", "Rental", 90.0), ("D", "Other Taxi", "Taxi", 20.0),
]


@pytest.fixture(scope="module")
def cases(spark):
    rows = [(i, *r) for i, r in enumerate(CASES)]
    return spark.createDataFrame(rows, "o int, `Case` string, Provider string, Mission string, Amount double")


@pytest.fixture(scope="module")
def sales(spark):
    rows = [(0, "France", 100.0, "A"), (1, "France", 150.0, "B"), (2, "Germany", 80.0, "C"), (3, "France", 25.0, "A")]
    return spark.createDataFrame(rows, "o int, Country string, Revenue double, Customer string")


def test_query_and_aggregate(sales):
    got = T.query(sales, ["Customer", "revenue"], [Predicate("Country", "equals", "france")], order="o", limit=50)
    assert [tuple(r) for r in got.collect()] == [("A", 100.0), ("B", 150.0), ("A", 25.0)]
    agg = T.aggregate(sales, [Metric("sum", "Revenue"), Metric("count-distinct", "Customer")], ["Country"], order="o")
    assert agg.columns == ["Country", "sum Revenue", "count-distinct Customer"]
    assert [tuple(r) for r in agg.collect()] == [("France", 275.0, 2), ("Germany", 80.0, 1)]


F1 = Cohort("exists", [Predicate("Provider", "equals", "Enterprise")])
F2 = Cohort("exists", [Predicate("Mission", "equals", "Taxi"), Predicate("Provider", "not-equals", "Enterprise")])
F3 = Cohort("not-exists", [Predicate("Mission", "equals", "Taxi")])


def test_cohorts(cases):
    taxi = [Predicate("Mission", "equals", "Taxi")]
    got = T.query(cases, ["Case", "Provider", "Amount"], taxi, "Case", [F1, F2])
    assert sorted(map(tuple, got.collect())) == [("A", "Taxi Co", 25.0), ("D", "Other Taxi", 20.0)]
    agg = T.aggregate(cases, [Metric("count-distinct", "Case", "cases"), Metric("sum", "Amount", "sum")], ["Provider"], taxi, "Case", [F1, F2], order="o")
    assert [tuple(r) for r in agg.collect()] == [("Taxi Co", 1, 25.0), ("Other Taxi", 1, 20.0)]
    assert sorted(map(tuple, T.query(cases, ["Case", "Provider"], (), "Case", [F1, F3]).collect())) == [("B", "Enterprise")] * 2


def test_large_counts(spark):
    own = spark.range(5000).select(F.col("id").alias("o"), F.element_at(F.array(*map(F.lit, ("France", "Germany", "Spain"))), (F.col("id") % 3 + 1).cast("int")).alias("Country"))
    assert T.matched(own, [Predicate("Country", "equals", "France")]).count() == 1667


def test_total_comparison(spark):
    rows = [("a", None, None), ("b", "", 1.0), ("c", "É", 100.0), ("d", "file2", -0.5), ("e", "file10", 7.0), ("f", "100", None)]
    own = spark.createDataFrame(rows, "k string, s string, n double")
    keys = lambda *p: "".join(r["k"] for r in T.query(own, ["k"], [Predicate(*p)], order="k", limit=200).collect())
    assert keys("s", "equals", "e") == "c"
    assert keys("s", "equals", None) == "ab" and keys("s", "is-blank") == "ab"
    assert keys("s", "equals", 100) == "f"
    assert keys("s", "not-equals", "x") == "abcdef"
    assert keys("s", "less-than", "file10") == "abcdf"
    assert keys("n", "less-than", 1) == "adf" and keys("n", "not-equals", 1) == "acdef" and keys("n", "greater-than", -1) == "bcde"
    assert keys("n", "starts-with", "10") == "c" and keys("n", "contains", "0.5") == "d"


def test_empty_aggregates(sales):
    none = [Predicate("Country", "equals", "Spain")]
    assert T.aggregate(sales, [Metric("count")], (), none).count() == 0
    own = sales.withColumn("Revenue", F.lit(None).cast("double"))
    row = T.aggregate(own, [Metric("sum", "Revenue", "s"), Metric("average", "Revenue", "a"), Metric("minimum", "Revenue", "m")]).first()
    assert tuple(row) == (0.0, None, None)
    assert T.pivot_summary(own, ["Country"], [Metric("average", "Revenue", "a")], "o").first()["a"] == 0.0
    stats = S.statistics(S.to_cells(own, F.col("o") + 1, ["Country", "Revenue"]), ["A1:B4", "A1:A2"]).first()
    assert (stats["count"], stats["numeric_count"], stats["sum"]) == (4, 0, None)


def test_profile(sales):
    row = {r["name"]: r for r in T.profile(sales, "o").collect()}["Revenue"]
    assert (row["row_count"], row["minimum"], row["maximum"], row["non_blank_count"], row["type"]) == (4, 25.0, 150.0, 4, "number")
    assert {r["name"]: r["samples"] for r in T.profile(sales, "o").collect()}["Country"] == "France|Germany"


def test_headers():
    assert T.header_names(["x", "X", None, "x (2)"]) == ["x", "X (2)", "Column C", "x (2)"]
    assert T.pivot_names(["x", "X", None, " "]) == ["x", "X 2", "Column 3", "Column"]
    with pytest.raises(ValueError):
        T.header_names(["a"] * 257)


def test_unknown_names(sales):
    with pytest.raises(ValueError):
        T.query(sales, ["missing"])
    with pytest.raises(ValueError):
        Predicate("a", "like")


@given(st.integers(1, C.MAX_COLUMNS), st.integers(1, C.MAX_ROWS))
def test_addresses(column, row):
    assert C.parse_cell(f"${C.letters(column)}${row}") == (row, column)


def test_number_text(spark):
    cases = [(1.0, "1"), (0.0, "0"), (-0.0, "0"), (0.125, "0.125"), (1e-6, "0.000001"), (1e-7, "1e-7"), (1e21, "1e+21"), (123456789.25, "123456789.25"), (-2.5, "-2.5"), (1e20, "100000000000000000000")]
    own = spark.createDataFrame([(v, t) for v, t in cases], "v double, t string")
    assert [(r["v"], r["got"]) for r in own.withColumn("got", V.text(F.col("v"), TY.DoubleType())).collect()] == cases


def test_areas(spark):
    own = S.to_cells(spark.createDataFrame([(1, 10.0), (2, 20.0)], "r int, v double"), F.col("r"), ["v"])
    got = {r["area"]: (r["sum"], r["count"], r["average"]) for r in S.range_functions(own, ["A1:A2", "B1:B2"]).collect()}
    assert got == {0: (30.0, 2, "15.0"), 1: (0.0, 0, "#DIV/0!")}
    assert [r["line"] for r in S.copied_lines(own, "A1:B2").orderBy("row").collect()] == ["10\t", "20\t"]
    assert S.search(own, "2").select("address").first()[0] == "A2"


def test_predicates_reach_the_scan(spark):
    pushed = lambda name, *p: T.query(spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet"), (), [Predicate(*p)])._jdf.queryExecution().toString().rsplit("PushedFilters: [", 1)[1].split("]")[0]
    assert "GreaterThanOrEqual(l_quantity,10.0)" in pushed("lineitem", "l_quantity", "greater-than-or-equal", 10)
    assert "Or(LessThan(l_quantity,12.0),IsNull(l_quantity))" in pushed("lineitem", "l_quantity", "less-than", 12)
    assert "IsNotNull(o_orderstatus)" in pushed("orders", "o_orderstatus", "equals", "f")
    assert "IsNotNull(p_name)" in pushed("part", "p_name", "contains", "ring")


def test_long_digit_runs_are_told_apart(spark):
    rows = [(0, "a1234567890123456789012"), (1, "a1234567890123456789099"), (2, "a9"), (3, "a0009"), (4, "a10b"), (5, None)]
    own = spark.createDataFrame(rows, "k int, s string")
    keys = lambda *p: {r["k"] for r in T.query(own, ["k"], [Predicate("s", *p)]).collect()}
    assert keys("equals", "A1234567890123456789012") == {0} and keys("greater-than", "a1234567890123456789012") == {1}
    assert keys("equals", "a9") == {2, 3} and keys("less-than", "a10b") == {2, 3, 5} and keys("less-than", "b") == {0, 1, 2, 3, 4, 5}
    assert keys("not-equals", "b") == {0, 1, 2, 3, 4, 5} and keys("greater-than", "a") == {0, 1, 2, 3, 4}


def test_blank_rows_in_cohorts(spark):
    own = spark.createDataFrame([("a", None), ("b", 5.0), ("c", None), ("c", 7.0)], "k string, v double")
    over = [Predicate("v", "greater-than", 1)]
    assert {r["k"] for r in T.query(own, ["k"], (), "k", [Cohort("not-exists", over)]).collect()} == {"a"}
    assert {r["k"] for r in T.query(own, ["k"], (), "k", [Cohort("exists", over)]).collect()} == {"b", "c"}


def test_match_summary_and_argument_limits(spark, sales):
    got = lambda **o: tuple(T.match_summary(sales, [Predicate("Country", "equals", "France")], **o).first())
    assert got() == (3, 3, False) and got(limit=2) == (3, 2, True) and got(offset=2, limit=2) == (3, 1, False) and got(offset=9) == (3, 0, False)
    with pytest.raises(ValueError, match="predicates"):
        T.query(sales, (), [Predicate("Country", "is-blank")] * 21, order="o", bounded=True)
    with pytest.raises(ValueError, match="metrics"):
        T.aggregate(sales, [Metric("count")] * 9, bounded=True)
