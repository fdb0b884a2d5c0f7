"""Scalar functions on stated cases."""

import pytest
from pyspark.sql import functions as F

from sheafline.functions import formulas as L
from sheafline.functions import markup as M
from sheafline.functions import text as X
from sheafline.operators import structure as R


def values(spark, inputs, expression, kind="string"):
    own = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r[0] for r in own.orderBy("i").select(expression(F.col("v"))).collect()]


def test_formula_moves(spark):
    cases = ["A1+$B1+C$2+$D$4", '"A1"&A1', "ABCD12+LOG10(A1)", "'My sheet'!A1", None]
    assert values(spark, cases, lambda c: L.shifted(c, 2, 3)) == ["D3+$B3+F$2+$D$4", '"A1"&D3', "ABCD12+LOJ12(D3)", "'My sheet'!D3", None]


def test_formula_moves_are_dealt_to_tasks(spark):
    from sheafline.plans import catalog

    assert catalog.ALL["formula_shift"][0](spark, "/root/testdata/sf0.01").rdd.getNumPartitions() > 1


def test_number_formats(spark):
    assert values(spark, [0.125], lambda c: M.number_display(c, 1, percent=True), "double") == ["12.5%"]
    assert values(spark, [-50.0, 1234.5, None], lambda c: M.number_display(c, 2, True, accounting=True), "double") == ["(50.00)", "1,234.50", None]


def test_numbers_with_all_digits(spark):
    large = [1234567890123456.8, -1e15, 2251799813685249.5, 1.2345678901234568e18, 1.2345678901234567e19]
    assert values(spark, large, lambda c: M.number_display(c, 2, True), "double") == ["1,234,567,890,123,456.75", "-1,000,000,000,000,000.00", "2,251,799,813,685,249.50", "1,234,567,890,123,456,768.00", "12,345,678,901,234,567,168.00"]
    assert values(spark, [2251799813685249.5, 2251799813685248.5], lambda c: M.formatted(c, "0"), "double") == ["2251799813685250", "2251799813685248"]


def test_dates_at_the_calendars_end(spark, tmp_path):
    from sheafline.plans import catalog
    from tests.oracle import connect, differences

    spark.createDataFrame([(k, 1, 1.0) for k in (2_918_464, 2_918_465, 2_918_466, 2_918_471)], "c_custkey long, c_nationkey int, c_acctbal double").coalesce(1).write.parquet(f"{tmp_path}/c")
    next(tmp_path.glob("c/*.parquet")).rename(tmp_path / "customer.parquet")
    assert differences(spark, connect(str(tmp_path)), *catalog.ALL["number_patterns"], str(tmp_path)) == ""


def test_formulas_filled_beyond_the_last_row(spark, tmp_path):
    from sheafline.plans import catalog
    from tests.oracle import connect, differences

    spark.createDataFrame([(0, 7), (1_048_578, 8)], "p_partkey long, p_size int").coalesce(1).write.parquet(f"{tmp_path}/p")
    next(tmp_path.glob("p/*.parquet")).rename(tmp_path / "part.parquet")
    query, sql = catalog.ALL["filled_formulas"]
    assert differences(spark, connect(str(tmp_path)), lambda s, d: query(s, d).where("row > 1048570"), f'SELECT * FROM ({sql}) WHERE "row" > 1048570', str(tmp_path)) == ""


def test_markers(spark):
    assert values(spark, [1, 4, 9, 1994, 3999, 0, 4000], X.roman_marker, "int") == ["i", "iv", "ix", "mcmxciv", "mmmcmxcix", "0", "4000"]
    assert values(spark, [1, 26, 27, 702, 703], X.alpha_marker, "int") == ["a", "z", "aa", "zz", "aaa"]


def test_text(spark):
    assert values(spark, ["a\r\nb", "x​y z", "t\tu\u0007"], X.clean_text) == ["a b", "xy z", "t\tu"]
    assert values(spark, [" Hello, Wörld_1! ", "!!"], X.heading_slug) == ["hello-wörld_1", "section"]
    assert values(spark, ["A  b--c!", "?"], X.anchor_id) == ["a-b-c", "anchor"]
    assert values(spark, ["a", "``", "`````x"], X.backtick_fence) == ["```", "```", "``````"]
    assert values(spark, ["report.DOCM", "x.csv?y=1", "noext", "a.b.pdf#p"], X.format_of) == ["docx", "csv", None, "pdf"]


def test_links(spark):
    assert values(spark, ["mailto:x", "C:\\y", "#z", "a/b:c", "ab+c:d"], M.target_kind) == ["external", "relative", "anchor", "relative", "external"]
    assert values(spark, ["a+b%20c", "%zz", "100%"], M.decoded_component) == ["a+b c", "%zz", "100%"]
    assert values(spark, ["YQ==", "YQ", "YR==", "!"], M.canonical_base64) == [b"a", None, None, None]


def test_durations(spark):
    assert values(spark, ["PT26H", "P14D", "-PT1H5M", "P1M", "PT26H30M15.5S", "P"], M.duration_clock) == ["26:00:00", "336:00:00", "-01:05:00", "P1M", "26:30:15", "P"]
    assert values(spark, [0.5, 1.25, -0.25], X.clock_of_days, "double") == ["12:00:00", "30:00:00", "-6:00:00"]


@pytest.mark.parametrize("serial,day", [(1.0, "1900-01-01"), (59.0, "1900-02-28"), (61.0, "1900-03-01"), (45000.5, "2023-03-15"), (-1.0, None)])
def test_serial_dates(spark, serial, day):
    got = values(spark, [serial], X.serial_to_date, "double")[0]
    assert (None if got is None else str(got)) == day


def test_overlaps(spark):
    rows = [("s", 1, 1, 1, 100, 2), ("s", 2, 100, 2, 300, 3), ("s", 3, 301, 1, 301, 9), ("t", 4, 1, 1, 9, 9)]
    got = R.overlapping_merges(spark.createDataFrame(rows, "sheet string, merge_id int, top int, left int, bottom int, right int"), 8)
    assert [tuple(r) for r in got.collect()] == [("s", 1, 2)]


def test_unique_anchors(spark):
    rows = [(1, 0, "x"), (1, 1, "x-1"), (1, 2, "x"), (1, 3, "x"), (2, 0, "x"), (2, 1, "x"), (3, 5, "y-2"), (3, 6, "y"), (3, 7, "y"), (3, 8, "y")]
    got = sorted(tuple(r) for r in R.claimed_slugs(spark.createDataFrame(rows, "doc_id int, position int, slug string")).collect())
    assert [a for _, _, a in got] == ["x", "x-1", "x-2", "x-3", "x", "x-1", "y-2", "y", "y-1", "y-3"]


def test_format_strings(spark):
    for pattern, value, want in (
        ("#,##0.00", -1234.5, "-1,234.50"), ("0.0%;(0.0%)", -0.125, "(12.5%)"), ('0" items"', 3.0, "3 items"), ("0;-0;zero", 0.0, "zero"), ('0;-0;"none"', 0.0, "none"), ('"EUR" 0', 5.0, "EUR 5"), ('0" up";0" down"', -2.0, "2 down"), ("0.0%", 0.125, "12.5%"), ("#,##0.00;(#,##0.00)", -50.0, "(50.00)"), ("000", 7.0, "007"), ("yyyy-mm-dd hh:mm", 45000.53125, "2023-03-15 12:45"), ("h:mm am/pm", 45000.75, "6:00 PM"), ("mm:ss", 45000.0 + 61 / 86400, "01:01"), ("m/d/yy h:mm", 45000.5, "3/15/23 12:00"), ('d "of" mmmm', 45000.99999999, "16 of March"), ("yyyy", -5.0, "-5"), ("[Blue]0_)", 7.0, "7"), ("General", 1e21, "1e+21"), ("d-mmm-yy", 45000.0, "15-Mar-23"), ("yyyy-mm-dd", 61.0, "1900-03-01"),
    ):
        assert values(spark, [value], lambda c, p=pattern: M.formatted(c, p), "double") == [want], pattern


def test_escapes(spark):
    cases = {
        "snake_case and 2*3": "snake_case and 2*3", "*a* _b_ ~c~ `d`": r"\*a* \_b_ \~c~ \`d`", "a * b * c": "a * b * c", "_x y_z_": r"\_x y_z_", "1. x": r"1\. x", "12) y": r"12\) y", "1.5": "1.5", "# y": r"\# y", "#tag": "#tag",
        "&amp; & z &#1": "&amp;amp; & z &amp;#1", "# \n- k": "\\# \n\\- k", "x\n---\n  ===\n-a": "x\n\\---\n  \\===\n-a", "[a] b]": r"\[a] b]", "[a": "[a", "a<b <c < d </e": r"a\<b \<c < d \</e", "back\\slash": r"back\\slash", "> q\n  + r": "\\> q\n  \\+ r", "*": r"\*", "a|b": "a|b", "": "",
    }
    assert values(spark, list(cases), M.escaped_text) == list(cases.values())
    assert values(spark, ["a|b*", "# x", "[y]!"], lambda c: M.escaped_text(c, line_start=False, label=True, cell=True, open_end=True)) == [r"a\|b\*", "# x", r"\[y\]\!"]
    assert values(spark, ["http://x/_a_[1]\n"], M.url_as_text) == [r"http://x/\_a\_\[1\] "]
    assert values(spark, ["a", "`b", "c``d"], M.code_span) == ["`a`", "`` `b ``", "```c``d```"]
    assert values(spark, ["a%20b%zz%C3%A9", "%FFx", "a%C3%A9%FFb", "%E2%82", ""], M.decoded_component) == ["a b%zzé", "\ufffdx", "aé\ufffdb", "\ufffd", ""]
