"""First rows that name their columns, and those that don't."""

import pytest
from pyspark.sql import functions as F

from sheafline.operators import headers

N = [["n", "when"], ["1", "2024-01-01"], ["2", "2024-01-02"]]
CASES = [
    (N, 1), ([["1", "2024-01-01"], *N[1:]], 0), ([["n", "N"], *N[1:]], 0), ([["", "when"], *N[1:]], 0), ([["", "when", "n"], ["0", "2024-01-01", "7"], ["1", "2024-01-02", "8"]], 1), ([["n", ""], *N[1:]], 0), ([["n", "w\nx"], *N[1:]], 0), ([["n"], *N[1:]], 0), ([["title", "x", "y"], *N[1:]], 0), ([["only", "row"]], 0),
    ([["name", "town"], ["Ada", "Rome"], ["Bo", "Oslo"]], 1), ([["name", "town"], ["Ada", "Rome"], ["Name ", "Oslo"]], 0), ([["name", "x" * 65], ["Ada", "Rome"]], 0), ([["", ""], ["", ""]], 0),
    ([["v"], *[[str(i)] for i in range(9)], ["N/A"]], 1), ([["v"], *[[str(i)] for i in range(8)], ["N/A"], ["-"]], 1), ([["v", "w"], *[[str(i), "a"] for i in range(60)], ["x", "w"]], 1),
    ([["yes?"], ["yes"], ["No"]], 1), ([["5%"], ["1,000"], ["-2.5e3"]], 0), ([["t"], ["10:30"], ["2024/1/2T10:00:00.5Z"]], 1),
]


def cells(tables):
    return [(t, r, c, 1, 1, text, 0) for t, rows in enumerate(tables) for r, row in enumerate(rows) for c, text in enumerate(row)]


def test_header_rows(spark):
    df = spark.createDataFrame(cells([rows for rows, _ in CASES]), "t long, row int, col int, row_span int, col_span int, text string, told int")
    got = {r["t"]: r["header_rows"] for r in headers.header_rows(df, ["t"]).collect()}
    assert [got[i] for i in range(len(CASES))] == [want for _, want in CASES]


def test_spans_and_declared_rows(spark):
    rows = [(0, 0, 0, 1, 2, "title", 0), (0, 1, 0, 1, 1, "1", 0), (0, 1, 1, 1, 1, "2", 0), (1, 0, 0, 1, 1, "1", 2), (1, 1, 0, 1, 1, "2", 0), (1, 2, 0, 1, 1, "3", 0), (2, 0, 0, 1, 1, "1", 9), (2, 1, 0, 2, 1, None, 0)]
    df = spark.createDataFrame(rows, "t long, row int, col int, row_span int, col_span int, text string, told int")
    assert {r["t"]: r["header_rows"] for r in headers.header_rows(df, ["t"], "told").collect()} == {0: 0, 1: 2, 2: 3}


@pytest.mark.parametrize("text,kind", [("", None), (" ", None), ("1 000,5", "number"), ("12%", "number"), ("inf", "text"), ("1e5", "number"), ("1-2-3", "date"), ("1-2/3", "text"), ("12:30", "date"), ("12:30 pm", "text"), ("2024-01-01 x", "text"), ("TRUE", "bool"), ("12345-1-1", "text"), ("May 2024", "text")])
def test_kinds(spark, text, kind):
    assert spark.range(1).select(headers.cell_kind(F.lit(text))).first()[0] == kind
