"""Changed sheets, lists, job states and envelopes on small cases."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafline.functions import values as V
from sheafline.operators import documents as D
from sheafline.operators import lists as I
from sheafline.operators import sheet as S
from sheafline.operators import workbook as W
from sheafline.operators.table import Metric
from sheafline.sources.files import delimiter_score
from sheafline.streaming import jobs as J

SHEETS = "workbook long, sheet long, name string, position long, hidden boolean"


def names(sheets):
    return [r["name"] for r in sheets.orderBy("position").collect()]


def test_sheets_are_created_moved_and_deleted(spark):
    sheets = spark.createDataFrame([(1, 1, "a", 0, False), (1, 2, "b", 1, True)], SHEETS)
    made = W.sheets_created(sheets, spark.createDataFrame([(1, "c", 1), (2, "d", 9)], "workbook long, name string, position int"))
    assert names(made.where("workbook = 1")) == ["a", "c", "b"] and names(made.where("workbook = 2")) == ["d"]
    moved = W.sheets_moved(made, spark.createDataFrame([(1, 1, 99)], "workbook long, sheet long, position int"))
    assert names(moved.where("workbook = 1")) == ["c", "b", "a"]
    gone = spark.createDataFrame([(1, 2), (2, 1)], "workbook long, sheet long")
    left = W.sheets_deleted(moved, gone)
    assert names(left.where("workbook = 1")) == ["c", "a"] and names(left.where("workbook = 2")) == ["d"]


def test_a_workbook_shows_a_sheet(spark):
    sheets = spark.createDataFrame([(1, 1, "a", 0, False), (1, 2, "b", 1, True), (2, 1, "a", 0, False), (2, 2, "b", 1, False)], SHEETS)
    marks = spark.createDataFrame([(1, 1, True), (2, 1, True)], "workbook long, sheet long, hidden boolean")
    assert {(r["workbook"], r["sheet"]): r["hidden"] for r in W.sheets_shown(sheets, marks).collect()} == {(1, 1): False, (1, 2): True, (2, 1): True, (2, 2): False}


def test_formats_keep_values_and_make_blank_cells(spark):
    cells = spark.createDataFrame([("s", 1, 1, "x", {"bold": "yes"}), ("s", 9, 9, "y", None)], "sheet string, row long, col long, str string, style map<string,string>")
    commands = spark.createDataFrame([("s", 1, 1, 2, 1, 1, {"fill": "red"}), ("s", 2, 1, 1, 1, 1, {"fill": "blue"})], "sheet string, step int, top long, left long, bottom long, right long, style map<string,string>")
    got = {(r["row"], r["col"]): (r["str"], r["style"]) for r in W.formatted_ranges(cells, commands).collect()}
    assert got == {(1, 1): ("x", {"bold": "yes", "fill": "blue"}), (1, 2): (None, {"fill": "red"}), (9, 9): ("y", None)}


def test_nested_lists(spark):
    rows = [(0, 0, 1), (1, 1, 1), (2, 1, 2), (3, 0, 2), (4, 1, 3), (5, 0, 5), (6, 2, 1), (7, 1, 1)]
    entries = spark.createDataFrame([(1, p, lv, 0, True, n) for p, lv, n in rows], "doc_id long, position long, level int, key int, ordered boolean, number long")
    got = {r["position"]: (r["list_start"], r["item"], r["start"]) for r in I.list_islands(entries).collect()}
    assert got == {0: (0, 1, 1), 1: (1, 1, 1), 2: (1, 2, 1), 3: (0, 2, 1), 4: (4, 1, 3), 5: (5, 1, 5), 6: (6, 1, 1), 7: (7, 1, 1)}


def test_cancelling_twice_changes_nothing(spark):
    jobs = spark.createDataFrame([(1, "queued"), (2, "succeeded"), (3, "running")], "job_id long, state string")
    once = J.cancelled(jobs, jobs.where("job_id < 3"))
    assert {r["job_id"]: r["state"] for r in once.collect()} == {1: "cancelled", 2: "succeeded", 3: "running"}
    assert sorted(J.cancelled(once, jobs.where("job_id < 3")).collect()) == sorted(once.collect())


def test_retries_stay_within_the_jitter_and_end(spark):
    rows = spark.range(1, 6).select(F.col("id").alias("a"), J.jittered_delay(F.col("id"), F.lit(0.0)).alias("low"), J.jittered_delay(F.col("id"), F.lit(1.0)).alias("high")).orderBy("a").collect()
    assert [tuple(r)[1:] for r in rows] == [(800, 1200), (1600, 2400), (3200, 4800), (None, None), (None, None)]


def test_envelopes_out_of_bounds_are_none(spark):
    lines = ["", None, "no marker", "ingestion-failure:%ZZ", "ingestion-failure:%7B%7D", "ingestion-failure:not%20json"]
    df = spark.createDataFrame([(x,) for x in lines], "t string")
    assert [r[0] for r in df.select(J.decoded_failure(F.col("t"))).collect()] == [None] * len(lines)


def test_digits_and_containment(spark):
    cases = {0.1 + 0.2: "0.3", 1e-7 * 4: "0.0000004", 0.0: "0", -2.5: "-2.5", 123456789012345678.0: "123456789012346000", 1 / 3: "0.333333333333333"}
    df = spark.createDataFrame([(x,) for x in cases], "x double")
    assert [r[0] for r in df.select(V.float_text(F.col("x"))).collect()] == list(cases.values())
    assert spark.range(1).select(V.joined_text((F.lit("a"), T.StringType()), (F.lit(None).cast("double"), T.DoubleType()), (F.lit(2.0), T.DoubleType()))).first()[0] == "a2"
    pairs = spark.createDataFrame([("a b", "x"), (None, None), ("a b c d", "z A b c"), ("a b c", None)], "e string, a string")
    assert [r[0] for r in pairs.select(D.text_containment(F.col("e"), F.col("a"))).collect()] == [1.0, 1.0, 0.5, 0.0]


def test_validations_refuse_values_with_commas(spark):
    schema = "sheet string, step int, id string, top long, left long, bottom long, right long"
    rules = spark.createDataFrame([("s", 0, "own", 1, 1, 1, 1)], schema)
    new = [("s", 1, None, 2, 2, 1, 1, ["a", "b"]), ("s", 2, None, 1, 1, 1, 1, ["a,b"]), ("s", 3, None, 1, 1, 1, 1, ['"']), ("s", 4, "mine", 1, 1, 1, 1, None), ("s", 5, None, 1, 1, 1, 1, ["x" * 255]), ("s", 6, None, 1, 1, 1, 1, ["x" * 256]), ("t", 7, None, 1, 1, 1, 1, [])]
    got = {r["step"]: (r["id"], r["error_code"], r["top"]) for r in W.validations_added(rules, spark.createDataFrame(new, schema + ", listed array<string>")).collect()}
    bad = (None, "invalid-values", 1)
    assert got == {0: ("own", None, 1), 1: ("validation-2", None, 1), 2: bad, 3: bad, 4: ("mine", None, 1), 5: ("validation-4", None, 1), 6: bad, 7: ("validation-1", None, 1)}


def test_tables_are_named_once(spark):
    cells = spark.createDataFrame([(1, 1, 1, 2, "a"), (1, 1, 1, 3, ""), (1, 1, 2, 4, "z")], "workbook int, sheet int, row long, col long, display string")
    old = spark.createDataFrame([(1, "Old")], "workbook int, name string")
    new = [(1, 1, 1, "old", 1, 1, 2, 2), (1, 1, 2, "New", 3, 4, 1, 2), (1, 2, 3, "NEW", 1, 1, 2, 2), (2, 1, 4, "new", 1, 1, 2, 1), (1, 1, 5, "a b", 1, 1, 2, 2), (1, 1, 6, "flat", 1, 1, 1, 9), (1, 1, 7, "flat", 1, 1, 2, 1), (1, 1, 8, None, 1, 1, 2, 1)]
    got = {r["step"]: r["error_code"] or r["columns"] for r in W.tables_created(old, cells, spark.createDataFrame(new, "workbook int, sheet int, step int, name string, top long, left long, bottom long, right long")).collect()}
    assert got == {1: "name-taken", 2: ["a", "Column2", "Column3"], 3: "name-taken", 4: ["Column1"], 5: "invalid-name", 6: "no-rows", 7: ["Column1"], 8: "invalid-name"}


def test_pivots_and_formulas_are_written_over_cells(spark):
    cells = S.to_cells(spark.createDataFrame([("x", "y")], "a string, b string"), F.lit(2), ["a", "b"])
    sales = spark.createDataFrame([(1, "France", 100.0), (2, "Germany", 80.0), (3, "France", 25.0)], "i long, country string, revenue double")
    out = S.pivot_written(cells, sales, ["country"], [Metric("sum", "revenue", "total")], "i", "B2:C9")
    assert {(r["row"], r["col"]): r["str"] if r["num"] is None else r["num"] for r in out.collect()} == {(2, 1): "x", (2, 2): "country", (2, 3): "total", (3, 2): "France", (3, 3): 125.0, (4, 2): "Germany", (4, 3): 80.0}
    with pytest.raises(ValueError):
        S.pivot_written(cells, sales, ["country"], [Metric("sum", "revenue", "total")], "i", "B2:C9", source_at=("sheet1", "C9:D20"))
    filled = S.fill_formula(cells, "B2:C3", "=A1+$B1+C$2+$D$4")
    assert {(r["row"], r["col"]): r["formula"] for r in filled.collect() if r["col"] > 1} == {(2, 2): "A1+$B1+C$2+$D$4", (2, 3): "B1+$B1+D$2+$D$4", (3, 2): "A2+$B2+C$2+$D$4", (3, 3): "B2+$B2+D$2+$D$4"}
    assert {r["formula"] for r in S.fill_formula(cells, "B2:C3", "=A1", translate=False).where("col > 1").collect()} == {"A1"}


def test_runs_are_joined_over_blanks(spark):
    def joined(*runs):
        df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(runs)], "paragraph long, position long, kind string, style string, text string")
        return [tuple(r)[2:] for r in I.merged_runs(df).orderBy("position").collect()]

    assert joined(("text", "b", "a"), ("text", "i", " "), ("text", "", "\t"), ("text", "b", "c"), ("text", "b", ""), ("text", "b", "d")) == [("text", "b", "a \tcd")]
    assert joined(("text", "b", "a"), ("text", "", " "), ("text", "b", "c"), ("text", "", " "), ("text", "b", "e"), ("text", "", " x")) == [("text", "b", "a c e"), ("text", "", " x")]
    assert joined(("text", "code", "a"), ("text", None, " "), ("text", "code", "c")) == [("text", "code", "a"), ("text", "", " "), ("text", "code", "c")]
    assert joined(("text", "b", "a"), ("link", "", "l"), ("text", "b", "c"), ("text", "i", None)) == [("text", "b", "a"), ("link", "", "l"), ("text", "b", "c")]


def test_delimiter_scores(spark):
    cases = {'a,b\n"x,y\n,",c\n': (2, 0), "a;b;c\nd;e;f\n1;2\n,": (1, 4), "": (0, 0), None: (0, 0), "x,y\n" * 30: (20, 0), "a,b,c\nd,e\n": (2, 0), '"open,\n,': (0, 0), '"a""b,"",c': (0, 0)}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert [tuple(r) for r in df.select(delimiter_score(F.col("t"), ","), delimiter_score(F.col("t"), ";")).collect()] == list(cases.values())


def test_sheets_of_queries_grow_with_their_tables(spark, tmp_path):
    from sheafline.plans import catalog
    from tests.oracle import connect, differences

    spark.createDataFrame([(k, k * 7 % 50 + 1) for k in range(900)], "p_partkey long, p_size int").coalesce(1).write.parquet(f"{tmp_path}/p")
    next(tmp_path.glob("p/*.parquet")).rename(tmp_path / "part.parquet")
    for name in ("merge_overlaps", "object_collisions", "rule_ids"):
        query, sql = catalog.ALL[name]
        assert differences(spark, connect(str(tmp_path)), query, sql, str(tmp_path)) == ""
        assert {r.sheet for r in query(spark, str(tmp_path)).select("sheet").distinct().collect()} <= {0, 1, 2}


def test_rules_are_numbered_across_blocks(spark):
    new = spark.createDataFrame([(s, k, None) for s in (1, 2) for k in range(0, 40, 3)], "sheet long, step long, id string").selectExpr("*", "1L AS top", "1L AS left", "1L AS bottom", "1L AS right")
    rules = new.where("false").unionByName(new.where("sheet = 2 AND step = 0").selectExpr("sheet", "-1L AS step", "'x' AS id", "top", "left", "bottom", "right"))
    got = {(r.sheet, r.step): r.id for r in W.rules_added(rules, new, "cf", block=5).collect()}
    assert got == {(s, 3 * i): f"cf-{i + s}" for s in (1, 2) for i in range(14)} | {(2, -1): "x"}
