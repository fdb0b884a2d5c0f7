"""Grids, counters, commands, chains and dependencies against plain sequential statements."""

import random

import pytest
from pyspark.sql import functions as F

from sheafline.operators import chains, commands, dependencies, documents, grid, numbering
from sheafline.operators.rounds import looked_up, running


def test_running_values_cross_blocks(spark):
    rows = [("a", i, (i * 7) % 11) for i in range(40)] + [("b", i, -i) for i in range(0, 90, 9)]
    df = spark.createDataFrame(rows, "k string, p long, v long")
    got = {(r.k, r.p): (r.s, r.m) for r in running(df, ["k"], "p", 4, sums={"s": F.col("v")}, maxima={"m": F.col("v")}).collect()}
    before = {(r.k, r.p): r.m for r in running(df, ["k"], "p", 4, maxima={"m": F.col("v")}, last=-1).collect()}
    for k, p, _ in rows:
        seen = [v for kk, q, v in rows if kk == k and q <= p]
        assert got[k, p] == (sum(seen), max(seen))
        assert before[k, p] == max(seen[:-1], default=None)


def test_hot_keys_are_looked_up_once_each(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") < 700, 1).when(F.col("id") < 990, F.col("id")).alias("k"))
    facts = spark.createDataFrame([(1, "hot"), (800, "one"), (5, "none")], "k long, f string")
    got = looked_up(rows, facts, "k", "id").collect()
    assert len(got) == 1000 and sum(r.f == "hot" for r in got) == 700 and sum(r.f == "one" for r in got) == 1 and sum(r.f is None for r in got) == 299


# grids


def plain_grid(rows):
    """rows: one list a row of (row_span, col_span, filled), spans already made whole."""
    taken, out = {}, []
    for r, cells in enumerate(rows):
        c = 0
        for i, (tall, wide, filled) in enumerate(cells):
            while (r, c) in taken:
                c += 1
            w = next((d for d in range(1, wide) if (r, c + d) in taken), wide)
            h = next((d for d in range(1, tall) if any((r + d, c + e) in taken for e in range(w))), tall)
            taken.update({(r + a, c + b): 1 for a in range(h) for b in range(w)})
            out.append([r, i, c, h, w, filled])
            c += w
    last = max((o[0] for o in out if o[5]), default=-1)
    return sorted((r, i, c, min(h, last - r + 1), w) for r, i, c, h, w, _ in out if r <= last)


@pytest.mark.parametrize("seed", range(3))
def test_tall_tables_are_placed_in_stretches(spark, seed):
    rng = random.Random(seed)
    tables = {}
    for t in range(3):
        rows = [[(rng.choice([1, 1, 1, 2, 3]) if t else 1, rng.choice([1, 1, 2, 4]), rng.random() < 0.7) for _ in range(rng.randrange(1, 5))] for _ in range(30)]
        if t == 2:
            rows[5][0] = (20, 1, True)  # a span over many blocks
            rows += [[(1, 1, False)], [(2, 1, False)]]  # empty rows at the end go
        tables[t] = rows
    cells = [(t, r, i, tall, wide, 0, filled, "x") for t, rows in tables.items() for r, own in enumerate(rows) for i, (tall, wide, filled) in enumerate(own)]
    df = spark.createDataFrame(cells, "t long, row long, cell long, row_span long, col_span long, last_row long, filled boolean, more string")
    got = grid.placed_cells(df, ["t"], block=4).collect()
    for t, rows in tables.items():
        assert sorted((r.row, r.cell, r.c, r.row_span, r.col_span) for r in got if r.t == t) == plain_grid(rows)


def test_html_grid_spans_groups_and_heads(spark):
    html = (
        "<table><thead><tr><th>a<th colspan=2>b</tr></thead><tbody><tr><td rowspan=0>c<td>d<td>e</tr><tr><td colspan=5>f</tr></tbody>"
        "<tbody><tr><td>g<td rowspan=99 colspan=0>h</tr><tr><td></td></tr><tr><td> </td></tr></tbody></table>"
    )
    got = sorted((r.r, r.c, r.row_span, r.col_span, r.header_row, r.text) for r in documents.html_table_grid(spark.createDataFrame([(1, html)], "page_id long, html string")).collect())
    assert got == [(0, 0, 1, 1, True, "a"), (0, 1, 1, 2, True, "b"), (1, 0, 2, 1, False, "c"), (1, 1, 1, 1, False, "d"), (1, 2, 1, 1, False, "e"), (2, 1, 1, 5, False, "f"), (3, 0, 1, 1, False, "g"), (3, 1, 1, 1, False, "h")]
    assert documents.html_table_grid(spark.createDataFrame([(1, None), (2, "<p>x")], "page_id long, html string")).count() == 0


def test_edges_within_the_tolerance_share_a_column(spark):
    cells = [(1, 1, 0, 100), (1, 1, 1, 200), (1, 2, 0, 105), (1, 2, 1, 111), (1, 2, 2, 300), (1, 3, 0, 300), (1, 4, 0, 90), (1, 4, 1, 50)]
    got = sorted(tuple(r) for r in grid.edge_columns(spark.createDataFrame(cells, "t long, row long, cell long, right long"), ["t"], 10).collect())
    # edges 90 91 | 105 111 | 200 | 300 with 100 in the first cluster (90 to 100)
    assert got == [(1, 1, 0, 0, 1), (1, 1, 1, 1, 2), (1, 2, 0, 0, 2), (1, 2, 1, 2, 1), (1, 2, 2, 3, 1), (1, 3, 0, 0, 4), (1, 4, 0, 0, 1), (1, 4, 1, 1, 1)]


# counters


def plain_numbers(entries, starts, restarts):
    value, begun, pending, out = list(starts), [False] * 9, [False] * 9, []
    for p, level, start in entries:
        k = min(level, 8)
        if start is not None:
            value[k] = start
        elif not begun[k] or pending[k]:
            value[k] = starts[k]
        else:
            value[k] += 1
        begun[k], pending[k] = True, False
        for d in range(k + 1, 9):
            if restarts[d] is None or k < restarts[d]:
                pending[d] = True
        out.append((p, k, value[k], [value[d] if begun[d] and not pending[d] else starts[d] for d in range(9)]))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_counters_of_one_document_over_many_blocks(spark, seed):
    rng = random.Random(seed)
    docs = {d: [(p, min(rng.randrange(11), rng.randrange(11)), rng.choice([None] * 9 + [7])) for p in range(0, 80, d)] for d in (1, 2)}
    starts = {1: [1, 1, 3, 1, 0, 1, 1, 1, 2], 2: [5] + [1] * 8}
    restarts = {1: [None, None, 0, 2, None, 1, 0, None, 3], 2: [None] * 9}
    entries = spark.createDataFrame([(d, *e, "x") for d, own in docs.items() for e in own], "doc long, position long, level int, start int, values string")
    levels = spark.createDataFrame([(d, starts[d], restarts[d]) for d in docs], "doc long, starts array<int>, restarts array<int>")
    got = numbering.level_numbers(entries.drop("values"), levels, ["doc"], block=5).collect()
    for d, own in docs.items():
        assert sorted((r.position, r.level, r.number, list(r["values"])) for r in got if r.doc == d) == plain_numbers(own, starts[d], restarts[d])


def test_labels(spark):
    forms = "bullet decimal lower-alpha upper-alpha lower-roman upper-roman".split()
    row = spark.range(1).select(
        numbering.composite_label(F.lit("%1.%2) %%3 %9% %"), F.array(*(F.lit(n) for n in (3, 28, 4))), F.array(F.lit("decimal"), F.lit("lower-alpha"), F.lit("upper-roman"))).alias("a"),
        numbering.composite_label(F.lit("%1-%2"), F.array(F.lit(2), F.lit(0)), F.array(F.lit("upper-alpha"), F.lit("lower-alpha")), F.lit(True)).alias("b"),
        *(numbering.marker_ordinal(F.lit(k), F.lit(n)).alias(f"{k}{n}") for k in forms for n in (0, 4)),
    ).first()
    assert row[:2] == ("3.ab) %IV % %", "2-0")
    assert row[2:] == ("-", "-", "0", "4", "0", "d", "0", "D", "0", "iv", "0", "IV")


# commands


def test_merges_and_unmerges_in_order(spark, monkeypatch):
    monkeypatch.setattr(commands, "BLOCK", 8)
    rng = random.Random(4)
    old, new, expected, after = [], [], [], []
    for sheet in range(4):
        alive = [(1, 1, 2, 2), (50, 3, 60, 3)]
        old += [(sheet, *r) for r in alive]
        for step in range(120):
            t, l = rng.randrange(1, 70), rng.randrange(1, 12)
            rect = (t, l, t + rng.choice([0, 1, 3]), l + rng.choice([0, 1]))
            kind = rng.choice(["merge", "merge", "unmerge"])
            if kind == "unmerge" and alive:
                rect = rng.choice(alive)
            bad = kind == "merge" and any(a <= rect[2] and rect[0] <= c and b <= rect[3] and rect[1] <= d for a, b, c, d in alive)
            alive = [r for r in alive if r != rect] if kind == "unmerge" else alive if bad else [*alive, rect]
            given = rect if step % 2 else (rect[2], rect[3], rect[0], rect[1])  # either corner first
            new.append((sheet, step, kind, *given))
            expected.append((sheet, step, kind, *rect, "overlap" if bad else None))
        after += [(sheet, *r) for r in alive]
    merges = spark.createDataFrame(old, "sheet long, top long, left long, bottom long, right long")
    steps = spark.createDataFrame(new, "sheet long, step long, kind string, top long, left long, bottom long, right long")
    decided = commands.merge_decisions(merges, steps)
    assert sorted(map(tuple, decided.collect())) == sorted(expected)
    assert sorted(map(tuple, commands.merges_after(merges, decided).collect())) == sorted(after)


# chains


def test_chains_ends_and_cycles(spark):
    nodes = [(i, i - 1 if i % 100 else None, {"a": str(i)} if i % 30 == 0 else {}) for i in range(300)]
    nodes += [(1000, 1002, {"p": "x"}), (1001, 1000, None), (1002, 1001, {"q": None, "r": "y"}), (1003, 1002, {"p": "own"}), (1004, 1004, {}), (1005, 777777, {"a": "z"})]
    nodes += [(2000 + i, 50, {}) for i in range(400)]  # many children of one node
    got = {r.id: r for r in chains.parent_chains(spark.createDataFrame(nodes, "id long, parent long, props map<string,string>")).collect()}
    assert len(got) == len(nodes)
    for i in range(300):
        assert (got[i].root, got[i].depth, got[i].error_code) == (i - i % 100, i % 100, None)
        near = max((j for j in range(i - i % 100, i + 1) if j % 30 == 0), default=None)
        assert got[i].props == ({} if near is None else {"a": str(near)})
    assert got[1003].error_code == "malformed" and got[1003].root is None and got[1003].props == {"p": "own", "r": "y"}
    assert got[1001].props == {"p": "x", "r": "y"} and got[1004].error_code == "malformed"
    assert (got[1005].root, got[1005].depth) == (1005, 0)
    assert {(got[2000 + i].root, got[2000 + i].depth) for i in range(400)} == {(0, 51)}


# dependencies


def test_references_of_a_formula(spark):
    text = """sum( $B$2:A1 , 'it''s'!C3:D4,Other!E5:Other!F6, "A1:B2" , LOG10(G7), 2*H8 ) & XFE1 & A0"""
    words = spark.range(1).select(dependencies.formula_words(F.lit(text)).alias("w"))
    got = [tuple(b) for b in words.select(dependencies.references("w").alias("r")).first().r]
    assert got == [(None, 1, 1, 2, 2), ("it's", 3, 3, 4, 4), ("other", 5, 5, 6, 6), (None, 7, 7, 7, 7), (None, 8, 8, 8, 8), (None, 1, 16385, 1, 16385)]


@pytest.mark.parametrize("first,last", [(1, 1), (2, 2), (1, 1048576), (3, 17), (6, 7), (16, 31), (5, 1000)])
def test_halves_make_up_an_interval(spark, first, last):
    got = spark.range(1).select(dependencies.halves(F.lit(first), F.lit(last), dependencies.ROWS).alias("h")).first().h
    cells = sorted((n << s, (n + 1) << s) for s, n in got)
    assert cells[0][0] == first and cells[-1][1] == last + 1 and all(a[1] == b[0] for a, b in zip(cells, cells[1:], strict=False))
    assert len(cells) <= 2 * dependencies.ROWS


def test_levels_cycles_and_missing_sheets(spark):
    formulas = {
        ("S", 1, 1): None, ("S", 2, 1): "A1+1", ("S", 3, 1): "SUM(A1:A2)", ("S", 4, 1): "SUM($A$1:A3)", ("S", 5, 1): "s!A4*T!A1", ("T", 1, 1): "1+1",
        ("T", 2, 1): "T!B2", ("T", 2, 2): "A2", ("T", 3, 1): "SUM(A1:B2)", ("T", 4, 1): "Gone!A1", ("T", 9, 9): "SUM(A1:Z99)", ("T", 5, 1): "SUM(C1:XFD1048576)",
    }
    cells = spark.createDataFrame([(*k, f) for k, f in formulas.items()], "sheet string, row long, col long, formula string")
    got = {(r.sheet, r.row, r.col): (r.level, r.error_code) for r in dependencies.formula_levels(cells).collect()}
    assert got == {
        ("S", 2, 1): (0, None), ("S", 3, 1): (1, None), ("S", 4, 1): (2, None), ("S", 5, 1): (3, None), ("T", 1, 1): (0, None), ("T", 4, 1): (0, "#REF!"),
        ("T", 2, 1): (None, "#CYCLE!"), ("T", 2, 2): (None, "#CYCLE!"), ("T", 3, 1): (None, "#CYCLE!"), ("T", 9, 9): (None, "#CYCLE!"), ("T", 5, 1): (None, "#CYCLE!"),
    }


def test_tasks_grow_with_the_rows(spark):
    from sheafline.operators import rounds, styles

    assert [rounds.tasks_for(spark, n, 10) for n in (0, 40, 41, 1001)] == [4, 4, 5, 101]
    elements = spark.range(90_000).selectExpr("id % 900 AS page_id", "id AS element", "'p' AS tag", "array('c') AS classes", "CAST(NULL AS string) AS style")
    rules = styles.style_rules(spark.createDataFrame([(p, "p{font-weight:bold}") for p in range(900)], "page_id long, css string"))
    assert styles.cascaded(elements, rules).rdd.getNumPartitions() == 5


def test_pages_are_dealt_by_their_size(spark):
    pages = spark.range(200).selectExpr("id AS page_id", "repeat('<p>word</p>', 10000) AS html")
    assert documents.page_tasks(pages) == 6 and documents.page_tasks(pages.where("false")) == 4


def test_formula_levels_broadcast_nothing(spark, monkeypatch):
    plans = []
    write = type(spark.range(0)).write
    monkeypatch.setattr(type(spark.range(0)), "write", property(lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write.fget(df))[1]))
    cells = spark.createDataFrame([("S", 1, 1, "1"), ("S", 2, 1, "A1"), ("S", 3, 1, "SUM(A1:A2)")], "sheet string, row long, col long, formula string")
    assert sorted(r.level for r in dependencies.formula_levels(cells).collect()) == [0, 1, 2]
    assert plans and not any("BroadcastExchange" in p for p in plans)
