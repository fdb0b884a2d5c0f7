"""Style cascades, notes in notes, portable values and due jobs on small cases."""

import random

from pyspark.sql import functions as F

from sheafline.operators import portable, structure, styles


def cascade(spark, css, *elements):
    sheets = spark.createDataFrame([(1, css)], "page_id long, css string")
    rows = spark.createDataFrame([(1, i, *e) for i, e in enumerate(elements)], "page_id long, element long, tag string, classes array<string>, style string")
    got = {r["element"]: {k: v for k, v in r.asDict().items() if k in styles.PROPERTIES and v is not None} for r in styles.cascaded(rows, styles.style_rules(sheets)).collect()}
    return [got.get(i, {}) for i in range(len(elements))]


def test_specificity_order_and_importance(spark):
    css = "p{font-weight:bold} .a{font-weight:400} p.a{font-weight:600;font-weight:599} /* p{display:none} */ em , .b{font-style:oblique}\n.c{font-style:normal!important} .d{text-decoration-line: none} .e>p{display:none} p.a.b{display:none}"
    got = cascade(spark, css, ("P", [], None), ("p", ["a"], None), ("p", ["a", "a", "b"], "font-weight: BOLDER"), ("em", ["c"], "font-style: italic"), ("em", ["c"], "font-style: italic ! IMPORTANT;"), ("i", ["d"], None), ("i", None, None), ("i", ["z"], "nothing"))
    assert got == [{"bold": True}, {"bold": False}, {"bold": True, "italic": True}, {"italic": False}, {"italic": True}, {"strike": False}, {}, {}]
    assert cascade(spark, None, ("p", ["a"], "display:none")) == [{"hidden": True}] and cascade(spark, "p{display:none /* open", ("p", [], None)) == [{"hidden": True}]
    assert cascade(spark, "p{display:none} /* open } b{display:none}", ("b", [], None), ("p", [], None)) == [{}, {"hidden": True}]


def reading_order(notes, refs):
    """Numbers by visiting references in order, notes inside notes at once."""
    first = {}
    for note, _, text in sorted(notes, key=lambda n: n[1]):
        if (text or "").strip():
            first.setdefault(note, text)
    order = []

    def visit(inside):
        for _, note in sorted((p, n) for i, p, n in refs if i == inside):
            if note in first and note not in order:
                order.append(note)
                visit(note)

    visit(None)
    order += [n for n, *_ in sorted(notes, key=lambda n: n[1]) if n in first and n not in order]
    return {n: i for i, n in enumerate(dict.fromkeys(order), 1)}


def test_notes_are_numbered_as_they_are_read(spark):
    rng = random.Random(11)
    notes, refs, expected = [], [], {}
    for doc in range(30):
        n = rng.randrange(1, 9)
        own = [(f"n{rng.randrange(n)}", p, rng.choice(["x", "y\n\nz", " \n", None, "w"])) for p in range(n)]
        links = [(rng.choice([None, *(f"n{k}" for k in range(n))]), p, f"n{rng.randrange(n + 1)}") for p in range(rng.randrange(14))]
        notes += [(doc, *r) for r in own]
        refs += [(doc, *r) for r in links]
        expected |= {(doc, k): v for k, v in reading_order(own, links).items()}
    got = structure.nested_notes(spark.createDataFrame(notes, "doc_id long, note_id string, position long, text string"), spark.createDataFrame(refs, "doc_id long, inside string, position long, note_id string"))
    assert {(r.doc_id, r.note_id): r.number for r in got.collect()} == expected


def test_definitions_indent_their_lines(spark):
    assert spark.range(1).select(structure.footnote_lines(F.lit(3), F.lit(" a\n\nb\r\n c \n"))).first()[0] == "[^3]: a\n\n    b\n     c"


def test_budgets_of_portable_values(spark):
    texts = {
        1: '{"a":1,"b":[true,false,null,"é"]}', 2: '{"$binary":"binary/base64","data":"QUI="}', 3: '{"$binary":"x"}', 4: "nope", 5: None, 6: "null", 7: "[[[[1]]]]", 8: "[]", 9: '"xyz"', 10: '[{"$binary":"binary/base64","data":"QUJ="}]', 11: '{"x":{"$binary":5}}',
        12: '{"$binary":"binary/base64","data":"QUI=","more":1}',
    }
    df = spark.createDataFrame(list(texts.items()), "id long, json string")
    got = {r.id: tuple(r)[1:6] if r.error_code is None else r.error_code for r in portable.measured_values(df, portable.Limits(max_depth=3)).collect()}
    bad, large = portable.INVALID, portable.TOO_LARGE
    assert got == {1: (7, 2, 37, 4, 0), 2: (1, 0, 36, 0, 2), 3: bad, 4: bad, 5: bad, 6: (1, 0, 4, 0, 0), 7: large, 8: (1, 0, 2, 0, 0), 9: (1, 0, 3, 3, 0), 10: bad, 11: bad, 12: bad}
    for limits, over in ((portable.Limits(max_bytes=36), {1, 7}), (portable.Limits(max_text_bytes=3), {1}), (portable.Limits(max_binary_bytes=1), {2}), (portable.Limits(max_entries=5), {1})):
        assert {r.id for r in portable.measured_values(df.where("id in (1, 2, 6, 8, 9)"), limits).where("error_code is not null").collect()} == over - {7}


def test_due_jobs_leave_no_attempt_over(spark):
    rows = [(1, "queued", 4, 4, 0.0, 0.0), (2, "retry", 4, 4, 1.0, 0.0), (3, "running", 4, 4, 0.0, 5.0), (4, "running", 3, 4, 0.0, 5.0), (5, "running", 3, 4, 0.0, 50.0), (6, "queued", 0, 4, 0.0, 0.0), (7, "retry", 1, 4, 11.0, 0.0)]
    jobs = spark.createDataFrame(rows, "job_id long, state string, attempt int, max_attempts int, due_at double, lease_until double")
    assert sorted(map(tuple, structure.due_jobs(jobs, F.lit(10.0)).collect())) == [(3, "failed", 4, "lease-lost"), (4, "running", 4, None), (6, "running", 1, None)]
