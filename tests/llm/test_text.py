"""Tokenizers, packing, rules, pages and classifiers: brute force, round trips, held-out accuracy."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sheafline.llm import bpe, html_extract, packing, quality_classifier, quality_rules, toxicity
from sheafline.llm.queries import vocabulary

BYTE, WORD = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")
SAMPLES = ["", " \n\t", "don't  STOP\n\n é ß İ Σας ΣΑΣ", "a<|endoftext|>b<|startoftext|>", "\x1cx\x1dy", "12ab3 ++ __ 漢字 \U0001f600́é", "x" * 3000, "the " * 2500, "\x00\x7f�", ":\U0003d000a \U0003d000\u0378", "\ua7cb\u1c89 \U00010d40x"]


@pytest.fixture(scope="module")
def byte_library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTE)


@pytest.fixture(scope="module")
def word_library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_byte_bpe_equals_the_library(text):
    from tokenizers import Tokenizer

    library = test_byte_bpe_equals_the_library.__dict__.setdefault("library", Tokenizer.from_file(BYTE))
    ids = library.encode(text, add_special_tokens=False).ids
    own = bpe.load(BYTE)
    assert own.encode(text) == ids
    assert own.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_word_bpe_equals_the_library(text):
    own = packing.load(WORD)
    assert own.encode(text) == own.library(text)


def test_bpe_query(spark, byte_library):
    rows = [(i, t, "x") for i, t in enumerate([*SAMPLES, None, SAMPLES[2]])]
    got = {r["doc_id"]: r for r in bpe.encode_decode(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), BYTE).collect()}
    for i, t, _ in rows:
        ids = byte_library.encode(t or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(byte_library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    docs = spark.createDataFrame(rows, "doc_id long, text string, x string")
    back = bpe.decode(bpe.encode(docs, BYTE), BYTE).collect()
    assert {r["doc_id"]: r["text"] for r in back} == {i: t or "" for i, t, _ in rows}


def test_packing(spark, word_library):
    rng = random.Random(2)
    rows = [(i, t, "x") for i, t in enumerate([*SAMPLES, None, *(" ".join(rng.choices(["alpha", "beta", "on"], k=rng.choice([1, 5, 90, 700, 1500]))) for _ in range(120))])]
    rows.append(rows[3])
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, length string"), WORD).collect()
    pieces, places = {}, {}
    for i, t, _ in rows:
        ids = [*word_library.encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            pieces.setdefault((i, k), []).append((at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert len(got) == sum(map(len, pieces.values()))
    for r in got:
        assert (r["start"], r["length"], r["ids_crc32"]) in pieces[r["doc_id"], r["piece"]]
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    total = 0
    for parts in places.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
        total += end
    bins: list[int] = []  # first fit, longest first
    for n in sorted((n for x in pieces.values() for _, n, _ in x), reverse=True):
        k = next((k for k, used in enumerate(bins) if used + n <= 2048), None)
        if k is None:
            bins.append(n)
        else:
            bins[k] += n
    assert len(places) <= len(bins) and total == sum(bins)
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), WORD).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 6), max_size=12))
def test_plan_places_every_piece(counts):
    ranks, bins = {}, {}
    for length, lo, hi, base, offset in packing.plan(counts, 40):
        for k in range(lo, hi):
            assert (length, k) not in ranks
            ranks[length, k] = True
            bins.setdefault(base + k - lo, []).append((offset, length))
    assert {k for k, _ in ranks} == set(counts) and len(ranks) == sum(counts.values())
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 40
        assert sum(length > 40 // 3 for _, length in parts) <= 2


def plain_measures(text):
    words = (text or "").encode().split()
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    marked = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    return (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(marked))


@settings(max_examples=200, deadline=None)
@given(st.text("aab \n\x0b#é|\x1c", max_size=60))
def test_measures(text):
    assert quality_rules.measures(text) == plain_measures(text)


def test_binomial_bound():
    from math import comb

    for k, n, delta in ((0, 10, 0.05), (3, 40, 0.01), (7, 8, 0.2)):
        p = quality_rules.upper_bound(k, n, delta)
        assert abs(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) - delta) < 1e-6
    assert quality_rules.upper_bound(5, 5, 0.1) == 1.0


def test_cutoffs_are_certified():
    grid = [4.0, 3.0, 2.0, 1.0]
    assert quality_rules.choose(2000, [0, 0, 1, 400], [0, 5, 5, 90], grid, 0.01, 0.01)[0] == 3.0
    assert quality_rules.choose(2000, [0, 0, 0, 0], [0, 0, 0, 0], grid, 0.01, 0.01) is None
    assert quality_rules.choose(0, [0] * 4, [9] * 4, grid, 0.01, 0.01) is None


def test_the_rules_of_a_stratum_share_its_risk():
    rules = quality_rules.RULES
    zeros = lambda grid: [0] * len(grid)
    over = {name: (zeros(grid), [k + 1 for k, _ in enumerate(grid)]) for name, _, _, grid in rules}
    bound = quality_rules.upper_bound(0, 5000, 1e-4)
    chosen = quality_rules.choose_all(5000, over, 1e-4, 2.5 * bound)
    assert sum(c is not None for c in chosen.values()) == 2  # the third would go over the risk
    assert quality_rules.choose_all(0, over, 1e-4, 0.02) == {name: None for name, *_ in rules}


def test_repeated_documents_are_one_trial(spark):
    bad = [(i, " ".join(f"w{k}####" for k in range(60)), "en") for i in range(40)]
    good = [(1000, " ".join(f"word{k}" for k in range(60)), "en")] * 700
    docs = spark.createDataFrame(bad + good, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 0) for i in range(40)] + [(1000, 1)], "doc_id long, quality int")
    assert quality_rules.judge(docs, labels).where("kept").count() == 740  # one good document certifies nothing


def test_rules_query(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(i, f"{good} {i}", "en", "x") for i in range(600)] + [(1000 + i, " ".join(f"w{k}#### $$$$" for k in range(60 + i)), "en", None) for i in range(40)]
    rows += [(2000, None, None, "x"), (2001, "few words", "", "x"), (2002, good, "zz", "x"), (2002, good, "zz", "x"), (None, good, None, None)]
    labels = [(i, 1, 0) for i in range(600)] + [(1000 + i, 0, 0) for i in range(40)] + [(0, None, 0), (None, 1, 0), (5, 1, 0), (5, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string")
    got = quality_rules.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = plain_measures(next(t for i, t, *_ in rows if i == r["doc_id"]))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        bad = r["doc_id"] is not None and 1000 <= r["doc_id"] < 2000
        assert r["kept"] == (not r["base_failed"] and not bad)
    empty = quality_rules.judge(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int"))
    assert empty.count() == 0
    assert quality_rules.judge(docs, spark.createDataFrame([], "doc_id long, quality int")).where("kept").count() == 600 + 40 + 3


PAGES = [
    ("<html><head><title>no</title><style>x</style></head><body><nav><a href=/>Menu</a></nav><div class='site-header'>Top</div><article><h1>Big &amp; <i>small</i></h1>"
     "<p>one\n two&nbsp;three<br>four<p>five</article><div id=comments>Rude</div><footer>&copy; x</footer></body>", "Big & small\none two three four\nfive"),
    ("", ""), (None, ""), ("<nav>only</nav>", ""), ("<p>plain text of a page", "plain text of a page"),
    ("<main><section><h2>A</h2><p>b<form>name <input></form><aside>side</aside><ul><li>c<li>d</ul></section></main><script>if (a<b) x('</p>')</script>", "A\nb\nc\nd"),
    ("<div class=ad>buy<article><p>real words here</p></article>", "real words here"),
    ("<body>&lt;p&gt; 5 &amp;amp; 6</body>", "<p> 5 &amp; 6"),
]


def test_html(spark):
    rows = [(i, f"u{i}", h, 0) for i, (h, _) in enumerate(PAGES)]
    got = {r["page_id"]: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")).collect()}
    for i, (_, want) in enumerate(PAGES):
        assert got[i]["text"] == want, i
        assert got[i]["n_chars"] == len(want) and got[i]["url"] == f"u{i}"


def made_page(rng, declared):
    """A page, and its lines as (text, tags, region, may be content), from known parts."""
    tags = declared and "article" or "div"
    html, lines, pending, region = "<body>", [], 1, 0

    def part(opening, closing, items, may):
        nonlocal html, pending, region
        region += 1
        html += opening
        pending += 1
        for i, (before, text, after) in enumerate(items):
            html += before + text + after
            lines.append((text, pending + before.count("<") + after.count("<"), region, may))
            pending = 0
        html += closing
        pending += 1

    words = lambda n: " ".join(rng.choice(["stone", "river", "of", "garden"]) for _ in range(n))
    for i in range(rng.randrange(1, 6)):
        kind = "text" if declared and not i else rng.choice(["menu", "text", "nav"])
        if kind == "text":
            part(f"<{tags}>", f"</{tags}>", [("<p>", words(rng.choice([2, 9, 60])), "</p>") for _ in range(rng.randrange(1, 6))], True)
        elif kind == "menu":
            part("<div>", "</div>", [("<li><a><b>", words(1), "</b></a></li>") for _ in range(rng.randrange(1, 6))], not declared)
        else:
            part("<nav>", "</nav>", [("<p>", words(rng.choice([1, 40])), "</p>") for _ in range(rng.randrange(1, 4))], False)
    return html + "</body>", lines


def plain_extraction(lines, sigma):
    """The dealt method, stated step by step."""
    import math

    values = [math.log(1 + len(t) / n) if may else 0.0 for t, n, _, may in lines]
    if sigma:
        reach = round(3 * sigma)
        smooth = []
        for i in range(len(values)):
            near = [(math.exp(-((j - i) ** 2) / (2 * sigma**2)), values[j]) for j in range(max(0, i - reach), min(len(values), i + reach + 1))]
            smooth.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
        values = smooth
    low, high = min(values), max(values)
    for _ in range(20):
        middle = (low + high) / 2
        a, b = [v for v in values if v < middle], [v for v in values if v >= middle]
        if not a or not b:
            break
        low, high = sum(a) / len(a), sum(b) / len(b)
    cut = (low + high) / 2 if low < high else low
    kept = set()
    totals = {}
    for (t, _, r, may), v in zip(lines, values):
        if may:
            total = totals.setdefault(r, [0, 0])
            total[0] += len(t)
            total[1] += len(t) * (v >= cut - 1e-12)
    kept = {r for r, (n, over) in totals.items() if 2 * over >= n} or ({max(totals, key=lambda r: (totals[r][1], totals[r][0], -r))} if totals else set())
    return "\n".join(t for t, _, r, may in lines if may and r in kept)


@pytest.mark.parametrize("declared", [False, True])
def test_regions_are_selected_by_clustering(declared):
    rng = random.Random(3)
    pages = [made_page(rng, declared) for _ in range(400)]
    same = everything = unsmoothed = 0
    for html, lines in pages:
        want = plain_extraction(lines, html_extract.SIGMA)
        same += html_extract.main_text(html) == want
        everything += "\n".join(t for t, _, _, may in lines if may) != want
        unsmoothed += html_extract.main_text(html, 0) != want
        assert html_extract.main_text(html, 0) == plain_extraction(lines, 0)
    assert same == len(pages)
    assert everything > 40 and unsmoothed > 10  # clustering and smoothing decide, also on pages that declare content


def test_given_pages_need_the_clustering():
    import duckdb

    pages = [r[0] for r in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()]
    bare = [h.replace("<article>", "<div>").replace("</article>", "</div>") for h in pages]
    found = [html_extract.main_text(h) for h in pages]
    # without the declared element the regions are told by their ratios alone
    assert sum(html_extract.main_text(h) == t for h, t in zip(bare, found, strict=True)) >= 0.97 * len(pages)


def test_names_inside_an_article_do_not_cut_it():
    body = "<p>" + "word " * 40 + "</p>"
    inner = '<header class="entry-header"><h1 class="section-header">T</h1></header><div id="search-results"><p>a</p></div><p class="share-price">b</p><p class="related-work">c</p><p>d <span class="ad">x</span> e</p>'
    out = '<div class="notice">n</div><div class="comment-list"><p>r</p></div><section id="comments"><article><p>s</p></article></section><aside><article>t</article></aside>'
    html = f'<nav><ul><li>m<div class="comments"><article><p>u</p></article></div></ul><article>{inner}{body}{out}</article><aside><article><p>v</p></article></aside>'
    assert html_extract.main_text(html).split("\n") == ["T", "a", "b", "c", "d e", ("word " * 40).strip()]


def test_deep_and_long_pages_take_linear_time():
    import time

    began = time.perf_counter()
    for html in ("<b>" * 60_000 + "</i>" * 60_000, "<div>" * 100_000 + "x" + "</div>" * 100_000, "<article>" + "<p>a<i>" * 60_000 + "</b>" * 60_000, "word " * 400_000):
        html_extract.main_text(html)
    assert time.perf_counter() - began < 20
    assert html_extract.main_text("word " * 400_000) == ("word " * 400_000).strip()


def test_html_tables(spark):
    schema = "page_id long, url string, html string, text int, n_chars string, lines int"
    rows = [(1, "u", "<article>a</article>", 1, "x", 2), (1, "u", "<article>a</article>", 1, "x", 2), (None, None, None, None, None, None), (2, None, "", 0, "", 0)]
    got = html_extract.extract(spark.createDataFrame(rows, schema).repartition(3))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, "u", "a", 1)] * 2 + [(None, None, "", 0), (2, None, "", 0)]))
    assert html_extract.extract(spark.createDataFrame([], schema)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class=ad>", "</div>", "<article>", "</article>", "<h1>", "text ", "&lt;", "<br>", "<!--", "-->", "<script>", "</script>", "<", ">", "\x00"]), max_size=20))
def test_broken_html_never_fails(parts):
    assert isinstance(html_extract.main_text("".join(parts)), str)


def held_out_docs():
    rng = random.Random(4)
    clean = ["morning", "river", "stone", "garden", "window", "paper", "music", "letter", "bread", "silver"]
    bad = ["grumbleface", "nitwit", "blockhead"]
    rows, labels = [], []
    for i in range(700):
        w = rng.choices(clean, k=rng.choice([8, 30, 90]))
        toxic, good = i % 4 == 0, i % 3 != 0
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(bad)
        text = " ".join(w)
        if not good:
            text = "\n".join(" ".join(x + "###" for x in w[k : k + 9]) for k in range(0, len(w), 9))
        rows.append((i, text, 0.5, 1))
        labels.append((i, int(good), int(toxic)))
    return [*rows, (9000, None, 0.1, 2), (9001, "", 0.1, 2), (9002, "a nitwits remark by a grumblefaces friend today", 0.1, 2), (9003, rows[0][1], 0.1, 2)], labels


def test_classifiers(spark):
    rows, labels = held_out_docs()
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, predicted int").repartition(3)
    marks = spark.createDataFrame([*labels, (3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for module, column, (m, held), cutoff in ((toxicity, 2, (4, 2), 0.3), (quality_classifier, 1, (3, 1), 0.5)):
        got = {r["doc_id"]: r for r in module.score(docs, marks).collect()}
        assert len(got) == len(rows)
        tested = [x for x in labels if got[x[0]]["held_out"]]
        assert {x[0] for x in tested} == {x[0] for x in labels if zlib.crc32(str(x[0]).encode()) % m == held}
        assert np.mean([got[x[0]]["predicted"] == x[column] for x in tested]) > 0.97
        for r in got.values():
            assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cutoff)
        assert got[9003]["score"] == got[0]["score"]
        if module is toxicity:
            assert got[9002]["predicted"] == 1 and got[9000]["predicted"] == got[9001]["predicted"] == 0
    assert toxicity.clean(docs, marks).columns == docs.columns
    assert quality_classifier.good(docs, marks).columns == docs.columns
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, none).count() == len(rows) and quality_classifier.score(docs.limit(0), marks).count() == 0


def test_forward_backward_equals_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    emit, trans = rng.normal(size=(1, 4, 2)), rng.normal(size=(2, 2))
    weights = {y: np.exp(sum(emit[0, i, k] for i, k in enumerate(y)) + sum(trans[a, b] for a, b in zip(y, y[1:], strict=False))) for y in itertools.product((0, 1), repeat=4)}
    total = sum(weights.values())
    log_z, marginals, pairs = quality_classifier.forward_backward(emit, trans, np.ones((1, 4), bool))
    assert np.isclose(np.exp(log_z[0]), total)
    for i in range(4):
        assert np.isclose(marginals[0, i, 1], sum(w for y, w in weights.items() if y[i]) / total)
    assert np.isclose(pairs[0, 1, 0], sum(w * sum(a == 1 and b == 0 for a, b in zip(y, y[1:], strict=False)) for y, w in weights.items()) / total)


def test_pipeline(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = {r[0] for r in got.select("doc_id").distinct().collect()}
    assert 0.5 * docs.count() < len(kept) < docs.count()
    ends = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(r["n"] == r["end"] <= 2048 for r in ends)
