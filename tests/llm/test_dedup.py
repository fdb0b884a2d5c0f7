"""The dedup operators against brute force, and their edge cases."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sheafline.llm import embedding_dedup, ngram_join, rlz_dedup, suffix_dedup, windows
from sheafline.llm.components import components
from sheafline.llm.hashing import Anchors, text_bytes, word_spans
from tests.llm import brute

SCHEMA = "doc_id long, text string, grp string, c0 int, n long"


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "x", i, i) for i, (d, t) in enumerate(docs)], SCHEMA)


def corpus(seed=3, n=120):
    rng = random.Random(seed)
    vocabulary = ["ab", "cde", "é", "fgh", "ij", "klmno", "p", "qrs", "tuv", "WX", "yz"]
    passage = " ".join(rng.choices(vocabulary, k=60))
    line = " ".join(rng.choices(vocabulary, k=20))
    docs = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.25 and docs:
            w = (docs[rng.randrange(len(docs))][1] or "").split(" ")
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            text = " ".join(w)
        else:
            w = rng.choices(vocabulary, k=rng.choice([0, 1, 4, 5, 12, 13, 40, 150]))
            text = " ".join(w)
        if rng.random() < 0.3:
            at = rng.randrange(len(text) + 1)
            text = text[:at] + " " + passage + "\n" + text[at:]
        if rng.random() < 0.4:
            text += "\t" + line
        docs.append((1000 - 3 * i if i % 2 else i, text))
    seen = {d for d, _ in docs}
    return [*docs, (max(seen) + 1, None), (max(seen) + 2, ""), (max(seen) + 3, " \n\t"), (-5, docs[4][1]), (max(seen) + 4, "x" * 5000), (max(seen) + 5, "x" * 700)]


@pytest.fixture(scope="module")
def docs():
    found = {}
    for d, t in corpus():
        found.setdefault(d, t)
    return list(found.items())


def test_suffix_dedup(spark, docs):
    assert sorted(map(tuple, suffix_dedup.removed(frame(spark, docs)).collect())) == brute.byte_dedup(docs)


def test_rlz_dedup(spark, docs):
    assert sorted(map(tuple, rlz_dedup.removed(frame(spark, docs)).collect())) == brute.word_dedup(docs)


def test_many_variants_are_resolved_window_by_window(spark, docs, monkeypatch):
    monkeypatch.setattr(windows, "MANY", 1)
    rows = frame(spark, docs)
    assert sorted(map(tuple, suffix_dedup.removed(rows).collect())) == brute.byte_dedup(docs)
    assert sorted(map(tuple, rlz_dedup.removed(rows).collect())) == brute.word_dedup(docs)


def test_a_group_sends_one_copy_of_a_hot_window(monkeypatch):
    import pyarrow as pa

    rng = random.Random(9)
    passage = "".join(rng.choices("abcdefgh", k=120))
    texts = ["".join(rng.choices("stuvwxyz", k=80)) + passage + "".join(rng.choices("stuvwxyz", k=80)) for _ in range(40)]
    units = windows.Units(50, suffix_dedup.UNITS.k, False)
    own = pa.table({"doc_id": pa.array(range(40), pa.int64()), "text": texts, "grp": pa.array([0] * 40, pa.int64())})
    found = windows.anchors_of(units, own.column("text"))[0]
    ids = windows.reply_id(found.anchor_hash & windows.U((1 << 48) - 1), found.span)
    mail = pa.Table.from_batches([windows.batch(windows.PACKED_ARROW, windows.replies(found.row.astype(np.int64), ids, np.full(len(ids), windows.ASK_SPLIT, np.uint8), 1))])
    sent = windows.answer(units, 8)(own, mail).to_pylist()
    asked = b"".join(r["codes"] for r in sent if r["kind"] == 1)
    copies = [asked[i : i + 50] for i in range(0, len(asked), 50)]
    assert len(copies) == len(set(copies))
    marked = sum(len(r["docs"]) // 8 for r in sent if r["kind"] == 0)
    assert len(copies) + marked == sum(len(t) - 49 for t in texts) and marked >= 39 * 71


def hot_window(n):
    rng = random.Random(12)
    passage = "".join(rng.choices("abcdefgh", k=90))
    words = " ".join(rng.choices(["ab", "c", "def", "gh"], k=30))
    return [(i, "".join(rng.choices("stuvwxyz ", k=60)) + passage + " " + words + " " + "".join(rng.choices("stuvwxyz ", k=60))) for i in range(n)]


def test_a_hot_window_is_thinned_over_several_groups(spark, monkeypatch):
    monkeypatch.setattr(windows, "MANY", 1)
    monkeypatch.setattr(windows, "GROUP_DOCS", 2)
    docs = hot_window(120)
    rows = frame(spark, docs + docs[40:60]).repartition(7)
    twice = docs + docs[40:60]
    assert sorted(map(tuple, suffix_dedup.removed(rows).collect())) == brute.byte_dedup(twice)
    assert sorted(map(tuple, rlz_dedup.removed(rows).collect())) == brute.word_dedup(twice)


def test_thinning_sends_one_copy_of_a_window_on():
    import pyarrow as pa

    units = windows.Units(50, suffix_dedup.UNITS.k, False)
    window = np.frombuffer(bytes(range(50)) + bytes(range(50, 100)), np.uint8)
    rows = [(-1, g, windows.ASKED, *(np.array(x, "<i8").tobytes() for x in ([g + 5, g + 5], [g, g], [0, 50], [1, 1])), window.tobytes()) for g in range(30)]
    got = windows.thin(units, suffix_dedup.mark_repeats, 8)(pa.Table.from_batches([windows.batch(windows.STRETCHES_ARROW, rows)])).to_pylist()
    sent = [r for r in got if r["kind"] == windows.ASKED]
    assert sum(len(r["docs"]) // 8 for r in sent) == 2 and {r["grp"] for r in sent} == {0}
    assert sum(len(r["docs"]) // 8 for r in got if r["kind"] == windows.MARKED) == 58
    keys = windows.thinning_key(np.arange(1000, dtype=np.uint64), np.arange(1000), 1000, 64)
    assert keys.max() < 0 and len(np.unique(keys)) <= 128


def test_jaccard(spark, docs):
    assert sorted(map(tuple, ngram_join.join(frame(spark, docs)).collect())) == brute.jaccard_components(docs)


def test_jaccard_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 5)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(60):
        w = list(base) + [f"t{j}" for j in range(i % 7 * 6)]
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
            w[rng.randrange(60)] = f"v{rng.randrange(9)}"
        docs.append((i, " ".join(w)))
    assert sorted(map(tuple, ngram_join.join(frame(spark, docs)).collect())) == brute.jaccard_components(docs)


def test_jaccard_of_frequent_shingles_in_repeated_rows(spark):
    rng = random.Random(8)
    shared, line = [f"s{i}" for i in range(54)], [f"l{i}" for i in range(90)]
    docs = []
    for i in range(200):
        own = [f"d{i}x{j}" for j in range(54)]
        docs.append((i, " ".join(shared + own if i % 2 else line + own[: rng.randrange(4, 40)])))
    rows = frame(spark, docs).repartition(3).unionByName(frame(spark, docs).repartition(4))
    assert sorted(map(tuple, ngram_join.join(rows).collect())) == brute.jaccard_components(docs)


def test_rows_of_one_id_make_one_set(spark):
    line = "a b c d e f g h i j"
    docs = [(1, line), (1, "k l m n o p q"), (2, line + " x y"), (3, "k l m n o p q"), (3, line), (4, None), (4, "k l"), (5, "")]
    got = sorted(map(tuple, ngram_join.join(frame(spark, docs).repartition(3)).collect()))
    assert got == [(1, 9, 1), (2, 8, 2), (3, 9, 1), (4, 1, 4), (5, 0, 5)]


def test_kept_documents(spark, docs):
    rows = frame(spark, docs)
    first = {d for d, _, c in brute.jaccard_components(docs) if d == c}
    kept = ngram_join.deduplicated(rows)
    assert kept.columns == rows.columns and {r["doc_id"] for r in kept.collect()} == first
    texts = suffix_dedup.deduplicated(rows)
    assert texts.columns == rows.columns and texts.count() == rows.count()
    by_id = {r["doc_id"]: r for r in texts.collect()}
    source = {r["doc_id"]: r for r in rows.collect()}
    assert all(by_id[d]["c0"] == source[d]["c0"] and by_id[d]["grp"] == "x" for d in source)


@pytest.mark.parametrize("run", [suffix_dedup.removed, rlz_dedup.removed, ngram_join.join])
def test_empty_and_null_tables(spark, run):
    assert run(frame(spark, [])).count() == 0
    assert run(frame(spark, [(None, "a b c d e f")])).count() == 0
    assert run(frame(spark, [(1, None), (2, None)])).count() == 2


def test_repeated_rows(spark):
    text = " ".join(f"word{i}" for i in range(40))
    rows = frame(spark, [(1, text), (1, text), (2, text)])
    got = sorted((r["doc_id"], r["n_removed"]) for r in suffix_dedup.removed(rows).collect())
    assert got == [(1, 0), (1, 0), (2, len(text))]
    assert sorted(map(tuple, ngram_join.join(rows).collect())) == [(1, 36, 1), (2, 36, 1)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60))
def test_suffix_array(symbols):
    x = np.array(symbols, np.int64)
    assert suffix_dedup.suffix_array(x).tolist() == sorted(range(len(x)), key=lambda i: symbols[i:])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=80), st.lists(st.integers(0, 2), max_size=80))
def test_anchors_cover_each_window_once(a, b):
    codes = np.array(a + b, np.uint64) + np.uint64(1)
    found = Anchors(codes, np.array([0, len(a), len(a) + len(b)]), 9, 4)
    got = sorted((int(r), int(f) + k) for r, f, c in zip(found.row, found.first, found.count, strict=True) for k in range(int(c)))
    want = [(0, i) for i in range(len(a) - 8)] + [(1, len(a) + i) for i in range(len(b) - 8)]
    assert got == want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab \t\n é", max_size=12)), max_size=6))
def test_word_spans(texts):
    import pyarrow as pa

    raw, offsets = text_bytes(pa.array(texts, pa.string()))
    start, end, rows = word_spans(raw, offsets)
    got = [[raw[s:e].tobytes() for s, e in zip(start[a:b], end[a:b], strict=True)] for a, b in zip(rows, rows[1:], strict=False)]
    assert got == [brute.words(t) for t in texts]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 12), unique=True).map(sorted), min_size=1, max_size=6), st.integers(1, 4))
def test_merge_skip(lists, least):
    counts = {d: sum(d in x for x in lists) for d in range(13)}
    assert dict(ngram_join.merge_skip(lists, least)) == {d: c for d, c in counts.items() if c >= least}


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (201, 200), (300, 300), (None, 1)]
    got = {r["member"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 0, 200: 200, 201: 200}


def vectors(seed=1):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for label in (0, 1):
        for _ in range(25):
            rows.append((k, rng.normal(size=8).tolist(), label))
            k += 1
        centre = rng.normal(size=8)
        for spread in (0.02, 0.15):
            for _ in range(15):
                rows.append((k, (centre * 3 + rng.normal(size=8) * spread * 3).tolist(), label))
                k += 1
    rows += [(k, None, 0), (k + 1, [0.0] * 8, 0), (k + 2, [float("nan")] * 8, 0), (k + 3, [None] + [1.0] * 7, 0), (k + 4, rows[0][1], None), (k + 5, [float("inf")] * 8, 1), (k + 6, rows[3][1], 0), (k + 7, [1.0, 2.0], 0)]
    return rows


def test_embeddings(spark):
    rows = vectors()
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3))
    assert sorted(map(tuple, got.collect())) == brute.vector_links(rows)


def spread_group(n, pair_cosine, width=64, seed=2):
    """Rows of one label, all pairs of which have about the same cosine."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=width)
    centre /= np.linalg.norm(centre)
    spread = np.sqrt((1 / pair_cosine - 1) / width)
    return [(i, (centre + rng.normal(size=width) * spread).tolist(), 0) for i in range(n)]


EMBEDDINGS = "vec_id long, embedding array<double>, label int"


def near(spark, rows, **options):
    found = embedding_dedup.near_duplicates(spark.createDataFrame(rows, EMBEDDINGS).repartition(3), **options)
    return sorted(map(tuple, found.collect()))


def test_a_thousand_vectors_with_saturated_lists(spark):
    rng = np.random.default_rng(4)
    rows = spread_group(1000, 0.955)
    rows += [(5000 + i, v, 0) for i, (_, v, _) in enumerate(spread_group(30, 0.95, seed=7))]
    rows += [(9000 + i, rng.normal(size=64).tolist(), i % 2) for i in range(300)]
    report = {}
    assert near(spark, rows, report=report) == brute.vector_links(rows)
    assert report["recall"] > embedding_dedup.RECALL and report["sampled_edges"] > 1000 and not report["exact_labels"]


@pytest.mark.parametrize("block", [17, 1024])
def test_lists_full_at_the_cap_are_compared_exactly(spark, monkeypatch, block):
    for name, value in (("MAX_K", 10), ("BLOCK", block)):
        monkeypatch.setattr(embedding_dedup, name, value)
    rows = spread_group(90, 0.94, width=16)
    rows += [(1000 + i, v, 0) for i, (_, v, _) in enumerate(spread_group(8, 0.95, width=16, seed=7))]
    assert near(spark, rows) == brute.vector_links(rows)


def test_a_failed_audit_leads_to_exact_comparison(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "seeds", lambda lists, table, floor: spark.createDataFrame([], embedding_dedup.OFFERS))
    monkeypatch.setattr(embedding_dedup, "AUDITS", 2)
    rows = spread_group(40, 0.95, width=16) + [(100 + i, v, 1) for i, v, _ in spread_group(12, 0.95, width=16, seed=3)]
    report = {}
    assert near(spark, rows, report=report) == brute.vector_links(rows)
    assert report["exact_labels"] and report["recall"] < 0.5


def test_balls_in_doubt_are_compared_member_by_member(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 7)
    rng = np.random.default_rng(11)
    middle = rng.normal(size=32)
    middle /= np.linalg.norm(middle)
    rows = []
    for angle in (0.0, 0.3, 0.36, 0.42, 0.75):
        side = rng.normal(size=32)
        side -= (side @ middle) * middle
        centre = np.cos(angle) * middle + np.sin(angle) * side / np.linalg.norm(side)
        rows += [(len(rows) + i, (centre + rng.normal(size=32) * 0.015).tolist(), 3) for i in range(25)]
    assert near(spark, rows) == brute.vector_links(rows)
    assert any(25 > n > 0 or n > 25 for _, n, _, _ in brute.vector_links(rows))


def test_repeated_ids_and_widths(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(1, same, 0), (1, same, 0), (2, same, 0), (3, [1.0, 2.0], 0), (4, [2.0, 4.0], 0), (5, [1.0, 2.0], 1), (None, same, 0), (6, [], 0)]
    assert near(spark, rows) == [(1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (4, 1, 3, False), (5, 0, 5, True), (6, 0, 6, True)]


def test_other_columns_may_clash(spark):
    rows = [(i, v, 0, i, 1, 2.0, "x") for i, v, _ in spread_group(6, 0.99, width=8)]
    own = spark.createDataFrame(rows, EMBEDDINGS + ", id int, n int, x double, centre string")
    assert sorted(map(tuple, embedding_dedup.near_duplicates(own).collect())) == brute.vector_links([r[:3] for r in rows])


def test_working_tables_are_deleted(spark):
    import glob

    from sheafline.llm import common

    folder = f"{common.shared_dir(spark)}/sheafline/*"
    before = set(glob.glob(folder))
    got = embedding_dedup.near_duplicates(spark.createDataFrame(spread_group(20, 0.95, width=8), EMBEDDINGS))
    assert [t.rsplit("/", 1)[1].split("-")[0] for t in set(glob.glob(folder)) - before] == ["result"] and got.count() == 20


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace as Fake

    from sheafline.llm import common

    conf = Fake(get=lambda name, other: None)
    cluster = Fake(sparkContext=Fake(getConf=lambda: conf, master="spark://host:7077", applicationId="a"), conf=conf)
    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_dir(cluster)
    told = Fake(get=lambda name, other: "hdfs://shared/tmp/")
    assert common.shared_dir(Fake(sparkContext=Fake(getConf=lambda: told, master="spark://host:7077"), conf=conf)) == "hdfs://shared/tmp"


def test_no_embeddings(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
