"""Exact search, centroid clustering and the filter audit against brute force, and their edge cases."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest

from sheafline.llm import centroids, exact_search, filter_audit

VECTORS = "vec_id long, embedding array<double>, score string, x int, cluster string, cell int, block string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "s", 1, "c", 2, "b") for i, v in rows], VECTORS)


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


# exact search --------------------------------------------------------------------


def brute_top(rows, k=5, every=50, scale=256):
    whole = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if usable(v)]
    out = []
    for q, x in whole:
        if q is None or q % every:
            continue
        scores = [(-sum(a * b for a, b in zip(x, y, strict=True)), i is None, i or 0) for i, y in whole if i != q and len(x) == len(y)]
        scores = sorted((max(s, 1 - 2**63), none, i) if s < 0 else (min(s, 2**63 - 1), none, i) for s, none, i in scores)
        out += [(q, r, None if none else i, -s) for r, (s, none, i) in enumerate(scores[:k], 1)]
    return sorted(out, key=str)


def check_top(spark, rows, **kw):
    got = [tuple(r) for r in exact_search.top_k(frame(spark, rows), **kw).collect()]
    assert sorted(got, key=str) == brute_top(rows, **kw)


def test_top_k_on_clusters_copies_and_odd_rows(spark, monkeypatch):
    for name, value in {"SHARD": 40, "BLOCK": 6, "LEAF": 5, "WAVES": (1, 3), "TOGETHER": 2}.items():
        monkeypatch.setattr(exact_search, name, value)
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(6, 8)) * 3
    rows = [(int(i), (middle[i % 6] + 0.2 * rng.normal(size=8)).tolist()) for i in range(-40, 360)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)]  # one very common vector, whose copies tie
    rows += [(2000, None), (2001, [1.0, None] + [0.0] * 6), (2050, [float("nan")] * 8), (2100, [float("inf")] + [0.0] * 7), (2150, [0.0] * 8)]
    rows += [(None, rows[7][1]), (None, None), (3000, [1.0, 2.0]), (3001, [2.0, 1.0]), (3050, []), (3051, []), (50, rows[3][1])]
    check_top(spark, rows, every=10)
    check_top(spark, rows, every=50, k=2)


def test_top_k_with_huge_components_and_few_candidates(spark):
    check_top(spark, [(0, [1e300, 1.0]), (50, [1e18, -1e18]), (1, [1e-300, 5e8]), (2, [-1e300, 0.0]), (100, [3e7 + 0.5, 0.1])])
    check_top(spark, [(50, [1.0])])
    check_top(spark, [])
    check_top(spark, [(1, [1.0]), (2, [2.0])])


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    x = np.floor(np.concatenate([rng.normal(c, 1, size=(300, 6)) * 50 for c in (-9, 0, 9)]))
    tree = exact_search.Tree(np.arange(len(x)), x)
    q = np.floor(rng.normal(9, 1, size=(4, 6)) * 50)
    lengths = np.sqrt((q**2).sum(axis=1))
    for node in range(len(tree.lo)):
        _, inside = tree.rows(node)
        assert (tree.bounds([node], q, lengths)[:, 0] >= (q @ inside.T).max(axis=1)).all()
    assert sorted(tree.ids.tolist()) == list(range(len(x)))
    queries = exact_search.Queries(np.full(4, -1), q, 5)
    assert exact_search.descend(queries, [tree]) < len(tree.lo) / 2


# clustering -----------------------------------------------------------------------


def brute_clusters(rows, k=16, rounds=3, width=64, scale=64):
    limit = centroids.LIMIT
    kept = [(i, [max(-limit, min(limit, math.floor(scale * x))) for x in v]) for i, v in rows if usable(v) and len(v) == width]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [x for _, x in order[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        groups = [[] for _ in centres]
        for _, x in kept:
            groups[near(x)[1]].append(x)
        centres = [[sum(c) // len(g) for c in zip(*g, strict=True)] if g else c for g, c in zip(groups, centres, strict=True)]
    found = [(i, *near(x)) for i, x in kept]
    per = [sum(d for _, d, c in found if c == j) for j in range(len(centres))]
    cap = lambda v: min(v, 2**63 - 1)
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, d, cap(per[c]), cap(sum(per)), shas[c]) for i, d, c in found), key=str)


@pytest.mark.parametrize("n", [0, 1, 9, 120])
def test_clusters(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, (rng.normal(i % 3, 0.3, size=64)).tolist()) for i in range(n)]
    if n == 120:
        rows += [(500, rows[4][1]), (500, rows[4][1]), (500, rows[5][1]), (None, rows[6][1]), (None, None), (501, rows[4][1][:63]), (502, [float("nan")] * 64), (503, [None] * 64), (504, [1e300, -1e300] * 32), (505, [-1e300, 1e300] * 32)]
        rows += [(1000 + i, rows[2][1]) for i in range(60)]  # one very common vector
    got = [tuple(r) for r in centroids.cluster(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == brute_clusters(rows)


# the audit ------------------------------------------------------------------------


def brute_audit(docs, labels):
    marks = {}
    for d, q, t in labels:
        if d is not None:
            old = marks.get(d, (False, False))
            marks[d] = (old[0] or q == 1, old[1] or t == 1)
    parts = {}
    for d, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        key = lambda i: (i is None, i or 0)
        twin = any((u or "") == t and key(e) < key(d) for e, u, _ in docs)
        fails = [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), twin]
        parts.setdefault(s or "", []).append(({c for c, f in zip("ABCDE", fails, strict=True) if f}, *marks.get(d, (False, False))))
    out = []
    for part, rows in parts.items():
        for order in itertools.permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                all_f = sum(f in r[0] for r in rows)
                out.append([part, "".join(order), step, len(left), len(gone), all_f - len(gone), sum(r[0] == {f} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone), 0])
    totals = {}
    for r in out:
        totals[r[0], r[1][r[2] - 1]] = totals.get((r[0], r[1][r[2] - 1]), 0) + r[4]
    return sorted((*r[:9], totals[r[0], r[1][r[2] - 1]]) for r in out)


def test_audit(spark):
    rng = random.Random(2)
    docs = []
    for i in range(200):
        w = [f"w{rng.randrange(rng.choice([10, 400]))}" for _ in range(rng.choice([3, 49, 50, 80]))]
        w += ["ABCD"] * rng.choice([0, 0, 9]) + ["a#b"] * rng.choice([0, 0, 1])
        docs.append((i, rng.choice(["\n", " ", "\t\x0b"]).join(w), rng.choice(["a", "b", "b", ""])))
    docs += [(300 + i, docs[i % 3][1], "a") for i in range(60)]  # one very common text
    docs += [(301, docs[1][1], "b"), (0, docs[0][1], "c"), (-5, None, None), (400, "", "a"), (None, docs[9][1], "a"), (None, "only here", "a"), (None, "only here", "b"), (401, "é" * 30000 + " X", "long")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 330, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    frame_ = spark.createDataFrame([(d, t, s, 1, 2, "m") for d, t, s in docs], "doc_id long, text string, source string, part int, id int, mask string")
    marks = spark.createDataFrame([(*r, 3) for r in labels], "doc_id long, quality int, toxic int, n int")
    got = sorted(tuple(r) for r in filter_audit.audit(frame_, marks).collect())
    assert got == brute_audit(docs, labels)
    assert filter_audit.audit(frame_.where("false"), marks).count() == 0
    assert sorted(tuple(r) for r in filter_audit.audit(frame_, marks.where("false")).collect()) == brute_audit(docs, [])


def test_paths_through_the_lattice():
    reach, leave = filter_audit.forward(5), filter_audit.backward(5)
    assert reach[31] == leave[0] == 120
    passing = {}
    for _, _, state, f in filter_audit.paths("ABCDE"):
        passing[state, f] = passing.get((state, f), 0) + 1
    assert {(s, f): w for s, f, w in filter_audit.edges(5)} == passing
