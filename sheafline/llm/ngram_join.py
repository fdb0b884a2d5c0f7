"""N-gram Jaccard join by T-occurrence search (operator 3).

A document's set holds its distinct five-word shingles (ASCII letters in lower
case); two documents link when 100 * shared >= 75 * union.

1.  Shingle hashes go, packed, to buckets by hash; each bucket knows how many
    documents have a shingle.  Shingles of one document alone are dropped, the
    others return to their documents with that number, capped at ``MANY``.
    Documents with less than three quarters of their set left link with nothing.
2.  Of each set of equal documents the smallest goes on.  In the order "rarest
    shingles first", linked documents share one of their first few shingles.
    Each such shingle brings its documents to the group of its smallest one.
    Linked sets differ in size by a quarter at most, so a large group is split
    into overlapping windows of two neighbouring size classes; a window is cut
    into blocks, each with the window's smallest document.
3.  In a block, T-occurrence search by DivideSkip finds the partners of the
    smallest document, and then of the documents that are not linked to it,
    directly or not: of the query's inverted lists the longest are set aside,
    the others merged by a heap that skips what cannot reach the threshold, and
    the survivors looked up in the long lists by binary search.
4.  Where a window has several blocks, the documents not yet linked with its
    smallest one search all of its blocks, in slices, so no link is lost and no
    task takes in more than a block and a slice.
5.  Links become components (``components``).

Shingles that a task sees in ``MANY`` documents return at once, and one mark of
each goes to the bucket, so frequent shingles make no large bucket.

Shingles are told apart by 48 bits: with D distinct ones in the corpus, a given
shingle meets another's number with probability D / 2**48 at most, and a link
is wrong only where such meetings make up for what the overlap lacks.

Null, empty and blank texts have an empty set and are alone.  With one to four
words the whole sequence is the only shingle.  Rows that repeat an id count as
one document and give one row: its set is the union of their sets.  Rows
without an id are left out.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HASH_SLICE_BYTES, one_row_per_doc, slices, working_tables, written
from .components import apart, components
from .hashing import LOWER, U, gram_hash, mix, prefix_sums, span_hash, text_bytes, word_codes, word_spans
from .windows import GROUP_DOCS, PACKED, PACKED_ARROW, batch, cut, group_of, replies, runs, uncut

SHINGLE = 5
#: Document counts of a shingle are told apart up to this number.
MANY = 64
BLOCK_DOCS = 1000
BUCKET_BYTES = 8 << 20
TOKEN = U((1 << 48) - 1)
#: Weight of a merged list against a looked-up one, from the DivideSkip paper.
MU = 0.0085
#: Salts of the two sums that stand for a set.
SALTS = (U(0x5851F42D4C957F2D), U(0x14057B7EF767814F))

SETS = "doc_id long, n long, set_a long, set_b long, tokens binary, mixed boolean"
FOUND = "a long, b long, owner long, win int, blocks int"


def least_shared(n: int, m: int) -> int:
    """The overlap that links sets of n and m shingles: 7 * shared >= 3 * (n + m)."""
    return -(-3 * (n + m) // 7)


def least_any(n: int) -> int:
    """What a set of n shares at least with anything that it links with."""
    return -(-3 * n // 4)


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each distinct shingle, sorted by row and hash."""
    raw, offsets = text_bytes(column)
    raw = LOWER[raw]
    start, end, rows = word_spans(raw, offsets)
    codes = word_codes(raw, start, end)
    sums = prefix_sums(codes)
    grams = gram_hash(sums, SHINGLE)
    n = np.diff(rows)
    many = np.maximum(n - SHINGLE + 1, 0)
    row = np.repeat(np.arange(len(n)), many)
    at = np.repeat(rows[:-1] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    few = np.flatnonzero((n > 0) & (n < SHINGLE))
    row = np.concatenate([row, few])
    value = np.concatenate([grams[at], span_hash(sums, rows[few], rows[few + 1])])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def announce(docs: DataFrame, buckets: int, groups: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=HASH_SLICE_BYTES):
            doc_ids = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            row, value = shingles(part.column("text"))
            # each document's size and two sums that stand for its set
            n = np.bincount(row, minlength=len(doc_ids))
            first = np.cumsum(n) - n
            sums = np.zeros((len(doc_ids), 2), U)
            some = n > 0
            if some.any():
                for k, salt in enumerate(SALTS):
                    sums[some, k] = np.add.reduceat(mix(value ^ salt), first[some])
            sets = np.concatenate([n.astype(U)[:, None], sums], 1)
            grp = group_of(doc_ids, groups)
            order = np.argsort(grp, kind="stable")
            out = [(-1 - g, 4, doc_ids[i].tobytes(), sets[i].tobytes(), b"") for g, s, e in runs(grp[order]) for i in (order[s:e],)]
            docs, token = doc_ids[row], value & TOKEN
            order = np.lexsort((docs, token))
            docs, token = docs[order], token[order]
            new = np.ones(len(docs), bool)
            new[1:] = (docs[1:] != docs[:-1]) | (token[1:] != token[:-1])
            docs, token = docs[new], token[new]
            head = np.ones(len(docs), bool)
            head[1:] = token[1:] != token[:-1]
            size = np.bincount(np.cumsum(head) - 1)[np.cumsum(head) - 1] if len(docs) else np.zeros(0, np.int64)
            often = size >= MANY
            if often.any():
                own = replies(docs[often], token[often], np.full(int(often.sum()), MANY, np.uint8), groups)
                out += [(-1 - r[0], *r[1:]) for r in own]
                marks = token[often & head]
                bucket = (marks % U(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                out += [(b, 3, b"", cut(marks[order[s:e]], 6), b"") for b, s, e in runs(bucket[order])]
                docs, token = docs[~often], token[~often]
            bucket = (token % U(buckets)).astype(np.int64)
            order = np.lexsort((docs, bucket))
            docs, token, bucket = docs[order], token[order], bucket[order]
            for b, s, e in runs(bucket):
                steps = np.diff(docs[s:e], prepend=0)
                packed = steps.astype("<u4").tobytes() if steps[0] >= 0 and steps.max() < 1 << 32 else b""
                out.append((b, 0 if packed else 2, packed or docs[s:e].astype("<i8").tobytes(), cut(token[s:e], 6), b""))
            yield batch(PACKED_ARROW, out)

    return docs.mapInArrow(run, PACKED)


def count(groups: int) -> Callable[[pa.Table], pa.Table]:
    """In a bucket: how many documents have each shingle."""

    def run(rows: pa.Table) -> pa.Table:
        keys = rows.column("key").to_pylist()
        if keys[0] < 0:
            return rows.set_column(0, "key", pa.array([-1 - k for k in keys], pa.int64()))
        docs, token, often = [np.zeros(0, np.int64)], [np.zeros(0, U)], [np.zeros(0, U)]
        for kind, d, a in zip(*(rows.column(c).to_pylist() for c in ("kind", "docs", "a")), strict=True):
            if kind == 3:
                often.append(uncut(a, 6))
                continue
            docs.append(np.cumsum(np.frombuffer(d, "<u4").astype(np.int64)) if kind == 0 else np.frombuffer(d, "<i8"))
            token.append(uncut(a, 6))
        docs, token, often = np.concatenate(docs), np.concatenate(token), np.unique(np.concatenate(often))
        order = np.lexsort((docs, token))
        docs, token = docs[order], token[order]
        new = np.ones(len(docs), bool)
        new[1:] = (docs[1:] != docs[:-1]) | (token[1:] != token[:-1])
        docs, token = docs[new], token[new]
        if not len(docs):
            return PACKED_ARROW.empty_table()
        head = np.ones(len(docs), bool)
        head[1:] = token[1:] != token[:-1]
        of = np.cumsum(head) - 1
        size = np.minimum(np.bincount(of)[of], MANY)
        if len(often):
            size[np.isin(token, often)] = MANY
        some = size > 1
        return pa.Table.from_batches([batch(PACKED_ARROW, replies(docs[some], token[some], size[some].astype(np.uint8), groups))], PACKED_ARROW)

    return run


SETS_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("tokens", pa.binary()), ("mixed", pa.bool_())])


def assemble(rows: pa.Table) -> pa.Table:
    """A group's documents with their shared shingles, rarest first, if enough are shared.

    A document that comes in several rows may get a shingle several times.  It is
    mixed if its rows differ: then size and sums are those of its largest row.
    """
    kinds = rows.column("kind").to_pylist()
    cols = {c: rows.column(c).to_pylist() for c in ("docs", "a", "b")}
    take = lambda kind, c, t: np.frombuffer(b"".join(x for x, k in zip(cols[c], kinds, strict=True) if k == kind), t)
    doc_ids, sets = take(4, "docs", "<i8"), take(4, "a", "<u8").reshape(-1, 3)
    docs, token, size = take(1, "docs", "<i8"), take(1, "a", "<u8"), take(1, "b", "u1")
    order = np.lexsort((-size.astype(np.int64), token, docs))
    new = np.ones(len(order), bool)
    new[1:] = (docs[order][1:] != docs[order][:-1]) | (token[order][1:] != token[order][:-1])
    docs, token, size = docs[order][new], token[order][new], size[order][new]
    order = np.lexsort((token, size, docs))
    docs, token = docs[order], token[order]
    out = []
    order = np.lexsort((sets[:, 2], sets[:, 1], -sets[:, 0].astype(np.int64), doc_ids))
    doc_ids, sets = doc_ids[order], sets[order]
    for doc, s, e in runs(doc_ids):
        n, mixed = int(sets[s, 0]), bool((sets[s:e] != sets[s]).any())
        low, high = np.searchsorted(docs, doc), np.searchsorted(docs, doc, "right")
        enough = n and high - low >= least_any(n)
        out.append((doc, n, *sets[s, 1:].astype(U).view(np.int64).tolist(), token[low:high].tobytes() if enough else None, mixed))
    return pa.Table.from_batches([batch(SETS_ARROW, out)], SETS_ARROW)


def united(docs: DataFrame) -> DataFrame:
    """``doc_id, n, set_a, set_b`` of the union of each document's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=HASH_SLICE_BYTES):
            row, value = shingles(part.column("text"))
            ids = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)[row]
            yield pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(x.view(np.int64)) for x in (value, *(mix(value ^ salt) for salt in SALTS)))], names=["doc_id", "value", "a", "b"])

    each = docs.mapInArrow(run, "doc_id long, value long, a long, b long").distinct()

    def wrapped(c: str):
        low = F.pmod(F.sum(F.col(c).cast("decimal(20,0)")), F.lit(str(1 << 64)).cast("decimal(38,0)"))
        return F.when(low >= F.lit(str(1 << 63)).cast("decimal(38,0)"), low - F.lit(str(1 << 64)).cast("decimal(38,0)")).otherwise(low).cast("long")

    return each.groupBy("doc_id").agg(F.count("*").alias("u"), wrapped("a").alias("ua"), wrapped("b").alias("ub"))


def shingle_sets(docs: DataFrame) -> DataFrame:
    """Step 1: every document's set size and digest, and its shared shingles."""
    own = one_row_per_doc(docs).where(F.col("doc_id").isNotNull())
    size = own.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    groups = int(max(1, size["n"] // GROUP_DOCS, size["bytes"] // BUCKET_BYTES)) | 1
    buckets = int(max(8, size["bytes"] // BUCKET_BYTES))
    mail = announce(own, buckets, groups).groupBy("key").applyInArrow(count(groups), PACKED)
    sets = written(mail.groupBy("key").applyInArrow(assemble, SETS), "shingles")
    mixed = sets.where("mixed").select("doc_id")
    if not mixed.isEmpty():
        whole = united(own.join(mixed, "doc_id", "left_semi"))
        n = F.coalesce("u", "n")
        enough = F.octet_length("tokens") / 8 >= F.ceil(3 * n / 4)
        sets = sets.join(whole, "doc_id", "left").select("doc_id", n.alias("n"), F.coalesce("ua", "set_a").alias("set_a"), F.coalesce("ub", "set_b").alias("set_b"), F.when(enough, F.col("tokens")).alias("tokens"), "mixed")
        sets = written(sets, "shingles")
    return sets


# the search ------------------------------------------------------------------


class InvertedLists:
    """Documents of a block by shingle; each list has document numbers in order."""

    def __init__(self, sets: list[np.ndarray]):
        token = np.concatenate(sets) if sets else np.zeros(0, U)
        doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(token, kind="stable")
        token, self.doc = token[order], doc[order]
        at = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
        self.token = token[at]
        self.start, self.end = at, np.append(at[1:], len(token))[: len(at)]

    def lists(self, query: np.ndarray) -> list[np.ndarray]:
        if not len(self.token):
            return []
        at = np.minimum(np.searchsorted(self.token, query), len(self.token) - 1)
        at = at[self.token[at] == query]
        return [self.doc[s:e] for s, e in zip(self.start[at].tolist(), self.end[at].tolist(), strict=True)]


def merge_skip(lists: list[list[int]], least: int) -> Iterator[tuple[int, int]]:
    """(document, count) for documents on at least ``least`` of the sorted lists."""
    heap = [(x[0], k) for k, x in enumerate(lists) if x]
    place = [0] * len(lists)
    heapq.heapify(heap)
    while len(heap) >= least:
        top, popped = heap[0][0], []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= least:
            yield top, len(popped)
            after = top + 1
        else:
            # fewer than `least` lists can hold anything before the next top
            while heap and len(popped) < least - 1:
                popped.append(heapq.heappop(heap)[1])
            if not heap:
                return
            after = max(top + 1, heap[0][0])
        for k in popped:
            place[k] = bisect_left(lists[k], after, place[k])
            if place[k] < len(lists[k]):
                heapq.heappush(heap, (lists[k][place[k]], k))


def search(query: np.ndarray, n: int, index: InvertedLists, sizes: np.ndarray) -> list[int]:
    """DivideSkip: documents of the block that a set of n shingles links with."""
    least = least_any(n)
    lists = sorted(index.lists(query), key=len)
    if len(lists) < least:
        return []
    longest = len(lists[-1])
    aside = min(int(least / (MU * math.log2(longest + 1) + 1)), least - 1)
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    least_short = least - aside
    out = []
    for d, c in merge_skip([x.tolist() for x in short], least_short):
        need = least_shared(n, int(sizes[d]))
        rest = len(long)
        for x in reversed(long):
            if c >= need or c + rest < need:
                break
            at = int(np.searchsorted(x, d))
            c += at < len(x) and x[at] == d
            rest -= 1
        if c >= need:
            out.append(d)
    return out


def search_block(docs: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], first: int, queries: list[int] | None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links by document number, and each document's root; ``first`` is searched first.

    With ``queries`` only those are searched for; else all not yet linked with ``first``.
    """
    root = np.arange(len(docs))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return int(i)

    index = InvertedLists(sets)
    links = []

    def link(q: int) -> None:
        for d in search(sets[q], int(sizes[q]), index, sizes):
            if (a := find(q)) != (b := find(d)):
                root[max(a, b)] = min(a, b)
                links.append((q, d))

    if queries is None:
        link(first)
        for q in range(len(docs)):
            if q != first and find(q) != find(first):
                link(q)
    else:
        for q in queries:
            link(q)
    return links, np.array([find(i) for i in range(len(docs))])


FOUND_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("owner", pa.int64()), ("win", pa.int32()), ("blocks", pa.int32())])


def search_shard(rows: pa.Table) -> pa.Table:
    """All blocks of a shard: links (a, b), and documents to search on with (a, owner, win)."""
    owner, win, block, part, blocks, heads = (rows.column(c).to_numpy() for c in ("owner", "win", "block", "part", "blocks", "head"))
    docs, sizes, asks = (rows.column(c).to_numpy() for c in ("doc_id", "n", "asks"))
    tokens = rows.column("tokens")
    # an asking document may be one of the block's own: it counts once, as asking
    order = np.lexsort((~asks, docs, part, block, win, owner))
    same = lambda *keys: np.logical_and.reduce([k[order][1:] == k[order][:-1] for k in keys])
    order = order[np.concatenate([[True], ~same(owner, win, block, part, docs)])] if len(order) else order
    new = np.concatenate([[True], ~same(owner, win, block, part)]) if len(order) else np.zeros(0, bool)
    out = []
    cuts = [*np.flatnonzero(new).tolist(), len(order)]
    for s, e in zip(cuts, cuts[1:], strict=False):
        i = order[s:e]
        if e - s < 2:
            continue
        sets = [np.frombuffer(tokens[k].as_py(), "<u8") for k in i.tolist()]
        first = int(np.flatnonzero(docs[i] == heads[i[0]])[0]) if (docs[i] == heads[i[0]]).any() else 0
        queries = np.flatnonzero(asks[i]).tolist()
        links, root = search_block(docs[i], sizes[i], sets, first, queries or None)
        out += [(int(docs[i[a]]), int(docs[i[b]]), None, None, None) for a, b in links]
        if blocks[i[0]] > 1 and not queries:
            group = (int(owner[i[0]]), int(win[i[0]]), int(blocks[i[0]]))
            out += [(int(docs[k]), None, *group) for k, r in zip(i.tolist(), root.tolist(), strict=True) if r != root[first]]
    return pa.Table.from_batches([batch(FOUND_ARROW, out)], FOUND_ARROW)


def prefixes(sets: DataFrame) -> DataFrame:
    """The first shingles of each set, of which linked sets share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            ids, token = [], []
            for doc, n, blob in zip(*(part.column(c).to_pylist() for c in ("doc_id", "n", "tokens")), strict=True):
                own = np.frombuffer(blob, "<i8")
                own = own[: len(own) - least_any(n) + 1]
                ids.append(np.full(len(own), doc))
                token.append(own)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token)), pa.array(np.concatenate(ids))], names=["token", "doc_id"])

    return sets.select("doc_id", "n", "tokens").mapInArrow(run, "token long, doc_id long")


def placed_in_blocks(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """``owner, win, head, blocks, block, doc_id`` of the members of each owner's group."""
    count = members.groupBy("owner").agg(F.count("*").alias("c")).select(apart("owner"), "c")
    # sets of sizes n <= m link only if 4 n >= 3 m, so their classes differ by one at most
    grade = F.floor(F.log(F.col("n").cast("double")) / math.log(4 / 3)).cast("int")
    both = F.when(F.col("c") > BLOCK_DOCS, F.array(grade, grade + 1)).otherwise(F.array(F.lit(0)))
    rows = members.join(count, "owner")
    small = rows.where(F.col("c") <= BLOCK_DOCS).select("owner", F.lit(0).alias("win"), F.col("owner").alias("head"), F.lit(1).alias("blocks"), F.lit(0).alias("block"), "doc_id")
    large = rows.where(F.col("c") > BLOCK_DOCS).join(sizes, "doc_id").select("owner", "doc_id", F.explode(both).alias("win"))
    window = large.groupBy("owner", "win").agg(F.min("doc_id").alias("head"), F.ceil(F.count("*") / F.lit(BLOCK_DOCS)).cast("int").alias("blocks")).select(apart("owner"), "win", "head", "blocks")
    own = F.array(F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    large = large.join(window, ["owner", "win"]).select("owner", "win", "head", "blocks", F.explode(F.when(F.col("head") == F.col("doc_id"), every).otherwise(own)).alias("block"), "doc_id")
    return small.unionByName(large)


def links(sets: DataFrame) -> DataFrame:
    """Steps 2 to 4: ``a, b`` pairs that connect all linked sets (not all pairs)."""
    kept = written(sets, "sets")
    prefix = prefixes(kept)
    owners = prefix.groupBy("token").agg(F.min("doc_id").alias("owner"), F.count("*").alias("c")).where("c > 1").select(apart("token"), "owner")
    members = written(prefix.join(owners, "token").select("owner", "doc_id").distinct(), "members")
    placed = written(placed_in_blocks(members, kept.select("doc_id", "n")), "placed")
    total = placed.count()

    def searched(rows: DataFrame, rows_in_all: int) -> DataFrame:
        shards = max(8, rows_in_all // BLOCK_DOCS)
        shard = F.pmod(F.xxhash64("owner", "win", "block", "part"), F.lit(shards))
        full = rows.join(kept.select("doc_id", "n", "tokens"), "doc_id").withColumn("shard", shard)
        return written(full.groupBy("shard").applyInArrow(search_shard, FOUND), "found")

    found = searched(placed.withColumns({"part": F.lit(0), "asks": F.lit(False)}), total)
    pairs = found.where(F.col("b").isNotNull()).select("a", "b")
    left = found.where(F.col("owner").isNotNull())
    if not left.isEmpty():
        # askers in slices, each of which meets every block of its window
        parts = left.groupBy("owner", "win").agg(F.ceil(F.count("*") / F.lit(BLOCK_DOCS)).cast("int").alias("parts"), F.min("blocks").alias("blocks")).select(apart("owner"), "win", "parts", "blocks")
        part = F.pmod(F.xxhash64("a", F.lit(1)), F.col("parts")).cast("int").alias("part")
        asking = left.select("owner", "win", F.col("a").alias("doc_id")).distinct().withColumnRenamed("doc_id", "a").join(parts, ["owner", "win"])
        asking = asking.select("owner", "win", F.lit(None).cast("long").alias("head"), "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("a").alias("doc_id"), part, F.lit(True).alias("asks"))
        again = placed.join(parts.select("owner", "win", "parts"), ["owner", "win"])
        again = again.select("owner", "win", "head", "blocks", "block", "doc_id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("asks"))
        both = written(again.unionByName(asking), "asking")
        pairs = pairs.unionByName(searched(both, both.count()).where(F.col("b").isNotNull()).select("a", "b"))
    return pairs


def join(docs: DataFrame) -> DataFrame:
    """Per document: set size and the smallest document reachable by links."""
    with working_tables(docs.sparkSession) as keep:
        return keep(written(joined(docs), "classes"))


def joined(docs: DataFrame) -> DataFrame:
    sets = shingle_sets(docs)
    full = sets.where("n > 0")
    same = full.groupBy("n", "set_a", "set_b").agg(F.min("doc_id").alias("head"), F.count("*").alias("c"))
    heads = same.select(F.col("head").alias("doc_id"))
    distinct = full.where(F.col("tokens").isNotNull()).join(heads, "doc_id", "left_semi")
    copies = (
        full.select("n", "set_a", "set_b", "doc_id").join(same.where("c > 1").select(apart("n"), "set_a", "set_b", "head"), ["n", "set_a", "set_b"])
        .where("doc_id != head").select(F.col("doc_id").alias("a"), F.col("head").alias("b"))
    )
    found = components(links(distinct).unionByName(copies))
    out = sets.select("doc_id", "n").join(found, F.col("doc_id") == F.col("member"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The first document of each component, with all its columns.

    Rows without an id are kept; of rows that repeat an id all or none are.
    """
    first = join(docs).where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("kept__id"))
    kept = docs.join(first, docs["doc_id"].cast("long") == first["kept__id"], "left_semi")
    return kept.unionByName(docs.where(docs["doc_id"].isNull()))
