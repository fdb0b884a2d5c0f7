"""Finding windows of a corpus that also start in a document with a smaller id.

This is the part that substring dedup by suffix arrays (bytes) and by relative
Lempel-Ziv parsing (words) share: it brings together, in bounded shards, just
the stretches of text whose windows can repeat, and lets a *resolver* decide.

1.  Every document is cut into anchored stretches (``hashing.Anchors``): equal
    windows have equal anchors.  Anchor and stretch hashes go, packed, to a
    bucket by anchor hash.  There, an anchor in one stretch only is dropped: its
    windows occur nowhere else.  A stretch that a smaller document has as well
    is a repeat as a whole.  The first document of each of several different
    stretches around one anchor is asked for the stretch itself.
2.  The documents answer with those stretches, which go to a shard by anchor
    hash; stretches around an anchor with very many variants go there window by
    window, by the window's hash, so no anchor makes a large shard.  Of one
    window, a group of documents sends its least document's only and marks the
    others' itself.  Those of some groups are thinned once more in between, about
    the square root of all groups at a time, so a hot window costs no task more
    rows than that root.
3.  The resolver marks, among a shard's stretches, the windows that a document
    with a smaller id has too.  Marks go back to the documents.

Equal stretches inside one task are thinned to the smallest document before
anything is shuffled, so large groups of copies do not gather in one bucket.
Texts move in one shuffle, which both uses of them share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HASH_SLICE_BYTES, one_row_per_doc, slices
from .hashing import BYTE_CODES, Anchors, U, mix, prefix_sums, span_hash, text_bytes, word_codes, word_spans

#: Text bytes per bucket of hashes, per shard of stretches and documents per group.
BUCKET_BYTES = 8 << 20
SHARD_BYTES = 1 << 20
GROUP_DOCS = 256
GROUP_BYTES = 2 << 20
#: An anchor with more different stretches than this is resolved window by window;
#: up to it, an anchor's stretches fill no more than a shard.
MANY = 1 << 14
#: Codes compared at once.
WINDOW_SLICE = 1 << 20

REPEAT, ASK, ASK_SPLIT = 1, 2, 3
#: What a row of stretches holds: marks, or stretches to resolve (under keys below zero: single windows, to thin first).
MARKED, ASKED = 0, 1
PACKED = "key long, kind int, docs binary, a binary, b binary"
STRETCHES = "shard long, grp long, kind int, docs binary, texts binary, starts binary, counts binary, codes binary"
MARKS = "grp long, docs binary, texts binary, starts binary, counts binary"


@dataclass(frozen=True)
class Units:
    """What a window is made of: ``width`` bytes or words, anchored by ``k`` of them."""

    width: int
    k: int
    words: bool

    def codes(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all rows end to end, and row offsets."""
        raw, offsets = text_bytes(column)
        if not self.words:
            return raw, offsets
        start, end, rows = word_spans(raw, offsets)
        return word_codes(raw, start, end), rows

    def hashable(self, codes: np.ndarray) -> np.ndarray:
        return codes if self.words else BYTE_CODES[codes]

    @property
    def dtype(self):
        return np.dtype("<u8") if self.words else np.dtype("u1")


def group_of(docs: np.ndarray, groups: int) -> np.ndarray:
    """Group of each document, as ``group_column`` has it."""
    docs = docs.astype(np.int64)
    return (docs ^ (docs >> 17) ^ (docs >> 33)) % groups


def group_column(groups: int):
    own = F.col("doc_id")
    return F.pmod(own.bitwiseXOR(F.shiftright(own, 17)).bitwiseXOR(F.shiftright(own, 33)), F.lit(groups).cast("long"))


def reply_id(anchor: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Names an anchored stretch in messages: 24 bits of the anchor, 40 of the stretch."""
    return (anchor << U(40)) | (span & U((1 << 40) - 1))


def cut(values: np.ndarray, size: int) -> bytes:
    """The low ``size`` bytes of 64-bit values."""
    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def uncut(data: bytes, size: int) -> np.ndarray:
    n = len(data) // size
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8).reshape(n, size)
    return out.reshape(-1).view("<u8").astype(U)


def runs(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(key, start, end) of each run of equal keys."""
    if len(keys):
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        for s, e in zip(at.tolist(), [*at[1:].tolist(), len(keys)], strict=True):
            yield int(keys[s]), s, e


def batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


PACKED_ARROW = pa.schema([("key", pa.int64()), ("kind", pa.int32()), ("docs", pa.binary()), ("a", pa.binary()), ("b", pa.binary())])
STRETCHES_ARROW = pa.schema(
    [("shard", pa.int64()), ("grp", pa.int64()), ("kind", pa.int32()), *((n, pa.binary()) for n in ("docs", "texts", "starts", "counts", "codes"))]
)
MARKS_ARROW = pa.schema([("grp", pa.int64()), *((n, pa.binary()) for n in ("docs", "texts", "starts", "counts"))])


def replies(docs: np.ndarray, ids: np.ndarray, flags: np.ndarray, groups: int) -> list[tuple]:
    """Message rows to the documents' groups."""
    grp = group_of(docs, groups)
    order = np.argsort(grp, kind="stable")
    return [(g, 1, docs[i].tobytes(), ids[i].tobytes(), flags[i].tobytes()) for g, s, e in runs(grp[order]) for i in (order[s:e],)]


def anchors_of(units: Units, column: pa.Array) -> tuple[Anchors, np.ndarray, np.ndarray, np.ndarray]:
    codes, offsets = units.codes(column)
    hashable = units.hashable(codes)
    return Anchors(hashable, offsets, units.width, units.k), codes, offsets, hashable


def announce(docs: DataFrame, units: Units, buckets: int, groups: int) -> DataFrame:
    """Step 1, before the shuffle: packed hashes by bucket, and repeats seen at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=HASH_SLICE_BYTES):
            found = anchors_of(units, part.column("text"))[0]
            if not len(found.row):
                continue
            docs = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)[found.row]
            anchor, span = found.anchor_hash & U((1 << 48) - 1), found.span & U((1 << 40) - 1)
            order = np.lexsort((docs, span, anchor))
            docs, anchor, span = docs[order], anchor[order], span[order]
            new = np.ones(len(docs), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (span[1:] != span[:-1])
            once = new.copy()
            once[1:] |= docs[1:] != docs[:-1]
            later = once & ~new
            out = replies(docs[later], reply_id(anchor[later], span[later]), np.full(int(later.sum()), REPEAT, np.uint8), groups) if later.any() else []
            out = [(-1 - r[0], *r[1:]) for r in out]  # negative keys: to pass through the bucket stage
            docs, anchor, span = docs[new], anchor[new], span[new]
            bucket = (anchor % U(buckets)).astype(np.int64)
            order = np.lexsort((docs, bucket))
            docs, anchor, span, bucket = docs[order], anchor[order], span[order], bucket[order]
            for b, s, e in runs(bucket):
                steps = np.diff(docs[s:e], prepend=0)
                packed = steps.astype("<u4").tobytes() if steps[0] >= 0 and steps.max() < 1 << 32 else b""
                out.append((b, 0 if packed else 2, packed or docs[s:e].astype("<i8").tobytes(), cut(anchor[s:e], 6), cut(span[s:e], 5)))
            yield batch(PACKED_ARROW, out)

    return docs.mapInArrow(run, PACKED)


def weigh(groups: int, many: int) -> Callable[[pa.Table], pa.Table]:
    """Step 1, after the shuffle: what becomes of each stretch in a bucket."""

    def run(rows: pa.Table) -> pa.Table:
        kinds = rows.column("kind").to_pylist()
        if kinds and kinds[0] == 1:
            key = pa.array([-1 - k for k in rows.column("key").to_pylist()], pa.int64())
            return rows.set_column(0, "key", key)
        docs, anchor, span = [], [], []
        for kind, d, a, b in zip(kinds, *(rows.column(c).to_pylist() for c in ("docs", "a", "b")), strict=True):
            docs.append(np.cumsum(np.frombuffer(d, "<u4").astype(np.int64)) if kind == 0 else np.frombuffer(d, "<i8"))
            anchor.append(uncut(a, 6))
            span.append(uncut(b, 5))
        docs, anchor, span = np.concatenate(docs), np.concatenate(anchor), np.concatenate(span)
        order = np.lexsort((docs, span, anchor))
        docs, anchor, span = docs[order], anchor[order], span[order]
        new_anchor = np.ones(len(docs), bool)
        new_anchor[1:] = anchor[1:] != anchor[:-1]
        new = new_anchor.copy()
        new[1:] |= span[1:] != span[:-1]
        # how many different stretches each anchor has, and the first document of each stretch
        of_anchor = np.cumsum(new_anchor) - 1
        variants = np.bincount(of_anchor[new])[of_anchor]
        first = docs[np.flatnonzero(new)][np.cumsum(new) - 1]
        flags = np.where(docs > first, REPEAT, np.where(variants > many, ASK_SPLIT, np.where(variants > 1, ASK, 0))).astype(np.uint8)
        some = flags > 0
        return pa.Table.from_batches([batch(PACKED_ARROW, replies(docs[some], reply_id(anchor[some], span[some]), flags[some], groups))], PACKED_ARROW)

    return run


def joined(rows: pa.Table, names: tuple[str, ...], types: tuple) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(rows.column(n).to_pylist()), t) for n, t in zip(names, types, strict=True)]


def repeated_later(codes: np.ndarray, at: np.ndarray, width: int, window: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Which windows a smaller one of ``docs`` has too; equal hashes are compared code by code."""
    later = np.zeros(len(at), bool)
    if not len(at):
        return later
    order = np.lexsort((docs, window))
    new = np.ones(len(at), bool)
    new[1:] = window[order][1:] != window[order][:-1]
    first = order[np.flatnonzero(new)][np.cumsum(new) - 1]  # the least document's
    more = docs[order] > docs[first]
    order, first = order[more], first[more]
    step = max(1, WINDOW_SLICE // width)
    for s in range(0, len(order), step):
        a, b = order[s : s + step], first[s : s + step]
        places = np.arange(width)
        later[a] = (codes[at[a][:, None] + places] == codes[at[b][:, None] + places]).all(axis=1)
    return later


def thinning_key(window: np.ndarray, grp: np.ndarray | int, groups: int, shards: int) -> np.ndarray:
    """Where windows of some groups are thinned: below zero, no more keys than shards or groups' root."""
    salts = isqrt(groups) + 1
    part = (window % U(shards // salts + 1)).astype(np.int64)
    return -1 - part * salts - grp % salts


def answer(units: Units, shards: int, groups: int = 1) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Step 2: a group of documents reads its messages and sends stretches and marks."""

    def run(own: pa.Table, mail: pa.Table) -> pa.Table:
        if not own.num_rows or not mail.num_rows:
            return STRETCHES_ARROW.empty_table()
        grp = own.column("grp")[0].as_py()
        to, ids, flags = joined(mail, ("docs", "a", "b"), ("<i8", "<u8", "u1"))
        found, codes, offsets, _ = anchors_of(units, own.column("text"))
        if not len(found.row):
            return STRETCHES_ARROW.empty_table()
        doc_ids = own.column("doc_id").to_numpy().astype(np.int64)
        docs = doc_ids[found.row]
        content = span_hash(found.sums, offsets[:-1], offsets[1:])[found.row]
        starts = found.first - offsets[found.row]
        # messages by (document, stretch)
        wanted = mix(docs.view(U)) ^ reply_id(found.anchor_hash & U((1 << 48) - 1), found.span)
        keys = mix(to.astype(np.int64).view(U)) ^ ids.astype(U)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        flag = np.where(keys[at] == wanted, flags[order][at], 0)
        out = []
        hit = np.flatnonzero(flag == REPEAT)
        if len(hit):
            out.append((grp % shards, grp, MARKED, *(x[hit].astype("<i8").tobytes() for x in (docs, content.view(np.int64), starts, found.count)), b""))
        ask = np.flatnonzero(flag == ASK)
        shard, first, count = (found.anchor_hash[ask] % U(shards)).astype(np.int64), found.first[ask], found.count[ask]
        split = np.flatnonzero(flag == ASK_SPLIT)
        if len(split):
            many = found.count[split]
            split = np.repeat(split, many)
            one = found.first[split] + (np.arange(len(split)) - np.repeat(np.cumsum(many) - many, many))
            window = span_hash(found.sums, one, one + units.width)
            # a window that a smaller document of the group has too is marked here, and its least document asks for all
            later = repeated_later(codes, one, units.width, window, docs[split])
            if later.any():
                i = split[later]
                fields = (docs[i], content[i].view(np.int64), one[later] - offsets[found.row[i]], np.ones(len(i), np.int64))
                out.append((grp % shards, grp, MARKED, *(x.astype("<i8").tobytes() for x in fields), b""))
                split, one, window = split[~later], one[~later], window[~later]
            shard = np.concatenate([shard, thinning_key(window, grp, groups, shards)])
            first, count, ask = np.concatenate([first, one]), np.concatenate([count, np.ones(len(one), np.int64)]), np.concatenate([ask, split])
        order = np.argsort(shard, kind="stable")
        row = found.row
        for key, s, e in runs(shard[order]):
            i = order[s:e]
            which = ask[i]
            begin, size = first[i], count[i] - 1 + units.width
            at = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            place = begin - offsets[row[which]]
            fields = (docs[which], content[which].view(np.int64), place, count[i])
            out.append((key, grp, ASKED, *(x.astype("<i8").tobytes() for x in fields), codes[at].astype(units.dtype).tobytes()))
        return pa.Table.from_batches([batch(STRETCHES_ARROW, out)], STRETCHES_ARROW)

    return run


#: codes end to end, stretch offsets, documents, windows per stretch -> one flag per window, end to end
Resolver = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]


def resolve(units: Units, resolver: Resolver) -> Callable[[pa.Table], pa.Table]:
    """Step 3: marks from a shard's stretches; marks already known pass through."""

    def run(rows: pa.Table) -> pa.Table:
        kinds = np.array(rows.column("kind").to_pylist())
        names = ("docs", "texts", "starts", "counts")
        known = rows.filter(pa.array(kinds == MARKED)).select(["grp", *names]).cast(MARKS_ARROW)
        asked = rows.filter(pa.array(kinds == ASKED))
        if not asked.num_rows:
            return known
        docs, content, starts, counts = joined(asked, names, ("<i8",) * 4)
        sizes = [len(x) // 8 for x in asked.column("docs").to_pylist()]
        grp = np.repeat(np.array(asked.column("grp").to_pylist(), np.int64), sizes)
        codes = np.frombuffer(b"".join(asked.column("codes").to_pylist()), units.dtype)
        offsets = np.concatenate([[0], np.cumsum(counts - 1 + units.width)])
        flags = resolver(codes, offsets, docs, counts, units.width)
        # runs of flagged windows, in one stretch each
        of = np.repeat(np.arange(len(counts)), counts)
        begin = np.concatenate([[0], np.cumsum(counts)[:-1]])
        hit = np.flatnonzero(flags)
        if not len(hit):
            return known
        new = np.ones(len(hit), bool)
        new[1:] = (hit[1:] != hit[:-1] + 1) | (of[hit[1:]] != of[hit[:-1]])
        first = hit[new]
        many = np.diff(np.append(np.flatnonzero(new), len(hit)))
        s = of[first]
        fields = (docs[s], content[s], starts[s] + first - begin[s], many)
        order = np.argsort(grp[s], kind="stable")
        out = [(g, *(x[order[a:b]].astype("<i8").tobytes() for x in fields)) for g, a, b in runs(grp[s][order])]
        return pa.concat_tables([known, pa.Table.from_batches([batch(MARKS_ARROW, out)], MARKS_ARROW)])

    return run


def thin(units: Units, resolver: Resolver, shards: int) -> Callable[[pa.Table], pa.Table]:
    """Step 3 for all but single windows; of those, each one's least document goes on, to the window's shard."""
    settle = resolve(units, resolver)
    names = ("docs", "texts", "starts")

    def run(rows: pa.Table) -> pa.Table:
        if rows.column("shard")[0].as_py() >= 0:
            marks = settle(rows).to_pylist()
            out = [(m["grp"] % shards, m["grp"], MARKED, m["docs"], m["texts"], m["starts"], m["counts"], b"") for m in marks]
            return pa.Table.from_batches([batch(STRETCHES_ARROW, out)], STRETCHES_ARROW)
        fields = joined(rows, names, ("<i8",) * 3)
        sizes = [len(x) // 8 for x in rows.column("docs").to_pylist()]
        grp = np.repeat(np.array(rows.column("grp").to_pylist(), np.int64), sizes)
        codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), units.dtype)
        at = np.arange(len(grp)) * units.width
        window = span_hash(prefix_sums(units.hashable(codes)), at, at + units.width)
        later = repeated_later(codes, at, units.width, window, fields[0])
        shard = np.where(later, grp % shards, (window % U(shards)).astype(np.int64))
        order = np.lexsort((grp, shard, later))
        flat = codes.reshape(-1, units.width)
        out = []
        for _, s, e in runs(((shard * 2 + later) * (int(grp.max()) + 1) + grp)[order]):
            i = order[s:e]
            kind = MARKED if later[i[0]] else ASKED
            ones = np.ones(len(i), "<i8").tobytes()
            out.append((int(shard[i[0]]), int(grp[i[0]]), kind, *(x[i].tobytes() for x in fields), ones, b"" if kind == MARKED else flat[i].tobytes()))
        return pa.Table.from_batches([batch(STRETCHES_ARROW, out)], STRETCHES_ARROW)

    return run


def covered(codes: np.ndarray, offsets: np.ndarray, doc_ids: np.ndarray, content: np.ndarray, marks: pa.Table, width: int) -> np.ndarray:
    """Whether each code of a group of documents lies under a marked window."""
    docs, texts, starts, counts = joined(marks, ("docs", "texts", "starts", "counts"), ("<i8",) * 4)
    delta = np.zeros(len(codes) + 1, np.int32)
    if len(docs):
        # marks name a document and its content; repeated rows get the same marks
        keys = mix(doc_ids.view(U)) ^ content
        of_mark = mix(docs.astype(np.int64).view(U)) ^ texts.astype(np.int64).view(U)
        order = np.argsort(of_mark, kind="stable")
        ranked = of_mark[order]
        low, high = np.searchsorted(ranked, keys), np.searchsorted(ranked, keys, "right")
        size = high - low
        row = np.repeat(np.arange(len(keys)), size)
        mark = order[np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())]
        at = offsets[row] + starts[mark]
        np.add.at(delta, at, 1)
        np.add.at(delta, at + counts[mark] - 1 + width, -1)
    return np.cumsum(delta[:-1]) > 0


Finisher = Callable[[pa.Table, np.ndarray, np.ndarray, np.ndarray], pa.Table]


def finish(units: Units, finisher: Finisher) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(own: pa.Table, marks: pa.Table) -> pa.Table:
        codes, offsets = units.codes(own.column("text"))
        sums = Anchors(units.hashable(codes), offsets, len(codes) + 1, 1).sums
        content = span_hash(sums, offsets[:-1], offsets[1:])
        doc_ids = own.column("doc_id").to_numpy().astype(np.int64)
        return finisher(own, codes, offsets, covered(codes, offsets, doc_ids, content, marks, units.width))

    return run


def remove_repeats(docs: DataFrame, units: Units, resolver: Resolver, finisher: Finisher, result: str, carried: bool = False) -> DataFrame:
    """One result row for each row of ``docs`` with an id; see the module's text.

    With ``carried`` the finisher also sees the other columns, as ``c0``, ``c1``, ...
    """
    own = one_row_per_doc(docs).where(F.col("doc_id").isNotNull())
    size = own.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    groups = int(max(1, size["n"] // GROUP_DOCS, size["bytes"] // GROUP_BYTES)) | 1
    buckets = int(max(8, size["bytes"] // BUCKET_BYTES))
    shards = int(max(8, size["bytes"] // SHARD_BYTES))
    full = docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(other_columns(docs) if carried else [])),
    )
    grouped = full.withColumn("grp", group_column(groups))
    mail = announce(own, units, buckets, groups).groupBy("key").applyInArrow(weigh(groups, MANY), PACKED).withColumnRenamed("key", "grp")
    sent = grouped.groupBy("grp").cogroup(mail.groupBy("grp")).applyInArrow(answer(units, shards, groups), STRETCHES)
    thinned = sent.groupBy("shard").applyInArrow(thin(units, resolver, shards), STRETCHES)
    marks = thinned.groupBy("shard").applyInArrow(resolve(units, resolver), MARKS)
    return grouped.groupBy("grp").cogroup(marks.groupBy("grp")).applyInArrow(finish(units, finisher), result)


def other_columns(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c.lower() not in ("doc_id", "text")]


def with_text(own: pa.Table, texts: list[str]) -> pa.Table:
    """A finisher's table: the documents with other texts, and what they carry."""
    kept = [n for n in own.column_names if n not in ("text", "grp")]
    return own.select(kept).add_column(1, "text", pa.array(texts, pa.string()))


def rewritten(docs: DataFrame, units: Units, resolver: Resolver, finisher: Finisher) -> DataFrame:
    """``docs`` with the texts that ``finisher`` leaves; rows without an id stay as they are."""
    names = other_columns(docs)
    types = dict(docs.dtypes)
    schema = ", ".join(["doc_id long", "text string", *(f"c{i} {types[c]}" for i, c in enumerate(names))])
    out = remove_repeats(docs, units, resolver, finisher, schema, carried=True)
    own = {c: f"c{i}" for i, c in enumerate(names)}
    out = out.select(*(F.col(own.get(c, c.lower())).alias(c) for c in docs.columns))
    return out.unionByName(docs.where(F.col("doc_id").isNull()).select(*(F.col(f"`{c}`").cast(t).alias(c) for c, t in out.dtypes)))
