"""Substring dedup by relative Lempel-Ziv parsing (operator 7).

A word goes when a window of 13 words that covers it also starts in a document
with a smaller id.  ``windows.remove_repeats`` deals the stretches of text that
can hold such windows to shards; a shard is one reference block.  Its stretches
are taken by document id, and each is greedily factored against the stretches
of the smaller documents that the block has indexed so far: at a word whose
13-word window the index knows, the factor runs on as long as the words go on
equalling the reference, and else the word is a literal.  The windows inside a
factor are duplicate spans.  The windows across a factor's end begin inside it
and are looked up in turn: the parse takes up again at the first of them, not
at the factor's end.

Null and empty texts have no words.  Documents under 13 words lose nothing.
Rows with the same id never match each other; each gives a row.  Rows without
an id are left out.  Matches never cross documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .hashing import gram_hash, prefix_sums
from .windows import Units, remove_repeats, rewritten, with_text

WIDTH = 13
ANCHOR = 5
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
UNITS = Units(WIDTH, ANCHOR, words=True)


def factors(windows: list[int], words: list[int], index: dict[int, int], block: list[int], width: int) -> list[tuple[int, int, int]]:
    """Long factors of one stretch: (first window, place in the block, words).

    ``index`` has a place in ``block``, the reference's words, by window hash.
    """
    out = []
    i, n = 0, len(windows)
    known = index.get
    while i < n:
        place = known(windows[i])
        if place is None:
            i += 1  # a literal
            continue
        size, most = 0, min(len(words) - i, len(block) - place)
        while size < most and words[i + size] == block[place + size]:
            size += 1
        if size < width:  # other words under the same hash
            i += 1
            continue
        out.append((i, place, size))
        i += size - width + 1
    return out


def mark_factors(codes: np.ndarray, offsets: np.ndarray, docs: np.ndarray, counts: np.ndarray, width: int) -> np.ndarray:
    """A block's resolver: windows in factors of the smaller documents' text."""
    windows = gram_hash(prefix_sums(codes), width)
    flags = np.zeros(int(counts.sum()), bool)
    begin = np.cumsum(counts) - counts
    index: dict[int, int] = {}
    block: list[int] = []
    pending: list[tuple[list[int], int]] = []
    last = None
    for k in np.argsort(docs, kind="stable").tolist():
        if docs[k] != last:
            # what came before is of smaller documents now: index it
            for own, place in pending:
                for i, w in enumerate(own):
                    index.setdefault(w, place + i)
            pending.clear()
            last = docs[k]
        s, e, c = int(offsets[k]), int(offsets[k + 1]), int(counts[k])
        words, own = codes[s:e].tolist(), windows[s : s + c].tolist()
        for i, _, size in factors(own, words, index, block, width):
            flags[begin[k] + i : begin[k] + min(i + size - width + 1, c)] = True
        pending.append((own, len(block)))
        block.extend(words)
        block.append(-1)  # no factor runs past its stretch
    return flags


def kept_words(own: pa.Table, offsets: np.ndarray, gone: np.ndarray) -> list[bytes]:
    out = []
    for text, s, e in zip(own.column("text").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        words = (text or "").encode().split()
        drop = gone[s:e]
        out.append(b" ".join([w for w, d in zip(words, drop.tolist(), strict=True) if not d] if drop.any() else words))
    return out


def digests(own: pa.Table, codes: np.ndarray, offsets: np.ndarray, gone: np.ndarray) -> pa.Table:
    total = np.concatenate([[0], np.cumsum(gone)])
    removed = total[offsets[1:]] - total[offsets[:-1]]
    shas = [hashlib.sha256(x).hexdigest() for x in kept_words(own, offsets, gone)]
    return pa.table([own.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(removed, pa.int64()), pa.array(shas)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def kept_texts(own: pa.Table, codes: np.ndarray, offsets: np.ndarray, gone: np.ndarray) -> pa.Table:
    return with_text(own, [x.decode() for x in kept_words(own, offsets, gone)])


def removed(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs, UNITS, mark_factors, digests, RESULT)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The operator's own output: the documents with their remaining words."""
    return rewritten(docs, UNITS, mark_factors, kept_texts)
