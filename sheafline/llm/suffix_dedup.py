"""Substring dedup by suffix arrays (operator 2).

A byte goes when a 50-byte string that covers it also starts in a document with
a smaller id.  ``windows.remove_repeats`` deals the stretches of text that can
hold such strings to shards, by the anchors in them, so equal 50-byte strings
always meet in one shard and shards need no common order.  Each shard is
suffix-sorted by the difference-cover algorithm (modulo 3): the triples at
positions 1 and 2 modulo 3 are sorted and named, names that are not yet unique
are sorted by recursion, the suffixes at positions 0 modulo 3 follow from their
first byte and the rank after it, and the two sorted lists are merged.  Runs of
neighbours in that order which share 50 bytes are the repeats; all but those of
the smallest document are marked.

Sorting all suffixes of the corpus in one distributed order would move each
byte's suffix through several shuffles, some 20 bytes per byte and pass; the
shards hold only what can repeat.

Null and empty texts have 0 bytes and the digest of nothing.  Documents under
50 bytes lose nothing.  Rows with the same id never match each other; each
gives a row.  Rows without an id are left out.  Matches never cross documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .windows import Units, remove_repeats, rewritten, with_text

WIDTH = 50
ANCHOR = 20
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def sort_names(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by several keys (first one leading), and their names from 1 on."""
    if len(keys) == 1:
        order = np.argsort(keys[0])
    else:
        order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        ranked = k[order]
        new[1:] |= ranked[1:] != ranked[:-1]
    names = np.empty(len(order), np.int64)
    names[order] = np.cumsum(new) + 1
    return order, names


def suffix_array(symbols: np.ndarray, wanted: np.ndarray | None = None) -> np.ndarray:
    """Starts of all suffixes, or of the wanted ones, in sorted order.

    Symbols are integers from 1 on; ``wanted`` is a flag for each position.
    """
    n = len(symbols)
    if n < 3:
        return np.array(sorted((i for i in range(n) if wanted is None or wanted[i]), key=lambda i: symbols[i:].tolist()), np.int64)
    t = np.concatenate([symbols.astype(np.int64), [0, 0, 0]])
    top = int(t.max()) + 1
    # the difference cover {1, 2}: positions 1 mod 3, then those 2 mod 3
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    if top < 1 << 21:
        keys = [(t[sample] * top + t[sample + 1]) * top + t[sample + 2]]
    else:
        keys = [t[sample], t[sample + 1], t[sample + 2]]
    order, names = sort_names(keys)
    if names.max(initial=0) < len(sample):
        order = suffix_array(names)
        names = np.empty(len(sample), np.int64)
        names[order] = np.arange(1, len(sample) + 1)
    sorted_sample = sample[order]
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = names
    if n % 3 == 1:  # the position just past the end only served as a mark
        sorted_sample = sorted_sample[sorted_sample < n]
    zeros = np.arange(0, n, 3)
    if wanted is not None:
        zeros, sorted_sample = zeros[wanted[zeros]], sorted_sample[wanted[sorted_sample]]
    zeros = zeros[np.argsort(t[zeros] * (n + 3) + rank[zeros + 1])]
    # merge: how many samples of either kind come before each suffix 0 mod 3
    of_ones = sorted_sample[sorted_sample % 3 == 1]
    of_twos = sorted_sample[sorted_sample % 3 == 2]
    before = np.searchsorted(t[of_ones] * (n + 3) + rank[of_ones + 1], t[zeros] * (n + 3) + rank[zeros + 1])
    if top * top * (n + 3) < 1 << 63:
        key = lambda i: (t[i] * top + t[i + 1]) * (n + 3) + rank[i + 2]
        before += np.searchsorted(key(of_twos), key(zeros))
    else:  # the key would not fit: sort both kinds together
        both = np.concatenate([of_twos, zeros])
        order = np.lexsort((rank[both + 2], t[both + 1], t[both]))
        two = order < len(of_twos)
        before[order[~two] - len(of_twos)] += np.cumsum(two)[~two]
    out = np.empty(len(zeros) + len(sorted_sample), np.int64)
    place = np.arange(len(zeros)) + before
    taken = np.zeros(len(out), bool)
    taken[place] = True
    out[place] = zeros
    out[~taken] = sorted_sample
    return out


def same_prefix(codes: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """Whether the ``width`` bytes from a and from b are equal, eight at a time."""
    wide = np.zeros(len(codes) + 8, np.uint64)
    wide[: len(codes)] = codes
    for k in (1, 2, 4):
        wide[:-k] |= wide[k:] << np.uint64(8 * k)
    out = np.ones(len(a), bool)
    for at in [*range(0, width - 7, 8), width - 8]:
        out &= wide[a + at] == wide[b + at]
    return out


def mark_repeats(codes: np.ndarray, offsets: np.ndarray, docs: np.ndarray, counts: np.ndarray, width: int) -> np.ndarray:
    """A shard's resolver: windows that also start in a smaller document."""
    # a zero after each stretch ends it: bytes count from 1
    at = np.arange(len(codes)) + np.repeat(np.arange(len(docs)), np.diff(offsets))
    symbols = np.zeros(len(codes) + len(docs), np.int64)
    symbols[at] = codes.astype(np.int64) + 2
    symbols[symbols == 0] = 1
    begin = offsets[:-1] + np.arange(len(docs))
    window = np.full(len(symbols), -1, np.int64)
    of = np.repeat(np.arange(len(docs)), counts)
    nth = np.arange(int(counts.sum()))
    window[begin[of] + nth - (np.cumsum(counts) - counts)[of]] = nth
    order = suffix_array(symbols, window >= 0)
    spread = np.zeros(len(symbols), np.uint8)
    spread[at] = codes
    equal = same_prefix(spread, order[1:], order[:-1], width)
    run = np.concatenate([[0], np.cumsum(~equal)])
    doc = docs[of[window[order]]]
    least = np.minimum.reduceat(doc, np.flatnonzero(np.concatenate([[True], ~equal])))[run]
    out = np.zeros(len(nth), bool)
    out[window[order[doc > least]]] = True
    return out


def digests(own: pa.Table, codes: np.ndarray, offsets: np.ndarray, gone: np.ndarray) -> pa.Table:
    n = np.diff(offsets)
    total = np.concatenate([[0], np.cumsum(gone)])
    removed = total[offsets[1:]] - total[offsets[:-1]]
    starts = gone.copy()
    starts[1:] &= ~gone[:-1]
    edge = offsets[:-1][n > 0]
    starts[edge] = gone[edge]
    spans = np.concatenate([[0], np.cumsum(starts)])
    spans = spans[offsets[1:]] - spans[offsets[:-1]]
    shas = [hashlib.sha256((codes[s:e][~gone[s:e]] if r else codes[s:e]).tobytes()).hexdigest() for s, e, r in zip(offsets[:-1].tolist(), offsets[1:].tolist(), removed.tolist(), strict=True)]
    return pa.table([own.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def kept_texts(own: pa.Table, codes: np.ndarray, offsets: np.ndarray, gone: np.ndarray) -> pa.Table:
    """The remaining bytes as text; a character that lost some of its bytes goes whole."""
    texts = [codes[s:e][~gone[s:e]].tobytes().decode("utf-8", "ignore") for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return with_text(own, texts)


UNITS = Units(WIDTH, ANCHOR, words=False)


def removed(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs, UNITS, mark_repeats, digests, RESULT)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The operator's own output: the documents with their remaining texts."""
    return rewritten(docs, UNITS, mark_repeats, kept_texts)
