"""Vectorised hashing of symbol sequences, and anchors chosen by it.

A sequence of codes gets a prefix sum of ``code * BASE**i`` modulo 2**64, from
which the hash of any span follows by a subtraction and a multiplication.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
_powers = {"up": np.ones(1, U), "down": np.ones(1, U)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below n, kept for the next call."""
    if len(_powers["up"]) < n:
        size = n + n // 4
        for name, base in (("up", BASE), ("down", INVERSE)):
            line = np.full(size, base, U)
            line[0] = 1
            _powers[name] = np.multiply.accumulate(line)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over all output bits."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE_CODES = mix(np.arange(1, 257, dtype=U))


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(codes) + 1, U)
    np.cumsum(codes * powers(len(codes) + 1)[0][: len(codes)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span [start, end) of the codes; its length counts too."""
    raw = (sums[end] - sums[start]) * powers(len(sums))[1][start]
    return mix(raw + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def gram_hash(sums: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k codes."""
    n = len(sums) - k
    if n <= 0:
        return np.zeros(0, U)
    raw = sums[k:] - sums[:n]
    raw *= powers(len(sums))[1][:n]
    return mix(raw)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and its row offsets (nulls: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and row offsets counted in words.

    A word ends at white space or at its row's end.
    """
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = offsets[:-1][offsets[:-1] < len(raw)]
    begins[edge] = inside[edge]
    ends = np.zeros(len(raw) + 1, bool)
    ends[1:] = inside
    ends[1:-1] &= ~inside[1:] | begins[1:]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    return start, end, np.searchsorted(start, offsets)


def word_codes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit code for each word."""
    return span_hash(prefix_sums(BYTE_CODES[raw]), start, end)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every run of w values, by doubling."""
    out, size = x, 1
    while 2 * size <= w:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    if size < w:
        rest = w - size
        out = np.minimum(out[:-rest], out[rest:])
    return out


class Anchors:
    """Windows of ``width`` codes, grouped by the anchor that represents them.

    A window's anchor is its run of ``k`` codes with the least hash, the first
    among equals, so equal windows have equal anchors at equal places in them.
    For each anchor and row: the row, the first window it represents, how many
    follow in one run, the anchor's hash and that of all codes under the windows.
    """

    HIGH = U(0xFFFFFFFF00000000)
    LOW = U(0x00000000FFFFFFFF)

    def __init__(self, codes: np.ndarray, offsets: np.ndarray, width: int, k: int):
        self.sums = sums = prefix_sums(codes)
        n = len(codes)
        empty = np.zeros(0, np.int64)
        self.row, self.first, self.count = empty, empty, empty
        self.anchor_hash = self.span = np.zeros(0, U)
        if n < width:
            return
        grams = gram_hash(sums, k)
        key = (grams & self.HIGH) | np.arange(len(grams), dtype=U)
        least = sliding_min(key, width - k + 1)
        valid = np.zeros(n + 2, np.int8)
        begin, last = offsets[:-1], offsets[1:] - width + 1
        some = last > begin
        valid[begin[some]] += 1
        valid[last[some]] -= 1
        at = np.flatnonzero(np.cumsum(valid[: n - width + 1], dtype=np.int8))
        if not len(at):
            return
        anchor = (least[at] & self.LOW).astype(np.int64)
        row = np.repeat(np.flatnonzero(some), (last - begin)[some])
        new = np.ones(len(at), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
        where = np.flatnonzero(new)
        self.row, self.first = row[where], at[where]
        self.count = np.diff(np.append(where, len(at)))
        self.anchor_hash = grams[anchor[where]]
        self.span = span_hash(sums, self.first, self.first + self.count - 1 + width)
