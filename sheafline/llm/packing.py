"""Packing documents into sequences of bounded length (operator 9).

Tokenizing runs inside tasks; packing is decided on the *histogram* of piece
lengths.  Pieces of one length are interchangeable, so a plan for at most
``capacity`` lengths is a plan for any number of documents, and its size does
not grow with the corpus.

The plan: pieces over a third of the capacity pair at most twice in a sequence,
by a greedy matching that gives each, longest first, the longest partner that
still fits.  The smaller ones then go, longest first, into the tightest gap that
holds them; new sequences open only where no gap does.  A plan row says "ranks
lo to hi of this length go, one each, to the sequences from seq_base on, at this
offset".  Ranks within a length come from salted windows plus the running sum of
the salts' counts, so a length that a third of all rows share has no hot task.

Null and empty texts are one end token.  Repeated rows are packed as often as
they come (they get ranks of their own).  An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_alphabet, settled
from .common import one_row_per_doc, slices, written

CAPACITY = 2048
END_ID = 0
#: Words, and word pieces, in each half of the cache.
CACHE_WORDS = 150_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLAN = "length long, lo long, hi long, seq_base long, seq_offset long"

#: Fixed value: the public word-level pre-tokenizer's pattern.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Python's str.split() takes these for white space too, the tokenizer does not.
ODD_SPACE = "\x1c\x1d\x1e\x1f"
#: Their lower-case forms depend on the context or have another length.
ODD_CASE = re.compile("[İΣ<]")
#: Punctuation that, after letters only, is one piece of its own.
CLOSING = ".,!?;:*#$%&|"


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordTokenizer:
    """Ids of a text by the tokenizers library, one distinct word piece at a time.

    White space never is part of a token here, and the pattern cuts a word into
    pieces that are merged on their own; both kinds of results are cached.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.model = self.tok.model
        self.letters = {b: c for b, c in byte_alphabet().items() if chr(b) != c}
        self.pattern = regex.compile(PRE_TOKEN)
        self.forget()

    def forget(self) -> None:
        """Empties the caches; Python workers live on after a task."""
        # Young and old halves: what the young half asks the old one for stays.
        self.words, self.old_words = {}, {}
        self.pieces, self.old_pieces = {}, {}

    def library(self, text: str) -> bytes:
        return pack_ids(self.tok.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        """Ids of one cut-out piece: the library's model on its byte letters."""
        if (ids := self.pieces.get(piece) or self.old_pieces.get(piece)) is None:
            spelled = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.letters)
            ids = pack_ids([t.id for t in self.model.tokenize(spelled)])
        if len(self.pieces) >= CACHE_WORDS:
            self.old_pieces, self.pieces = self.pieces, {}
        self.pieces[piece] = ids
        return ids

    def _word(self, word: str) -> bytes:
        """Ids of a word that is not in the young half of the cache."""
        if len(self.words) >= CACHE_WORDS:
            self.old_words, self.words = self.words, {}
        if (out := self.old_words.get(word)) is not None:
            self.words[word] = out
            return out
        core = word.rstrip(CLOSING)
        if core.isalpha() and not ODD_CASE.search(word) and (core.isascii() or unicodedata.is_normalized("NFC", word) and settled(word)):
            out = self._piece(core.lower())
            if len(core) < len(word):
                out += self._piece(word[len(core) :])
        elif ODD_CASE.search(word) or not settled(word):
            out = self.library(word)
        else:
            out = b"".join(map(self._piece, self.pattern.findall(unicodedata.normalize("NFC", word).lower())))
        self.words[word] = out
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if any(map(text.__contains__, ODD_SPACE)):
            return self.library(text)
        known = self.words.get
        return b"".join([known(w) or self._word(w) for w in text.split()])


@lru_cache(maxsize=2)
def load(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def tokenized(docs: DataFrame, vocab_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece; every piece but a document's last is full."""
    end = int(END_ID).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load(vocab_path)
        for part in slices(batches):
            out: list[tuple[int, int, int, int, int]] = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                ids = tok.encode(text or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    piece = ids[at : at + 4 * capacity]
                    out.append((doc_id, k, at // 4, len(piece) // 4, zlib.crc32(piece)))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )
        tok.forget()

    return one_row_per_doc(docs).mapInArrow(run, PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Rows of PLAN from the number of pieces of each length."""
    left = {n: c for n, c in counts.items() if 0 < n <= capacity and c > 0}
    taken: dict[int, int] = {}
    rows: list[tuple[int, int, int, int, int]] = []
    sequences = 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: runs of sequences (first, how many)
    open_gaps: list[int] = []  # sorted

    def put(length: int, first: int, many: int, offset: int) -> None:
        lo = taken.get(length, 0)
        taken[length] = lo + many
        left[length] -= many
        rows.append((length, lo, lo + many, first, offset))

    def gap(size: int, first: int, many: int) -> None:

        if size and many:
            if size not in gaps:
                bisect.insort(open_gaps, size)
                gaps[size] = []
            gaps[size].append((first, many))

    if left.get(capacity):
        n = left[capacity]
        put(capacity, 0, n, 0)
        sequences += n

    # Large pieces: longest first, each with the longest partner that fits.
    large = sorted((n for n in left if capacity // 3 < n < capacity), reverse=True)
    for a in large:
        while left[a]:
            b = next((b for b in large if b <= min(a, capacity - a) and left[b] and (b != a or left[a] > 1)), None)
            if b is None:
                n = left[a]
                put(a, sequences, n, 0)
                gap(capacity - a, sequences, n)
            else:
                n = left[a] // 2 if a == b else min(left[a], left[b])
                put(a, sequences, n, 0)
                put(b, sequences, n, a)
                gap(capacity - a - b, sequences, n)
            sequences += n

    # Small pieces: longest first, each into the tightest gap.

    for s in sorted((n for n in left if n <= capacity // 3), reverse=True):
        while left[s]:
            at = bisect.bisect_left(open_gaps, s)
            if at == len(open_gaps):
                fits = capacity // s
                n = max(1, left[s] // fits)
                gap(capacity, sequences, n)
                sequences += n
                continue
            size = open_gaps[at]
            first, many = gaps[size].pop()
            if not gaps[size]:
                del gaps[size], open_gaps[at]
            fits = min(size // s, left[s])
            n = min(many, left[s] // fits)
            for k in range(fits):
                put(s, first, n, capacity - size + k * s)
            gap(size - fits * s, first, n)
            gap(size, first + n, many - n)
    return rows


def pack(docs: DataFrame, vocab_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its sequence and its place there."""
    spark = docs.sparkSession
    pieces = written(tokenized(docs, vocab_path, capacity), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    rows = plan(counts, capacity)
    salts = max(64, sum(counts.values()) // 20_000)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("local", F.row_number().over(within) - 1)
    before = (
        salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
        .withColumn("skipped", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
        .select("length", "salt", F.coalesce("skipped", F.lit(0)).alias("skipped"))
    )
    numbered = ranked.join(before, ["length", "salt"]).withColumn("rank", F.col("local") + F.col("skipped"))
    where = spark.createDataFrame(rows, PLAN).withColumnRenamed("length", "of_length")
    # The plan's size is bounded by the capacity, not by the corpus.
    here = (F.col("length") == F.col("of_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    return numbered.join(F.broadcast(where), here).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("seq_base") + F.col("rank") - F.col("lo")).alias("sequence_id"), F.col("seq_offset").alias("offset"),
    )
