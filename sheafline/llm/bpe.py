"""Byte-level BPE encoding and decoding (operator 6).

Each pre-token's bytes form a doubly linked list of symbols.  A heap holds
``(merge rank, position, left id, right id)``; a popped entry is stale, and
skipped, when the symbols now at that position differ from those it was pushed
for.  Merging two symbols relinks the list and pushes the at most two pairs
that it creates.  Decoding concatenates the vocabulary's byte strings.

The vocabulary file is a parameter and is read once per Python worker; it is
fixed in size and does not grow with the corpus.  Encoded pre-tokens are kept
in a cache of bounded size that is emptied when it is full, so memory does not
follow the number of distinct words.

Null and empty texts have no tokens.  Text that spells an added token gets
that token's id, as the tokenizers library does.  Repeated rows give repeated
results; rows keep no order.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import one_row_per_doc, slices

#: Pre-tokens kept per Python worker.
CACHE_WORDS = 250_000

#: Fixed value: the public byte-level pre-tokenizer's pattern.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary.

    Printable Latin-1 characters stand for themselves; the other bytes take
    the code points from 256 on, in order.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class ByteBpe:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        to_byte = {c: b for b, c in alphabet.items()}
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = 1 + max([*vocab.values(), *self.added.values()])
        self.spelling: list[bytes] = [b""] * size
        for token, k in vocab.items():
            self.spelling[k] = bytes(to_byte[c] for c in token)
        for token, k in self.added.items():
            self.spelling[k] = token.encode()
        self.of_byte = [vocab[alphabet[b]] for b in range(256)]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merge[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.pattern = regex.compile(PRE_TOKEN)
        names = sorted(self.added, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.cache: dict[str, tuple[int, ...]] = {}

    def merged(self, data: bytes) -> tuple[int, ...]:
        """Merge one pre-token's bytes by rank, leftmost first among equals."""
        ids = [self.of_byte[b] for b in data]
        n = len(ids)
        if n < 2:
            return tuple(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        after[-1] = -1
        merge, heap = self.merge, []
        for i in range(n - 1):
            if found := merge.get((ids[i], ids[i + 1])):
                heap.append((found[0], i, ids[i], ids[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue  # stale: a neighbour has merged meanwhile
            new = ids[i] = merge[left, right][1]
            ids[j] = -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if found := merge.get((new, ids[k])):
                    heapq.heappush(heap, (found[0], i, new, ids[k]))
            if (h := before[i]) >= 0 and (found := merge.get((ids[h], new))):
                heapq.heappush(heap, (found[0], h, ids[h], new))
        return tuple(k for k in ids if k >= 0)

    def _word(self, word: str) -> tuple[int, ...]:
        if len(self.cache) >= CACHE_WORDS:
            self.cache.clear()
        out = self.cache[word] = self.merged(word.encode())
        return out

    def _plain(self, text: str, out: list[int]) -> None:
        known = self.cache.get
        for word in self.pattern.findall(text) if settled(text) else self._cut(text):
            out.extend(known(word) or self._word(word))

    def _cut(self, text: str) -> list[str]:
        """Pre-tokens of a text with characters that libraries class by different Unicode versions.

        Such a character is split like a letter, a digit or neither, as the tokenizers library has it.
        """
        stands = {ord(c): library_class(c) for c in set(text) if unicodedata.category(c) == "Cn"}
        return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(stands))]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        if self.special is None or not any(map(text.__contains__, self.added)):
            self._plain(text, out)
            return out
        for part in self.special.split(text):
            if part in self.added:
                out.append(self.added[part])
            elif part:
                self._plain(part, out)
        return out

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.spelling.__getitem__, ids))

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


def settled(text: str) -> bool:
    """Whether all libraries class the text's characters alike."""
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return not any(unicodedata.category(c) == "Cn" for c in set(text))


@lru_cache(maxsize=4096)
def library_class(char: str) -> str:
    """A letter, a digit or a private character that is split as ``char`` is."""
    from tokenizers import Regex, pre_tokenizers

    for pattern, stand in ((r"\p{L}", "z"), (r"\p{N}", "0")):
        if pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(char):
            return stand
    return "\U000f0000"


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode_decode(docs: DataFrame, vocab_path: str) -> DataFrame:
    """Per document: token count and digests of its ids and of their decoding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocab_path)
        for part in slices(batches):
            counts, ids_hex, text_hex = [], [], []
            for text in part.column("text").to_pylist():
                ids = bpe.encode(text or "")
                counts.append(len(ids))
                ids_hex.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                text_hex.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_hex), pa.array(text_hex)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        bpe.cache.clear()  # Python workers live on after a task

    return one_row_per_doc(docs).mapInArrow(run, RESULT)


def encode(docs: DataFrame, vocab_path: str) -> DataFrame:
    """The operator's own output: ``doc_id, ids`` (array of int)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocab_path)
        for part in slices(batches):
            ids = [bpe.encode(t or "") for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])
        bpe.cache.clear()

    return one_row_per_doc(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, vocab_path: str) -> DataFrame:
    """``doc_id, ids`` to ``doc_id, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocab_path)
        for part in batches:
            texts = [bpe.decode(i or ()) for i in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
