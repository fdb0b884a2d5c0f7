"""Toxicity scores from subword-bag embeddings (operator 4).

A word is the bag of its hashed character n-grams (3 and 4, with word marks) and
itself; a segment of consecutive words is the average of all their subword
embeddings, on which a linear softmax separates toxic from clean.  Embeddings
and softmax are trained jointly, in numpy, by gradient steps.  Misspelt words
share most n-grams with their originals and so get similar vectors.

Labels mark documents, while few words in them are toxic, so training takes in
each toxic document the segments that the current model finds most toxic, and
for clean ones the segments it wrongly finds most toxic along with random ones.
A document's evidence is its most toxic segment, set off against the number of
segments; a logistic curve over the two turns it into a probability.  It is fit
on labelled documents that the embeddings were not trained on.

Softmax over an average is linear in the subwords up to its last step, so the
scoring tasks get one number per subword bucket: a broadcast of fixed size.

Labels are learnt only from rows whose ``crc32(doc_id) mod 4`` is not 2 and from
at most ``SAMPLE`` labelled documents of each class, chosen by a hash of their
id, without those over ``TRAIN_CHARS`` and up to ``TRAIN_TOTAL`` characters a
class; of rows that repeat an id the least text counts.  Null and empty texts
have no segment and score 0.  Scores depend on the text alone, so repeated rows
score alike.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_mod, kept_rows, one_row_per_doc, py_id_mod, slices

BUCKETS = 1 << 18
WIDTH = 12
GRAMS = (3, 4)
SEGMENT = 12
#: Labelled documents of each class that training may use.
SAMPLE = {1: 2500, 0: 4000}
#: Longest text, in characters, of a document used in training; longer ones are left out of the sample.
TRAIN_CHARS = 48_000
#: Characters of all texts of a class used in training.
TRAIN_TOTAL = 24_000_000
EPOCHS = 6
CUTOFF = 0.3
CACHE_WORDS = 200_000
HELD_OUT = (4, 2)
RESULT = "doc_id long, held_out boolean, score double, predicted int"

EDGES = re.compile(r"^[^\w]+|[^\w]+$")


def subwords(word: str) -> list[int]:
    """Buckets of a word: its n-grams with marks at both ends, and itself."""
    core = EDGES.sub("", word) or word
    text = f"<{core}>"
    if core.isascii():
        marked = text.encode()
        grams = [marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)]
    else:
        grams = [text[i : i + n].encode() for n in GRAMS for i in range(len(text) - n + 1)]
    grams.append(b"=" + core.encode())
    return [h % BUCKETS for h in map(zlib.crc32, grams)]


def segment_starts(n: int) -> np.ndarray:
    """Segments overlap by half; the last one ends with the text."""
    if n <= SEGMENT:
        return np.zeros(min(n, 1), np.int64)
    starts = np.arange(0, n - SEGMENT + 1, SEGMENT // 2)
    return starts if starts[-1] == n - SEGMENT else np.append(starts, n - SEGMENT)


class Trainer:
    """Joint numpy training of bucket embeddings and the softmax on top."""

    def __init__(self, texts: list[str], labels: np.ndarray, seed: int = 7):
        self.rng = np.random.default_rng(seed)
        self.y = labels
        code: dict[str, int] = {}
        self.docs = [np.array([code.setdefault(w, len(code)) for w in t.lower().split()], np.int64) for t in texts]
        flat, sizes = array("l"), array("l")
        for word in code:
            bag = subwords(word)
            flat.extend(bag)
            sizes.append(len(bag))
        self.sizes = np.array(sizes if code else [1], np.int64)
        self.flat = np.array(flat if code else [0], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.emb = self.rng.normal(0, 0.1 / WIDTH, (BUCKETS, WIDTH))
        self.out = self.rng.normal(0, 0.5, (WIDTH, 2))
        self.bias = np.zeros(2)
        self.g_emb = np.full((BUCKETS, 1), 1e-8)

    def bucket_logits(self) -> tuple[np.ndarray, float]:
        return self.emb @ (self.out[:, 1] - self.out[:, 0]), float(self.bias[1] - self.bias[0])

    def segments(self, k: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and margins of a document's segments."""
        return margins(sums[self.docs[k]], self.sizes[self.docs[k]])

    def step(self, rows: list[np.ndarray], y: np.ndarray, rate: float) -> None:
        words = np.concatenate(rows)
        of_row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        sizes = self.sizes[words]
        total = np.bincount(of_row, sizes, len(rows))
        at = np.repeat(self.first[words] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        buckets, owner = self.flat[at], np.repeat(of_row, sizes)
        cuts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(rows)))[:-1]])
        mean = np.add.reduceat(self.emb[buckets], cuts) / total[:, None]
        z = mean @ self.out + self.bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(rows)), y] -= 1
        p /= len(rows)
        back = (p @ self.out.T) / total[:, None]
        self.out -= rate * (mean.T @ p)
        self.bias -= rate * p.sum(0)
        used, where = np.unique(buckets, return_inverse=True)
        grad = np.stack([np.bincount(where, back[owner, d], len(used)) for d in range(WIDTH)], 1)
        self.g_emb[used, 0] += (grad**2).mean(1)
        self.emb[used] -= rate * grad / np.sqrt(self.g_emb[used])

    def fit(self) -> None:
        good, bad = np.flatnonzero(self.y == 0), np.flatnonzero(self.y == 1)
        for epoch in range(EPOCHS):
            z, b = self.bucket_logits()
            sums = np.add.reduceat(z[self.flat], self.first)
            rows, y = [], []
            for k in (*bad, *good):
                starts, m = self.segments(k, sums)
                if not len(starts):
                    continue
                if epoch == 0:  # nothing is known yet: all segments, up to a few
                    pick = self.rng.permutation(len(starts))[: 30 if self.y[k] else 8]
                elif self.y[k]:
                    pick = np.argsort(-m)[: 1 + (len(m) > 8)]
                else:
                    pick = np.unique(np.concatenate([[int(np.argmax(m))], self.rng.integers(0, len(m), 3)]))
                for s in starts[pick]:
                    rows.append(self.docs[k][s : s + SEGMENT])
                    y.append(int(self.y[k]))
            order = self.rng.permutation(len(rows))
            y_all = np.array(y)
            for at in range(0, len(order), 128):
                part = order[at : at + 128]
                self.step([rows[i] for i in part], y_all[part], 0.1)


def margins(sums: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segment starts and each segment's mean subword logit, from per-word sums."""
    n = len(sums)
    starts = segment_starts(n)
    if not len(starts):
        return starts, np.zeros(0)
    a = np.concatenate([[0.0], np.cumsum(sums)])
    c = np.concatenate([[0], np.cumsum(sizes)])
    ends = np.minimum(starts + SEGMENT, n)
    return starts, (a[ends] - a[starts]) / np.maximum(c[ends] - c[starts], 1)


class Scorer:
    def __init__(self, z: np.ndarray, bias: float, curve: np.ndarray):
        self.weights, self.z, self.bias, self.curve = z, z.tolist(), bias, curve
        self.cache: dict[str, complex] = {}

    def _word(self, word: str) -> complex:
        """Sum of a word's subword logits, and as imaginary part their number."""
        if len(self.cache) >= CACHE_WORDS:
            self.cache.clear()
        ids = subwords(word)
        out = self.cache[word] = complex(sum(map(self.z.__getitem__, ids)), len(ids))
        return out

    def evidence(self, text: str | None) -> tuple[float, float]:
        known = self.cache.get
        rows = [known(w) or self._word(w) for w in (text or "").lower().split()]
        if not rows:
            return 0.0, 0.0
        values = np.array(rows)
        _, m = margins(values.real, values.imag)
        return float(m.max()) + self.bias, float(np.log1p(len(m)))

    def score(self, text: str | None) -> float:
        m, size = self.evidence(text)
        if not size:
            return 0.0
        x = self.curve @ np.array([1.0, m, size])
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def fit_curve(evidence: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression of the label on (1, margin, log segments), by Newton steps."""
    x = np.column_stack([np.ones(len(y)), evidence])
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(3)
        move = np.linalg.solve(h, x.T @ (y - p) - 1e-3 * w)
        w += np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-6:
            break
    return w


def sampled(docs: DataFrame, labels: DataFrame, column: str, modulus: tuple[int, int], sample: dict[int, int]) -> list[tuple[int, str, int]]:
    """Bounded sample of labelled rows outside the held-out fold, by a hash of the id."""
    m, held = modulus
    own = labels.where(F.col(column).isin(*sample) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(column).alias("y"))
    own = own.where(id_mod("doc_id", m) != held).withColumn("h", F.xxhash64("doc_id"))
    one = None
    for y, most in sample.items():
        part = own.where(F.col("y") == y).orderBy("h", "doc_id").limit(most)
        one = part if one is None else one.unionByName(part)
    texts = one_row_per_doc(docs).where(F.col("text").isNotNull() & (F.length("text") <= TRAIN_CHARS))
    chosen = texts.join(F.broadcast(one.select("doc_id", "y", "h")), "doc_id").groupBy("doc_id", "y", "h").agg(F.min("text").alias("text"))  # at most sum(sample) rows
    so_far = F.sum(F.length("text").cast("long")).over(Window.partitionBy("y").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    bounded = chosen.withColumn("so_far", so_far).where(F.col("so_far") <= TRAIN_TOTAL)
    return sorted((r["doc_id"], r["text"], r["y"]) for r in bounded.select("doc_id", "text", "y").collect())


#: With fewer labelled documents than this, all of them serve the embeddings and the curve, in turns.
FEW = 1500


def fitted(texts: list[str], y: np.ndarray) -> Scorer:
    trainer = Trainer(texts, y)
    trainer.fit()
    return Scorer(*trainer.bucket_logits(), np.array([0.0, 1.0, 0.0]))


def folds(texts: list[str], y: np.ndarray, part: int = 4) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(to train on, aside) splits in which both sides have both labels; copies of a text stay together.

    One split where there are many documents, else one per part.
    """
    side = np.array([zlib.crc32(t.encode()) % part for t in texts])
    for k in range(part if len(texts) < FEW else 1):
        aside = side == k
        if len(set(y[~aside].tolist())) == 2 and aside.any():
            yield ~aside, aside


def train(rows: list[tuple[int, str, int]]) -> Scorer:
    """The embeddings, and the curve from documents that were set aside from them."""
    y = np.array([r[2] for r in rows])
    texts = [r[1] for r in rows]
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if rows else 0.0
        return Scorer(np.zeros(BUCKETS), 0.0, np.array([np.log((share + 1e-3) / (1 - share + 1e-3)), 0.0, 0.0]))
    found, truth, scorer = [], [], None
    for use, aside in folds(texts, y):
        scorer = fitted([t for t, u in zip(texts, use, strict=True) if u], y[use])
        found += [scorer.evidence(t) for t, a in zip(texts, aside, strict=True) if a]
        truth += y[aside].tolist()
    if scorer is None or len(texts) < FEW:
        scorer = fitted(texts, y)
    if len(set(truth)) < 2:
        found, truth = [scorer.evidence(t) for t in texts], y.tolist()
    scorer.curve = fit_curve(np.array(found), np.array(truth))
    scorer.cache.clear()
    return scorer


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every document by a model fit on the bounded sample."""
    scorer = train(sampled(docs, labels, "toxic", HELD_OUT, SAMPLE))
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast((scorer.weights, scorer.bias, scorer.curve))  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(*model.value)
        m, held = HELD_OUT
        for part in slices(batches):
            ids = part.column("doc_id").to_pylist()
            values = np.array([own.score(t) for t in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([i is not None and py_id_mod(i, m) == held for i in ids]), pa.array(values), pa.array((values >= CUTOFF).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return one_row_per_doc(docs).mapInArrow(run, RESULT)


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with all their columns, that are not predicted toxic."""
    scorer = train(sampled(docs, labels, "toxic", HELD_OUT, SAMPLE))
    model = docs.sparkSession.sparkContext.broadcast((scorer.weights, scorer.bias, scorer.curve))

    def passes():
        own = Scorer(*model.value)
        return lambda text: own.score(text) < CUTOFF

    return kept_rows(docs, passes)
