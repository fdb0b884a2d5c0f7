"""Document quality from a line-labelling conditional random field (operator 8).

Every line of a text is labelled good or bad by a linear-chain CRF.  A line's
features are shape measures (symbols, capitals, digits, table bars, repeated
words, word and line lengths, ...) of the line itself and of its two
neighbours; a transition matrix ties the labels of adjacent lines.  Training
maximises the regularised likelihood with every line carrying its document's
label, by forward-backward over padded batches, in numpy.  A document's quality
is the mean of its lines' marginals of "good", weighted by their lengths, set on
a logistic curve that is fit on labelled documents the CRF was not trained on.

Labels are learnt only from rows whose ``crc32(doc_id) mod 3`` is not 1 and from
at most ``SAMPLE`` labelled documents of each class, chosen by a hash of their
id, without very long ones (``toxicity.TRAIN_CHARS``, ``TRAIN_TOTAL``) and up to
``TRAIN_LINES`` lines in all, the documents with fewest lines first.  Null, empty and blank texts have no line and get the curve's value for a
marginal of one half.  Scores depend on the text alone.  Lines over ``PIECE``
characters are scored in pieces of that length, so that a text without line
ends is labelled along its length too; nothing is cut off.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import kept_rows, one_row_per_doc, py_id_mod, slices
from .toxicity import FEW, folds, sampled

HELD_OUT = (3, 1)
SAMPLE = {1: 2500, 0: 1500}
CUTOFF = 0.5
PIECE = 2000
STEPS = 150
#: Lines of all documents that the field is fit on, and (padded) of a batch of them.
TRAIN_LINES, BATCH_LINES = 400_000, 100_000
RESULT = "doc_id long, held_out boolean, score double, predicted int"

SYMBOLS = b"#*$%&|<>"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = b"0123456789"
ENDS = (b".", b"!", b"?")
N_SHAPE = 16


def shape(line: str) -> list[float]:
    """Measures of one line that has a word."""
    data = line.encode()
    n = len(data)
    words = data.split() or [data]
    k = len(words)
    count = data.count
    symbols = n - len(data.translate(None, SYMBOLS))
    return [
        1.0,
        min(symbols / k, 4.0),
        (n - len(data.translate(None, CAPITALS))) / n,
        count(b"!") / k,
        count(b"|") / k,
        sum(map(bytes.__eq__, words, words[1:])) / k,
        1.0 - len(set(words)) / k,
        min(n / k, 20.0) / 10.0,
        math.log1p(k) / 5.0,
        float(k < 4),
        float(words[-1][-1:] in ENDS),
        (count(b".") + count(b",")) / k,
        float(len(words[0].translate(None, DIGITS)) < len(words[0])),
        min((count(b"http") + count(b"@") + count(b"=")) / k, 1.0),
        float(line[0].isupper()),
        float(symbols > 0.5 * k),
    ]


def lines_of(text: str | None) -> list[str]:
    out = []
    for line in (text or "").split("\n"):
        if line.strip():
            if len(line) <= PIECE:
                out.append(line)
            else:
                out.extend(p for i in range(0, len(line), PIECE) if (p := line[i : i + PIECE]).strip())
    return out


def features(lines: list[str]) -> np.ndarray:
    """Own measures, and those of the line before and of the line after."""
    own = np.array([shape(x) for x in lines])
    full = np.zeros((len(lines), 3 * N_SHAPE))
    full[:, :N_SHAPE] = own
    full[1:, N_SHAPE : 2 * N_SHAPE] = own[:-1]
    full[:-1, 2 * N_SHAPE :] = own[1:]
    return full


def forward_backward(emit: np.ndarray, trans: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log partition, line marginals and expected transitions of a padded batch.

    ``emit`` is (documents, lines, 2), ``mask`` marks real lines (a prefix each).
    """
    b, t, _ = emit.shape
    alpha = np.zeros((b, t, 2))
    alpha[:, 0] = emit[:, 0]
    for i in range(1, t):
        step = np.logaddexp(alpha[:, i - 1, 0, None] + trans[0], alpha[:, i - 1, 1, None] + trans[1]) + emit[:, i]
        alpha[:, i] = np.where(mask[:, i, None], step, alpha[:, i - 1])
    log_z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    beta = np.zeros((b, t, 2))
    pairs = np.zeros((b, 2, 2))
    for i in range(t - 2, -1, -1):
        ahead = emit[:, i + 1] + beta[:, i + 1]
        step = np.logaddexp(trans[:, 0] + ahead[:, 0, None], trans[:, 1] + ahead[:, 1, None])
        real = mask[:, i + 1, None]
        beta[:, i] = np.where(real, step, beta[:, i + 1])
        joint = np.exp(alpha[:, i, :, None] + trans + ahead[:, None, :] - log_z[:, None, None])
        pairs += joint * real[:, :, None]
    return log_z, np.exp(alpha + beta - log_z[:, None, None]), pairs


class LineCrf:
    def __init__(self, weights: np.ndarray, trans: np.ndarray, scale: np.ndarray, curve: np.ndarray):
        self.weights, self.trans, self.scale, self.curve = weights, trans, scale, curve

    def good_share(self, text: str | None) -> float:
        """Length-weighted mean marginal of "good" (one half without a line)."""
        lines = lines_of(text)
        if not lines:
            return 0.5
        emit = (features(lines) / self.scale) @ self.weights
        good = self.marginal(emit)
        sizes = np.array([len(x) for x in lines], float)
        return float(good @ sizes / sizes.sum())

    def marginal(self, emit: np.ndarray) -> np.ndarray:
        """Forward-backward on one document, on the label's log odds."""
        n = len(emit)
        if n == 1:
            d = emit[0, 1] - emit[0, 0]
            return np.array([1 / (1 + np.exp(-d))])
        _, marginals, _ = forward_backward(emit[None], self.trans, np.ones((1, n), bool))
        return marginals[0, :, 1]

    def score(self, text: str | None) -> float:
        x = self.curve[0] + self.curve[1] * self.good_share(text)
        return float(1 / (1 + np.exp(-x)))


def train_crf(texts: list[str], y: np.ndarray) -> LineCrf:
    split = [(x, int(k)) for t, k in zip(texts, y, strict=True) if (x := lines_of(t))]
    split.sort(key=lambda d: len(d[0]))
    upto = np.cumsum([len(x) for x, _ in split]) <= TRAIN_LINES
    docs = [(features(x), k) for (x, k), ok in zip(split, upto.tolist(), strict=True) if ok or not upto.any()]
    scale = np.maximum(np.abs(np.concatenate([d[0] for d in docs])).max(0), 1e-6)
    weight = {k: len(docs) / (2 * max(1, sum(d[1] == k for d in docs))) for k in (0, 1)}
    batches = []
    at = 0
    while at < len(docs):  # sorted by length, so the last one of a batch is its longest
        end = at + 1
        while end < len(docs) and end - at < 256 and (end + 1 - at) * len(docs[end][0]) <= BATCH_LINES:
            end += 1
        part, at = docs[at:end], end
        t = len(part[-1][0])
        x = np.zeros((len(part), t, 3 * N_SHAPE))
        mask = np.zeros((len(part), t), bool)
        for i, (f, _) in enumerate(part):
            x[i, : len(f)], mask[i, : len(f)] = f / scale, True
        batches.append((x, mask, np.array([d[1] for d in part])))
    w, trans = np.zeros((3 * N_SHAPE, 2)), np.zeros((2, 2))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(trans), np.zeros_like(trans)]
    total = sum(float(m.sum()) for _, m, _ in batches)
    for step in range(1, STEPS + 1):  # full-batch Adam
        g_w, g_t = 1e-3 * w, 1e-3 * trans
        for x, mask, k in batches:
            emit = (x @ w) * mask[:, :, None]
            _, marginals, pairs = forward_backward(emit, trans, mask)
            gold = np.zeros_like(marginals)
            gold[np.arange(len(k)), :, k] = 1
            docw = np.where(k == 1, weight[1], weight[0])
            diff = (marginals - gold) * (mask * docw[:, None])[:, :, None] / total
            g_w = g_w + np.einsum("btf,btk->fk", x, diff)
            same = np.zeros((len(k), 2, 2))
            same[np.arange(len(k)), k, k] = mask.sum(1) - 1
            g_t = g_t + ((pairs - same) * docw[:, None, None]).sum(0) / total
        for p, g, m, v in ((w, g_w, state[0], state[1]), (trans, g_t, state[2], state[3])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        np.clip(trans, -1.5, 1.5, out=trans)  # keeps single lines able to differ
    return LineCrf(w, trans, scale, np.array([0.0, 1.0]))


def fit_curve(share: np.ndarray, y: np.ndarray) -> np.ndarray:
    x = np.column_stack([np.ones(len(y)), share])
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2)
        move = np.linalg.solve(h, x.T @ (y - p) - 1e-2 * w)
        w += np.clip(move, -3, 3)
        if np.abs(move).max() < 1e-7:
            break
    return w


def train(rows: list[tuple[int, str, int]]) -> LineCrf:
    """The field, and the curve from documents that were set aside from it."""
    y = np.array([r[2] for r in rows])
    texts = [r[1] for r in rows]
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        return LineCrf(np.zeros((3 * N_SHAPE, 2)), np.zeros((2, 2)), np.ones(3 * N_SHAPE), np.array([np.log((share + 1e-3) / (1 - share + 1e-3)), 0.0]))
    found, truth, crf = [], [], None
    for use, aside in folds(texts, y):
        crf = train_crf([t for t, u in zip(texts, use, strict=True) if u], y[use])
        found += [crf.good_share(t) for t, a in zip(texts, aside, strict=True) if a]
        truth += y[aside].tolist()
    if crf is None or len(texts) < FEW:
        crf = train_crf(texts, y)
    if len(set(truth)) < 2:
        found, truth = [crf.good_share(t) for t in texts], y.tolist()
    crf.curve = fit_curve(np.array(found), np.array(truth))
    return crf


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    crf = train(sampled(docs, labels, "quality", HELD_OUT, SAMPLE))
    model = docs.sparkSession.sparkContext.broadcast((crf.weights, crf.trans, crf.scale, crf.curve))  # a few hundred numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LineCrf(*model.value)
        m, held = HELD_OUT
        for part in slices(batches):
            ids = part.column("doc_id").to_pylist()
            values = np.array([own.score(t) for t in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([i is not None and py_id_mod(i, m) == held for i in ids]), pa.array(values), pa.array((values >= CUTOFF).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return one_row_per_doc(docs).mapInArrow(run, RESULT)


def good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with all their columns, that are predicted good."""
    crf = train(sampled(docs, labels, "quality", HELD_OUT, SAMPLE))
    model = docs.sparkSession.sparkContext.broadcast((crf.weights, crf.trans, crf.scale, crf.curve))

    def passes():
        own = LineCrf(*model.value)
        return lambda text: own.score(text) >= CUTOFF

    return kept_rows(docs, passes)
