"""Text quality by naive Bayes support vectors.

A text is the set of its n-grams: words, pairs of words, runs of four characters of its shape (letters by case, digits and
the punctuation itself; runs of one class are one character) and words repeated in a row. Indicators are scaled by the
log-count ratio of the two labels; on these a linear hinge-loss model is fitted by dual coordinate descent, mixed with its
mean magnitude as naive Bayes would weigh, and Platt scaling on a fold of the training rows turns margins into scores.

Training reads a bounded sample: `TRAIN_ROWS` labelled rows that are not held out (crc32 of doc_id as text, modulo 5, is
not 0), chosen by a hash of doc_id, with their whole texts; what comes to the driver of a text, however long, are its
distinct codes, of which there are 2 ** BITS. Every text is scored whole, scaled to unit length as in training.

Defined results: a null or empty text has no n-grams and the score of the intercept; without labels of both kinds every
score is the share of label 1 (0.5 without any); a row without doc_id is not held out; of several labels of a doc_id the
smallest counts; repeated rows give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm.textvec import mix, slices, words

TRAIN_ROWS = 6000
BITS = 18
COST = 1.0
ROUNDS = 12
SMOOTH = 1.0
#: Share of the naive Bayes magnitude in the weights.
BLEND = 0.25
CUT = 0.3

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[[0x20, *range(0x09, 0x0E)]] = 0x20
_SHAPE[ord("0") : ord("9") + 1] = ord("9")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[0x80:] = ord("a")


def grams(texts: list[bytes | None], bits: int = BITS) -> list[np.ndarray]:
    """For each text the sorted distinct codes of its n-grams, below 2 ** bits."""
    doc, h = words(texts)
    n = len(texts)
    at = np.searchsorted(doc, np.arange(n + 1))
    near = doc[1:] == doc[:-1]
    pair = mix(h[:-1] * np.uint64(0x100000001B3) + h[1:])
    same = near & (h[1:] == h[:-1])
    out = []
    mask = np.uint64((1 << bits) - 1)
    for i, t in enumerate(texts):
        a, b = at[i], at[i + 1]
        parts = [h[a:b] & mask, pair[a : max(a, b - 1)] & mask]
        run = same[a : max(a, b - 1)]
        k = 0
        while k < 4 and run.any():
            parts.append(mix(np.array([k + 1], np.uint64)) & mask)
            run, k = run[1:] & run[:-1], k + 1
        s = _SHAPE[np.frombuffer(t or b"", np.uint8)]
        if len(s):
            keep = np.ones(len(s), bool)
            keep[1:] = s[1:] != s[:-1]
            s = np.concatenate(([0x20], s[keep], [0x20])).astype(np.uint64)
            if len(s) > 3:
                g = ((s[:-3] << np.uint64(8) | s[1:-2]) << np.uint64(8) | s[2:-1]) << np.uint64(8) | s[3:]
                parts.append(mix(np.unique(g) + np.uint64(1 << 40)) & mask)
        out.append(np.unique(np.concatenate(parts)).astype(np.int64))
    return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    scale: np.ndarray  # log-count ratios
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, sets: list[np.ndarray]) -> np.ndarray:
        """Of texts as the fit sees them: rows of unit length."""
        return np.array([self.weights[s].sum() / (np.linalg.norm(self.scale[s]) or 1.0) + self.bias for s in sets])

    def scores(self, sets: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(sets) + self.shift, -40, 40)))


def hinge(x: list[np.ndarray], r: np.ndarray, y: np.ndarray, cost: float = COST, rounds: int = ROUNDS, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias of min |w|^2 / 2 + cost * sum of hinge losses, over rows r[x] of unit length, by dual coordinates."""
    w, bias = np.zeros(len(r)), 0.0
    rows = [r[s] for s in x]
    norm = np.array([np.sqrt(v @ v) or 1.0 for v in rows])
    rows = [v / k for v, k in zip(rows, norm, strict=True)]
    alpha = np.zeros(len(y))
    # the rarer label weighs as much as the other one
    most = cost * np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in order.permutation(len(y)):
            s, v = x[i], rows[i]
            g = y[i] * (w[s] @ v + bias) - 1
            a = min(max(alpha[i] - g / 2, 0.0), most[i])  # |v|^2 + 1 = 2
            if a != alpha[i]:
                d = (a - alpha[i]) * y[i]
                alpha[i] = a
                w[s] += d * v
                bias += d
    return w, bias


def fit(x: list[np.ndarray], label: np.ndarray, bits: int = BITS) -> Model:
    """Learns from sets of codes and labels 0 and 1."""
    share = float(label.mean()) if len(label) else 0.5
    if share in (0.0, 1.0) or len(label) < 10:
        share = min(max(share, 0.01), 0.99)
        return Model(np.zeros(1 << bits), float(np.log(share / (1 - share))), np.zeros(1 << bits))
    fold = np.arange(len(label)) % 4 == 3
    if len(set(label[fold])) < 2 or len(set(label[~fold])) < 2:
        fold = np.zeros(len(label), bool)

    def learned(rows: np.ndarray) -> Model:
        some, y = [x[i] for i in rows], label[rows]
        p, q = np.full(1 << bits, SMOOTH), np.full(1 << bits, SMOOTH)
        for s, k in zip(some, y, strict=True):
            (p if k else q)[s] += 1
        r = np.log((p / p.sum()) / (q / q.sum()))
        w, bias = hinge(some, r, np.where(y > 0, 1.0, -1.0))
        mean = np.abs(w).mean()
        return Model(((1 - BLEND) * w + BLEND * mean * np.sign(w)) * r, bias, r)

    part = learned(np.flatnonzero(~fold))
    check = np.flatnonzero(fold) if fold.any() else np.arange(len(label))
    f = part.margins([x[i] for i in check])
    a, b = _platt(f, label[check])
    whole = learned(np.arange(len(label))) if fold.any() else part
    return Model(whole.weights, whole.bias, whole.scale, a, b)


def _platt(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit of labels to margins, with the usual softened targets."""
    pos, neg = y.sum(), (1 - y).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    sd = f.std() or 1.0
    z = f / sd
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        v = p * (1 - p) + 1e-9
        g = np.array([((t - p) * z).sum() - 1e-3 * a, (t - p).sum()])
        h = np.array([[(v * z * z).sum() + 1e-3, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a / sd), float(b)


def held_out(remainder: int = 0, modulus: int = 5) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at, texts in slices(b.column(1)):
            yield pa.record_batch([b.column(0).slice(at, len(texts)), pa.array([g.astype("<u4").tobytes() for g in grams(texts)], pa.binary())], names=["doc_id", "codes"])


def learn(docs: DataFrame, labels: DataFrame, *, train_rows: int = TRAIN_ROWS) -> Model:
    """A model from `docs` (doc_id, text) and `labels` (doc_id, quality 0/1). The collected sample is bounded by the parameters."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = {r["doc_id"]: r["quality"] for r in known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows).collect()}
    if not chosen:
        return fit([], np.array([]))
    ids = F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in chosen], "doc_id long"))
    rows = docs.select("doc_id", "text").join(ids, "doc_id").mapInArrow(_grams, "doc_id long, codes binary").groupBy("doc_id").agg(F.min("codes").alias("codes")).orderBy("doc_id").collect()
    return fit([np.frombuffer(r["codes"], "<u4").astype(np.int64) for r in rows], np.array([float(chosen[r["doc_id"]]) for r in rows]))


def _score(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            for at, texts in slices(b.column(1)):
                yield pa.record_batch([b.column(0).slice(at, len(texts)), pa.array(m.scores(grams(texts)), pa.float64())], names=["doc_id", "score"])

    return run


def quality(docs: DataFrame, labels: DataFrame, *, cut: float = CUT, **bounds: int) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of `docs` (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, **bounds))
    out = docs.select("doc_id", "text").mapInArrow(_score(sent), "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
