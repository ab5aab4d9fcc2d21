"""Toxicity by non-negative positive-unlabelled learning.

A text is the counts of its grams: lower-cased words and their beginnings of 3 to 8 bytes. A gram's value is log(1 + count),
scaled by the log ratio of its share of confirmed toxic texts and of unlabelled ones where that is positive (others say
nothing and are left out). On these a linear classifier minimises the positive-unlabelled logistic risk for a class prior p,

    p E_pos[l(f)] + max(0, E_unl[l(-f)] - p E_pos[l(-f)]),

by Adam on whole gradients; where the second term falls below zero (unlabelled texts have been fitted too well), the step
goes up its gradient instead. FOLDS classifiers are trained side by side in Spark tasks, each without one part of the
examples, and their margins averaged, which keeps the one-sided steps from tilting the result.

Training reads bounded samples in order of a hash of doc_id: `positive_rows` documents whose label is toxic and
`unlabelled_rows` documents of any or no label, none of them held out (crc32 of doc_id as text, modulo 3, is 1), as whole
texts. The prior is the share of toxic rows among all labels that are not held out; where these name toxic rows only, their
share of all documents; or a parameter. Every text is scored whole.

Defined results: a null or empty text has no grams and gets the intercept's score; without a confirmed toxic example or
without documents to compare it with every score is 0; a row without doc_id is not held out but never an example; of
several labels of a doc_id the largest counts, of several texts the smallest; repeated rows give repeated results; columns
beside doc_id and text (labels: doc_id, toxic) are ignored; a very long text is one row, its grams counted in parts of
bounded size; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm.store import Stored
from scholia.llm.textvec import _pows, _SPACE, mix, slices, tidy

POSITIVE_ROWS, UNLABELLED_ROWS = 2000, 4000
BITS = 20
FOLDS = 4
STEPS = 150
RATE = 0.05
SHRINK = 3e-4
#: Examples that must hold a gram before it gets a weight.
SEEN = 6
CUT = 0.7
STARTS = (3, 4, 5, 6, 7, 8)


def gram_codes(texts: list[str | None], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(index of the text, code below 2 ** bits) of every gram of every word."""
    parts = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    buf = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    sep = _SPACE[buf]
    edge = np.flatnonzero(sep[1:] != sep[:-1]) + 1
    if not sep[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    start = start[: len(end)]
    doc = np.searchsorted(np.cumsum([len(p) + 1 for p in parts]), start, side="right")
    up, down = _pows(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=sums[1:])
    docs, codes = [], []
    for k, stop, some in [(0, end, slice(None))] + [(k, start + k, end - start >= k) for k in STARTS]:
        a, b = start[some], stop[some]
        codes.append(mix((sums[b] - sums[a]) * down[a] + np.array([k], np.uint64) * np.uint64(0xD6E8FEB86659FD93)) & np.uint64((1 << bits) - 1))
        docs.append(doc[some])
    return np.concatenate(docs), np.concatenate(codes).astype(np.int64)


def counted(docs: np.ndarray, codes: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, code, count) of the different codes of each text."""
    both, count = np.unique(docs << bits | codes, return_counts=True)
    return both >> bits, both & ((1 << bits) - 1), count


def risk(f: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The two terms of the risk (toxic texts; all others, which may fall below zero) and their gradients by the margins."""
    p, u = positive / positive.sum(), ~positive / (~positive).sum()
    s = 1 / (1 + np.exp(-np.clip(f, -40, 40)))
    toxic = prior * (p @ np.logaddexp(0, -f))
    other = u @ np.logaddexp(0, f) - prior * (p @ np.logaddexp(0, f))
    return toxic, other, prior * p * (s - 1), (u - prior * p) * s


def fit(row: np.ndarray, code: np.ndarray, count: np.ndarray, positive: np.ndarray, prior: float, *, bits: int = BITS, steps: int = STEPS, rate: float = RATE, shrink: float = SHRINK, seen: int = SEEN) -> tuple[np.ndarray, float]:
    """Weights of codes and the intercept. row, code, count: the grams of the examples; positive: of each example."""
    n_pos, n_unl = positive.sum(), (~positive).sum()
    held_pos, held_unl = np.bincount(code[positive[row]], minlength=1 << bits), np.bincount(code[~positive[row]], minlength=1 << bits)
    scale = np.log((held_pos + 1) / (n_pos + 2)) - np.log((held_unl + 1) / (n_unl + 2))
    scale[(scale < 0) | (held_pos + held_unl < seen)] = 0
    keep = scale[code] > 0
    row, code, value = row[keep], code[keep], np.log1p(count[keep]) * scale[code[keep]]
    used, at = np.unique(code, return_inverse=True)
    w = np.zeros(len(used) + 1)
    w[-1] = np.log(prior / (1 - prior))
    first, second, mean = np.zeros_like(w), np.zeros_like(w), np.zeros_like(w)
    averaged = steps // 2
    for t in range(1, steps + 1):
        f = np.bincount(row, weights=w[at] * value, minlength=len(positive)) + w[-1]
        _, other, g_toxic, g_other = risk(f, positive, prior)
        g = g_toxic + g_other if other >= 0 else -g_other
        grad = np.bincount(at, weights=g[row] * value, minlength=len(w)) + shrink * w
        grad[-1] = g.sum()
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
        w = w - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        if t > averaged:
            mean += w / (steps - averaged)
    weights = np.zeros(1 << bits)
    weights[used] = mean[:-1] * scale[used]
    return weights, float(mean[-1])


def held_out(remainder: int = 1, modulus: int = 3) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at, texts in slices(b.column(2)):
            doc, code, count = counted(*gram_codes([t.decode() if t else "" for t in texts]))
            cut = np.searchsorted(doc, np.arange(len(texts) + 1))
            parts = [(code[i:j].astype("<u4").tobytes(), np.minimum(count[i:j], 1 << 30).astype("<u4").tobytes()) for i, j in zip(cut, cut[1:], strict=False)]
            yield pa.record_batch([b.column(0).slice(at, len(texts)), b.column(1).slice(at, len(texts)), pa.array([p[0] for p in parts], pa.binary()), pa.array([p[1] for p in parts], pa.binary())], names=["doc_id", "positive", "codes", "counts"])


def _trained(prior: float):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        codes, counts, positive = group["codes"].to_pylist(), group["counts"].to_pylist(), np.array(group["positive"].to_pylist(), bool)
        if positive.all() or not positive.any():
            return pa.table({"weights": pa.array([], pa.binary()), "bias": pa.array([], pa.float64())})
        order = sorted(range(len(codes)), key=lambda i: (not positive[i], codes[i]))  # whatever way the rows came
        row = np.repeat(np.arange(len(order)), [len(codes[i]) // 4 for i in order])
        code = np.frombuffer(b"".join(codes[i] for i in order), "<u4").astype(np.int64)
        count = np.frombuffer(b"".join(counts[i] for i in order), "<u4")
        w, bias = fit(row, code, count, positive[order], prior)
        return pa.table({"weights": pa.array([w.astype("<f4").tobytes()], pa.binary()), "bias": [bias]})

    return run


def class_prior(docs: DataFrame, labels: DataFrame) -> float:
    """The share of toxic texts, counted over all labels that are not held out."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if toxic and toxic == n:
        n = max(n, docs.where(~held_out()).count())
    return min(max(toxic / n if n else 0.0, 1e-4), 0.9)


def learn(docs: DataFrame, labels: DataFrame, *, positive_rows: int = POSITIVE_ROWS, unlabelled_rows: int = UNLABELLED_ROWS, prior: float | None = None) -> tuple[np.ndarray, float] | None:
    """Mean weights and intercept of the classifiers; none without examples. Ids of the sampled rows come to the driver."""
    spark = docs.sparkSession
    store = Stored(spark)
    mine = F.col("doc_id").isNotNull() & ~held_out()
    toxic = labels.where(mine & (F.col("toxic") == 1)).select("doc_id").distinct()
    pick = lambda ids, n: [r["doc_id"] for r in ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).collect()]
    pos, unl = pick(toxic, positive_rows), pick(docs.where(mine).select("doc_id"), unlabelled_rows)
    if not pos or not unl:
        return None
    wanted = F.broadcast(spark.createDataFrame([(i, True) for i in pos] + [(i, False) for i in set(unl)], "doc_id long, positive boolean"))
    rows = docs.select("doc_id", "text").join(wanted, "doc_id").select("doc_id", "positive", "text")
    rows = rows.mapInArrow(tidy(_grams), "doc_id long, positive boolean, codes binary, counts binary")
    rows = store.keep(rows.groupBy("doc_id", "positive").agg(F.min(F.struct("codes", "counts")).alias("g")).select("doc_id", "positive", "g.codes", "g.counts"))
    prior = class_prior(docs, labels) if prior is None else prior
    fold = F.pmod(F.xxhash64(F.lit(3), F.col("doc_id")), F.lit(FOLDS))
    parts = rows.withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(FOLDS)]))).where(F.col("k") != fold)
    models = parts.groupBy("k").applyInArrow(_trained(prior), "weights binary, bias double").collect()
    store.drop(rows)
    if not models:
        return None
    w = sum(np.frombuffer(m["weights"], "<f4").astype(np.float64) for m in models) / len(models)
    return w.astype(np.float32), sum(m["bias"] for m in models) / len(models)


def _scores(model: tuple[np.ndarray, float] | None, texts: list[bytes | None]) -> np.ndarray:
    if model is None:
        return np.zeros(len(texts))
    w, bias = model
    doc, code = gram_codes([t.decode() if t else "" for t in texts])
    some = w[code] != 0
    doc, code, count = counted(doc[some], code[some])
    f = np.bincount(doc, weights=w[code] * np.log1p(count), minlength=len(texts)) + bias
    return 1 / (1 + np.exp(-np.clip(f, -40, 40)))


def _scored(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            for at, texts in slices(b.column(1)):
                yield pa.record_batch([b.column(0).slice(at, len(texts)), pa.array(_scores(model, texts))], names=["doc_id", "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, *, cut: float = CUT, **how) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of `docs` (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, **how))
    out = docs.select("doc_id", "text").mapInArrow(tidy(_scored(sent)), "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
