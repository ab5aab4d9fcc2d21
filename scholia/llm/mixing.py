"""Mixing sources to target weights by balanced (cube) sampling.

Every document of a source is taken the whole part of target / source size times; the fractional part is an inclusion
probability that the cube method turns into 0 or 1. The flight phase moves the probabilities of three documents at a
time along the null space of the two balancing equations (words and documents of the source), so that both totals stay
as they were; it runs in blocks of a bounded number of documents. What is left undecided in a block (two documents at
most) goes into blocks of the next level, until one block of a source is left, where the last ones and a few more
documents land on the choice whose words come nearest to the target. A source of few blocks keeps a few documents out of
the flight for that, and each source lands in its own last block, whatever the size of others.

Blocks are dealt by a hash of all that tells rows apart (doc_id, source, size, 128 bits of the text, carried columns) and of
a number that equal rows get one after the other, so neither rows without doc_id nor any number of equal rows share a
block, and reruns agree whatever the order of the rows.

Defined results: a null or empty text has size 0 and is taken 0 times or more without changing any total; a null source
is a source of its own, after all others; repeated rows are documents of their own, alike but for how often they are taken;
a very long text is one document, counted whole, and comes with no more than its size into a block; an empty table gives no
rows; columns of the input that `carry` doesn't name are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm.store import Stored

WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
BLOCK_ROWS = 1024
LANDING_ROWS = 12
MAX_SOURCES = 1_000_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, most: float = MOST_REPEATS, total: float | None = None) -> dict[str | None, float]:
    """Words that each source shall give: shares by weight, stopped at `most` times its size, the excess reshared."""
    order = sorted((s for s, _ in sizes if s is not None)) + [s for s, _ in sizes if s is None]
    size = dict(sizes)
    w = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    left = float(sum(size.values()) if total is None else total)
    out: dict[str | None, float] = {}
    free = list(order)
    while free:
        unit = left / sum(w[s] for s in free)
        over = [s for s in free if unit * w[s] > most * size[s]]
        if not over:
            return out | {s: unit * w[s] for s in free}
        for s in over:
            out[s] = float(most * size[s])
            left -= out[s]
        left = max(left, 0.0)
        free = [s for s in free if s not in out]
    return out


def flight(prob: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The flight phase on one block: probabilities of which two at most are not 0 or 1; sums of p and p * size are kept."""
    p = prob.astype(float).copy()
    p[p < 1e-9] = 0
    p[p > 1 - 1e-9] = 1
    queue = [int(i) for i in np.flatnonzero((p > 0) & (p < 1))]
    at, held = 0, []
    val = p.tolist()
    s = size.astype(float).tolist()
    while True:
        while len(held) < 3 and at < len(queue):
            held.append(queue[at])
            at += 1
        if len(held) < 2:
            break
        if len(held) == 2:
            if s[held[0]] != s[held[1]]:
                break
            u = (1.0, -1.0)
        else:
            a, b, c = (s[i] for i in held)
            u = (b - c, c - a, a - b) if not a == b == c else (1.0, -1.0, 0.0)
        steps = [(1 - val[i]) / d if d > 0 else -val[i] / d for i, d in zip(held, u, strict=True) if d]
        step = min(steps)
        for i, d in zip(held, u, strict=True):
            val[i] += step * d
            if val[i] < 1e-9:
                val[i] = 0.0
            elif val[i] > 1 - 1e-9:
                val[i] = 1.0
        kept = [i for i in held if 0 < val[i] < 1]
        if len(kept) == len(held):  # rounding: the one that should have landed does
            i = min(held, key=lambda j: min(val[j], 1 - val[j]))
            val[i] = float(round(val[i]))
            kept = [i for i in held if 0 < val[i] < 1]
        held = kept
    return np.array(val)


def land(prob: np.ndarray, landed: np.ndarray, size: np.ndarray, most: int = LANDING_ROWS) -> np.ndarray:
    """0 or 1 for all: the few left by the flight and the next documents of the block, `most` together, are decided anew
    so that their words, then their number, come nearest to what is expected of the block."""
    p = landed.copy()
    open_ = (p > 0) & (p < 1)
    if open_.any():
        some = np.concatenate((np.flatnonzero(open_), np.flatnonzero(~open_ & (prob > 0) & (prob < 1))))[:most]
        rest = np.setdiff1d(np.arange(len(p)), some)
        words, docs = prob @ size - p[rest] @ size[rest], prob.sum() - p[rest].sum()
        choice = np.array(list(itertools.product((0, 1), repeat=len(some))))
        p[some] = choice[np.lexsort((np.abs(choice.sum(1) - docs), np.abs(choice @ size[some] - words)))[0]]
        p = _nearer(p, np.flatnonzero((prob > 0) & (prob < 1)), size.astype(float), float(prob @ size))
    return p


def _nearer(p: np.ndarray, may: np.ndarray, size: np.ndarray, words: float) -> np.ndarray:
    """Turns over one or two of the documents `may` at a time as long as that brings the words nearer, by half a word at least:
    where few are taken, no choice among a dozen need be near."""
    for _ in range(len(may)):
        miss = words - p @ size
        gain = (1 - 2 * p[may]) * size[may]
        order = np.argsort(gain, kind="stable")
        g = gain[order]
        at = np.clip(np.searchsorted(g, miss - g), 1, len(g) - 1) if len(g) > 1 else np.zeros(len(g), int)
        best = (abs(miss) - 0.5, ())
        for i in range(len(g)):
            ways = [(abs(miss - g[i]), (order[i],))] + [(abs(miss - g[i] - g[j]), (order[i], order[j])) for j in (at[i] - 1, at[i]) if j != i and len(g) > 1]
            best = min(best, *ways, key=lambda w: w[0])
        if not best[1]:
            break
        for i in best[1]:
            p[may[i]] = 1 - p[may[i]]
    return p


def _fly(pdf: pd.DataFrame) -> pd.DataFrame:
    """One block: the only one of its source lands; one of few leaves some documents as they are, to land with."""
    pdf = pdf.sort_values(["h", "doc_id", "size"], kind="stable", na_position="last")
    size, prob, blocks = pdf["size"].to_numpy(), pdf["p"].to_numpy(float), int(pdf["blocks"].iloc[0])
    if blocks == 1:
        return pdf.assign(p=land(prob, flight(prob, size), size))
    p, wait = prob.copy(), np.zeros(len(prob), bool)
    if blocks <= LANDING_ROWS:
        wait[np.flatnonzero((prob > 0) & (prob < 1))[: -(-LANDING_ROWS // blocks)]] = True
    p[~wait] = flight(prob[~wait], size[~wait])
    return pdf.assign(p=p)


#: Equal rows that a task numbers at once.
EQUAL_ROWS = 1 << 16


def numbered(docs: DataFrame, store: Stored, carry: tuple[str, ...] = (), *, seed: int = 7, equal_rows: int = EQUAL_ROWS) -> DataFrame:
    """doc_id, source, size, `carry` and `h` of every row: h is a hash of 64 bits that tells rows apart, equal ones too.

    Equal rows are counted before they are shuffled, and a large count is dealt to many tasks before it becomes rows again.
    """
    key = ["doc_id", "source", *carry, "size", "ta", "tb"]
    rows = docs.select("doc_id", "source", *carry, word_count("text").alias("size"), F.xxhash64("text").alias("ta"), F.xxhash64(F.lit(seed), "text").alias("tb"))
    counted = rows.groupBy(*key).agg(F.count("*").alias("rows"))
    single = counted.where("rows = 1").withColumn("copy", F.lit(0).cast("long")).drop("rows")
    many = counted.where("rows > 1").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / equal_rows))))
    many = many.repartition(F.xxhash64(*key, "part")).withColumn("first", F.col("part") * equal_rows)
    many = many.withColumn("copy", F.explode(F.sequence("first", F.least(F.col("first") + equal_rows, "rows") - 1))).drop("rows", "part", "first")
    out = store.keep(single.unionByName(many))
    return out.select("doc_id", "source", *carry, "size", F.xxhash64(F.lit(seed), *key, "copy").alias("h"))


def mix_sources(docs: DataFrame, *, weights=WEIGHTS, most: float = MOST_REPEATS, seed: int = 7, block_rows: int = BLOCK_ROWS, max_sources: int = MAX_SOURCES, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken (words) and copies of every row of `docs` (doc_id, text, source), and the columns in `carry`.

    Only one total for each source comes to the driver (`max_sources` bounds them; beyond it an error is raised).
    A decided document carries its row along and leaves the shuffles; only undecided ones go on to the next level.
    """
    spark = docs.sparkSession
    store = Stored(spark)
    base = numbered(docs, store, carry, seed=seed)
    totals = base.groupBy("source").agg(F.sum("size").alias("s"), F.count("*").alias("n")).limit(max_sources + 1).collect()
    if len(totals) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    goal = targets([(r["source"], r["s"]) for r in totals], weights, most)
    table = spark.createDataFrame(
        [(r["source"], r["s"], g := goal[r["source"]], int(q := g / r["s"] if r["s"] else 0.0), q - int(q), max(1, -(-r["n"] // block_rows))) for r in totals],
        "k string, source_size long, target double, whole long, part double, blocks long",
    )
    table = F.broadcast(table) if len(totals) <= 10_000 else table
    b = base.join(table, F.col("source").eqNullSafe(F.col("k"))).drop("k")
    decided = []
    level = b.withColumn("p", F.col("part")).drop("part")
    blocks = max([-(-r["n"] // block_rows) for r in totals], default=0)
    while blocks:
        last = blocks == 1
        level = level.withColumn("block", F.pmod(F.xxhash64("h", F.lit(blocks)), "blocks"))
        done = store.keep(level.groupBy("source", "block").applyInPandas(_fly, level.schema))
        decided.append(done.where("p = 0 or p = 1") if not last else done)
        # two undecided documents at most of each block go on, and those left to land with
        per = max(2, block_rows // 2)
        level = done.where("p > 0 and p < 1").withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("blocks") / per)).cast("long"))
        blocks = 0 if last else max(1, -(-blocks // per))
    if not decided:
        return b.selectExpr("doc_id", "size", "source_size", "target", "0L as taken", "0L as copies", *carry)
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    copies = F.col("whole") + F.col("p").cast("long")
    return out.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), *carry)
