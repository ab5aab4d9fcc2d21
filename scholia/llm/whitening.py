"""Whitening of embeddings with a covariance weighted by multiplicity.

A vector c becomes the grid vector x = floor(64 c) + 1000000. Equal grid vectors are grouped once; their count (or one, with
``weights="one"``) is the weight of the distinct vector in every sum. Sums of x are exact integers. The covariance is centred
first (n x - S is an exact integer, divided by n in double precision) and then multiplied, task by task, in weighted
products of matrices; the products of the tasks are added in a few tasks and only those d x d sums reach the driver, which
takes the eigenvectors. Each distinct vector is whitened once, and rows get the result by a join on 128 bits of their x;
vectors that hold a large share of the rows meet it as a broadcast of bounded size (`scholia.llm.spread`).

Defined results: rows with a null vector or with a null or non-finite entry are left out; a vector shorter than the longest
one is filled up with zeros (so an empty vector is all zeros); repeated rows are rows like any other; a row without vec_id
stays, with a null one; columns beside vec_id and embedding are ignored; equal eigenvalues (ties) give some orthonormal
basis of their space, the same for all rows. Directions without spread (eigenvalues below 1e-11 of the largest, where double
precision holds no digit of them) can't be whitened and are no components; so a table of equal vectors, or an empty one,
gives no rows. 64 c beyond 2 ** 52 counts as 2 ** 52. `deviation` is null where it doesn't fit a long; `deviation_exact`
holds it as a decimal of 38 digits then too (null beyond these).

With vectors of d entries the driver and each of the adding tasks hold a few d x d matrices; nothing there grows with rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.spread import attach
from scholia.llm.store import Stored
from scholia.llm.textvec import tidy

COMPONENTS = 32
GRID, SHIFT, FAR = 64, 1_000_000, 1 << 52
#: Eigenvalues below this share of the largest have no digits in double precision.
FLAT = 1e-11
#: Tasks that add the products of all others.
ADDERS = 16
#: Vectors that are multiplied at once in a task.
BLOCK = 4096


def grid(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows of `vectors` (vec_id, embedding) that are whole, x as array of long."""
    c = F.col("embedding")
    whole = c.isNotNull() & ~F.exists(c, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    x = F.transform(c, lambda e: F.floor(F.least(F.greatest(e.cast("double") * GRID, F.lit(-float(FAR))), F.lit(float(FAR)))).cast("long") + SHIFT)
    return vectors.where(whole).select("vec_id", x.alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of a column of lists of d longs."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, len(b), BLOCK):
            yield b.slice(i, BLOCK)


def _sums(d: int):
    """Of each task one row a dimension: the weighted sum of x, in two parts that can't overflow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * d
        for b in _blocks(batches):
            x, w = _matrix(b.column(0), d), b.column(1).to_numpy()
            if int(np.abs(x).max(initial=0)) * int(w.sum()) < 1 << 62:
                part = (w @ x).tolist()
            else:
                part = [sum(int(a) * int(k) for a, k in zip(col, w, strict=True)) for col in x.T]
            total = [a + k for a, k in zip(total, part, strict=True)]
        yield pa.record_batch([pa.array(range(d), pa.int32()), pa.array(total, pa.decimal128(38, 0))], names=["dim", "s"])

    return run


class Centre:
    """n and the exact sums of the fit list; x - S / n in double precision, and exact deviations."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n x - S, of longs where they suffice, else of Python integers."""
        most = max(int(np.abs(x).max(initial=0)) * self.n, max((abs(s) for s in self.sums), default=0))
        if most < 1 << 61:
            return x * np.int64(self.n) - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(x).astype(np.float64) / self.n

    def deviations(self, x: np.ndarray) -> list[int]:
        y = self.scaled(x)
        most = int(max(abs(y.max(initial=0)), abs(y.min(initial=0))))
        if y.dtype == object or most * most * y.shape[1] >= 1 << 63:
            y = y.astype(object)
        return [int(v) for v in (y * y).sum(axis=1)]


def _products(take):
    """Of each task one row: the weight, mean and centred product of its vectors, merged from block to block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for b in _blocks(batches):
            y, w = take(b)
            state = merged(state, moments(y, w))
        if state is not None:
            yield _packed(state)

    return run


def moments(y: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Weight, mean and product of the rows of y around it."""
    w = w.astype(np.float64)
    n = w.sum()
    mean = w @ y / n
    z = y - mean
    return n, mean, (z * w[:, None]).T @ z


def merged(a, b):
    if a is None or b is None:
        return b if a is None else a
    n = a[0] + b[0]
    d = b[1] - a[1]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)


def _packed(state) -> pa.RecordBatch:
    return pa.record_batch([pa.array([float(state[0])]), pa.array([state[1].tobytes()], pa.binary()), pa.array([np.ascontiguousarray(state[2]).tobytes()], pa.binary())], names=["n", "mean", "product"])


def _unpacked(n: float, mean: bytes, product: bytes):
    m = np.frombuffer(mean)
    return n, m, np.frombuffer(product).reshape(len(m), len(m))


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state = None
    for b in batches:
        for i in range(len(b)):
            state = merged(state, _unpacked(*(b.column(k)[i].as_py() for k in range(3))))
    if state is not None:
        yield _packed(state)


def covariance(rows: DataFrame, take) -> np.ndarray:
    """The covariance (divisor: the weight) of what `take` makes of each batch of `rows`: (vectors, weights)."""
    kind = "n double, mean binary, product binary"
    parts = rows.mapInArrow(tidy(_products(take)), kind).repartition(ADDERS, F.xxhash64("mean")).mapInArrow(_add, kind)
    state = None
    for r in sorted(parts.collect(), key=lambda r: bytes(r["mean"])):
        state = merged(state, _unpacked(r["n"], r["mean"], r["product"]))
    return state[2] / state[0]


def components(v: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) by falling eigenvalue, without directions that have no spread."""
    e, u = np.linalg.eigh((v + v.T) / 2)
    e, u = e[::-1], u[:, ::-1]
    keep = np.flatnonzero((e > 0) & (e > FLAT * max(e[0], 0.0)))[:most]
    u = u[:, keep]
    if len(keep):  # one of both signs, whatever the machine
        u = u * np.sign(u[np.abs(u).argmax(axis=0), range(len(keep))])
    return e[keep], u


def whiten(vectors: DataFrame, *, most: int = COMPONENTS, weights: str = "counts") -> DataFrame:
    """One row for each whole vector and component: vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact."""
    if weights not in ("counts", "one"):
        raise ValueError("weights: counts or one")
    spark = vectors.sparkSession
    store = Stored(spark)
    key = [F.xxhash64("x").alias("ka"), F.xxhash64(F.lit(7), F.col("x")).alias("kb")]
    x = grid(vectors)
    lengths = x.agg(F.min(F.size("x")).alias("a"), F.max(F.size("x")).alias("b"), F.count("*").alias("n")).first()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
    rows_n, d = lengths["n"], lengths["b"] or 0
    if not rows_n or not d:
        return spark.createDataFrame([], schema)
    if lengths["a"] < d:
        x = x.withColumn("x", F.concat("x", F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(d) - F.size("x"))))
    rows = x.select("vec_id", "x", *key)
    # equal vectors are counted before they are shuffled
    distinct = store.keep(rows.groupBy("ka", "kb", "x").agg(F.count("*").alias("rows")))
    weight = F.col("rows") if weights == "counts" else F.lit(1).cast("long")
    fit = distinct.select("x", weight.alias("w"))
    n = fit.agg(F.sum("w")).first()[0]
    sums = fit.mapInArrow(tidy(_sums(d)), "dim int, s decimal(38,0)").groupBy("dim").agg(F.sum("s").alias("s")).collect()
    centre = Centre(n, [int(r["s"]) for r in sorted(sums, key=lambda r: r["dim"])])
    v = covariance(fit, lambda b: (centre.centred(_matrix(b.column(0), d)), b.column(1).to_numpy()))
    e, u = components(v, most)
    k = len(e)
    if not k:
        return spark.createDataFrame([], schema)
    explained = (e / np.trace(v)).tolist()
    turn = u / np.sqrt(e)

    def white(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            g = _matrix(b.column(2), d)
            exact = centre.deviations(g)
            z = centre.centred(g) @ turn
            dev = pa.array([a if a < 1 << 63 else None for a in exact], pa.int64())
            dec = pa.array([a if a < 10**38 else None for a in exact], pa.decimal128(38, 0))
            cells = pa.ListArray.from_arrays(pa.array(np.arange(0, len(b) * k + 1, k), pa.int32()), pa.array(z.ravel()))
            yield pa.record_batch([b.column(0), b.column(1), b.column(3), dev, dec, cells], names=["ka", "kb", "rows", "deviation", "deviation_exact", "z"])

    one = distinct.select("ka", "kb", "x", "rows").mapInArrow(tidy(white), "ka long, kb long, rows long, deviation long, deviation_exact decimal(38,0), z array<double>")
    one = store.keep(one)
    cells = one.select("z", (F.col("rows") if weights == "counts" else F.lit(1).cast("long")).alias("w"))
    identity = covariance(cells, lambda b: (b.column(0).flatten().to_numpy().reshape(len(b), k), b.column(1).to_numpy()))
    error = float(np.abs(identity - np.eye(k)).max())
    store.drop(distinct)
    out = attach(rows.select("vec_id", "ka", "kb"), one, ["ka", "kb"], "rows", rows_n, row_bytes=64 + 8 * k)
    out = out.select("vec_id", "deviation", "deviation_exact", F.posexplode("z").alias("component", "whitened")).withColumn("component", F.col("component") + 1)
    share = F.element_at(F.array(*[F.lit(s) for s in explained]), F.col("component"))
    return out.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"), "deviation_exact")
