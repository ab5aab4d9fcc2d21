"""Near-duplicate vectors of one label by tiles of int8 products with error bounds.

Equal vectors of a label are one class with a count, so that copies cost one member. The classes of a label are dealt into
blocks of about `tile_rows`, and every pair of blocks is one tile, a task's work of bounded size. In a tile each unit
vector x is s * q + e with q in int8; the product of two is s * s' * (q . q'), and it errs by at most
|s q| |e'| + |e| |s' q'| + |e| |e'|, with the norms taken from the vectors themselves. Pairs whose product plus bound
stays below the threshold are done with; only the others are computed again in double precision. (The products of codes
run as floating point of a width in which they are exact, since that is what processors multiply fastest.) A tile
returns, for each class with a link, how many vectors it links and one spanning link; pairs never leave the tile.

All pairs of a label are compared, so the work grows with the square of a label's distinct vectors: that is what an
exact answer at a fixed threshold takes for vectors without structure.

Defined results: a vector that is null, zero, without components or with null or non-finite ones, or without label or
vec_id, links with nothing (component_id is its vec_id); vectors of different lengths don't link; every row of a
repeated vec_id counts as a vector; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.components import connected_components
from scholia.llm.store import Stored

THRESHOLD = 0.93
TILE_ROWS = 1024


def _pack(kind: str):
    """Binary form of usable vectors and a key of label and direction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            labels = b.column(1).to_pylist()
            vectors = b.column(2)
            keys, packed, dims = [], [], []
            for i, label in enumerate(labels):
                cell = vectors[i].values if vectors[i].is_valid else None
                x = None
                if label is not None and cell is not None and len(cell) and not cell.null_count:
                    x = np.asarray(cell.to_numpy(zero_copy_only=False)).astype(kind) + 0.0
                    if not np.isfinite(x).all() or not x.any():
                        x = None
                if x is None:
                    keys.append(None), packed.append(None), dims.append(None)
                else:
                    raw = x.tobytes()
                    keys.append(hashlib.blake2b(repr(label).encode() + b"\0" + raw, digest_size=16).digest())
                    packed.append(raw), dims.append(len(x))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(keys, pa.binary()), pa.array(packed, pa.binary()), pa.array(dims, pa.int32())], names=["vec_id", "label", "key", "v", "dim"])

    return run


def unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision, of rows that aren't zero."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def quantised(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, norms of what the codes stand for, norms of what they miss."""
    s = np.abs(u).max(1) / 127
    q = np.rint(u / s[:, None]).astype(np.int8)
    stood = q * s[:, None]
    return q, s, np.sqrt((stood * stood).sum(1)), np.sqrt(((u - stood) ** 2).sum(1))


def tile_links(a: np.ndarray, b: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of all pairs of rows of a and b (of a itself, i < j, if b is None) with cosine >= threshold."""
    ua = unit(a)
    ub = ua if b is None else unit(b)
    qa, sa, na, ea = quantised(ua)
    qb, sb, nb, eb = (qa, sa, na, ea) if b is None else quantised(ub)
    exact = np.float32 if 127 * 127 * a.shape[1] < 2**24 else np.float64
    qb = qb.astype(exact).T
    strip, most = 256, max(1, (1 << 21) // a.shape[1])
    for at in range(0, len(ua), strip):
        c = slice(at, at + strip)
        top = (qa[c].astype(exact) @ qb) * sa[c, None] * sb + na[c, None] * eb + ea[c, None] * (nb + eb)
        i, j = np.nonzero(top >= threshold - 1e-9)
        i += at
        if b is None:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), most):
            x, y = i[k : k + most], j[k : k + most]
            ok = np.einsum("ij,ij->i", ua[x], ub[y]) >= threshold
            if ok.any():
                yield x[ok], y[ok]


def _tile(kind: str, threshold: float):
    names = ["key", "links", "a", "b"]

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        dim, i, j = (k.as_py() for k in key[1:])
        block = t["block"].to_numpy()
        x = np.frombuffer(b"".join(t["v"].to_pylist()), kind).reshape(-1, dim)
        first, second = np.flatnonzero(block == i), np.flatnonzero(block == j)
        count, rep = t["count"].to_numpy(), t["rep"].to_numpy()
        links = np.zeros(len(block), np.int64)
        group = np.arange(len(block))
        for p, q in tile_links(x[first], None if i == j else x[second], threshold) if len(first) and len(second) else ():
            p, q = first[p], second[q]
            np.add.at(links, p, count[q])
            np.add.at(links, q, count[p])
            while True:  # the least of both ends, until it is the same
                low = np.minimum(group[p], group[q])
                if (group[p] == low).all() and (group[q] == low).all():
                    break
                np.minimum.at(group, group[p], low)
                np.minimum.at(group, group[q], low)
                np.minimum.at(group, p, low)
                np.minimum.at(group, q, low)
                group = group[group]
        while (group != group[group]).any():
            group = group[group]
        has = np.flatnonzero(links)
        return pa.table([t["key"].combine_chunks().take(pa.array(has)), pa.array(links[has]), pa.array(rep[has]), pa.array(rep[group[has]])], names=names)

    return run


def near_duplicate_vectors(vectors: DataFrame, *, threshold: float = THRESHOLD, tile_rows: int = TILE_ROWS) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of `vectors` (vec_id, label, embedding)."""
    store = Stored(vectors.sparkSession)
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    label = vectors.schema["label"].dataType.simpleString()
    packed = store.keep(
        vectors.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("label")).alias("label"), "embedding")
        .mapInArrow(_pack(kind), f"vec_id long, label {label}, key binary, v binary, dim int")
    )
    classes = store.keep(packed.where("key is not null").groupBy("key", "label", "dim").agg(F.min("vec_id").alias("rep"), F.count("*").alias("count"), F.first("v").alias("v")))
    sizes = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / tile_rows).alias("blocks"))
    dealt = classes.join(sizes, ["label", "dim"]).withColumn("block", F.pmod(F.xxhash64("key"), "blocks"))
    pairs = dealt.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    pairs = pairs.select("label", "dim", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key", "rep", "count", "v")
    found = store.keep(pairs.groupBy("label", "dim", "i", "j").applyInArrow(_tile(kind, threshold), "key binary, links long, a long, b long"))
    groups = store.keep(connected_components(found.select("a", "b"), store))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    known = classes.select("key", "rep", "count").join(links, "key", "left").join(groups.selectExpr("id as rep", "component"), "rep", "left")
    known = known.selectExpr("key", "count - 1 + coalesce(links, 0) n_links", "coalesce(component, rep) component_id")
    out = packed.where("key is not null").select("vec_id", "key").join(known, "key").select("vec_id", "n_links", "component_id")
    out = out.unionByName(packed.where("key is null").selectExpr("vec_id", "0L as n_links", "vec_id as component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
