"""Vectorised word and shingle hashes of whole texts, for use inside Arrow tasks.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D, with A-Z lowered; hashes have 64 bits.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once: bounds the memory of a task whatever the batch holds (one longer text is taken alone).
CHUNK_BYTES = 1 << 20
#: Texts that are taken out of a batch at once.
ROWS = 256

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _pows(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        out = []
        for base in (_P, _PINV):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            with np.errstate(over="ignore"):
                out.append(np.multiply.accumulate(x))
        if size > 4 * CHUNK_BYTES:  # of one very long text: not kept
            return out[0], out[1]
        _powers[:] = out
    return _powers[0], _powers[1]


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function of a mapInArrow; its worker, kept for later tasks, gives freed memory back to the system at the end."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library; others do without
        if trim:
            trim(0)

    return tidied


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the text, hash) of every word, in order; a null text has none."""
    parts = [t or b"" for t in texts]
    buf = np.frombuffer((b"\n".join(parts) + b"\n").lower(), np.uint8)
    sep = _SPACE[buf]
    edge = np.flatnonzero(sep[1:] != sep[:-1]) + 1
    if not sep[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    start = start[: len(end)]
    lens = np.array([len(p) + 1 for p in parts])
    doc = np.searchsorted(np.cumsum(lens), start, side="right")
    up, down = _pows(len(buf) + 1)
    sums = np.empty(len(buf) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=sums[1:])
    h = (sums[end] - sums[start]) * down[start]
    return doc, mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingles(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of `width` words, as int64 in the order of the hash.

    A text with fewer words has one, of all of them; one without words has none.
    """
    doc, h = words(texts)
    n = len(texts)
    first = np.searchsorted(doc, np.arange(n + 1))
    out = []
    roll = h.copy()
    full = len(h) - width + 1
    if full > 0:
        roll = h[:full].copy()
        for k in range(1, width):
            roll = mix(roll * np.uint64(0x100000001B3) + h[k : k + full])
        roll = mix(roll + np.uint64(width))
    flip = np.uint64(1 << 63)
    for i in range(n):
        a, b = first[i], first[i + 1]
        if b - a >= width:
            s = roll[a : b - width + 1]
        elif b > a:
            x = h[a : a + 1].copy()
            for k in range(a + 1, b):
                x = mix(x * np.uint64(0x100000001B3) + h[k : k + 1])
            s = mix(x + np.uint64(b - a))
        else:
            out.append(np.empty(0, np.int64))
            continue
        out.append(np.unique((s ^ flip).view(np.int64)))
    return out


def slices(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes | None]]]:
    """(offset, texts) of a string column, cut so that each cut holds about `limit` bytes or one text."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    at, size, cut = 0, 0, []
    for i in range(len(column)):
        if i % ROWS == 0:  # few texts of a batch at once
            some = column.slice(i, ROWS).cast(kind).to_pylist()
        t = some[i % ROWS]
        n = len(t) if t else 0
        if cut and size + n > limit:
            yield at, cut
            at, size, cut = i, 0, []
        cut.append(t)
        size += n
    if cut:
        yield at, cut
