"""Packing documents into sequences of a fixed number of tokens: dominance reduction, then best fit.

A document is its token ids and one end id. One longer than a sequence is cut into full pieces after a first one that
may be shorter. The plan depends on how many pieces have each length, which is a table of at most `capacity` rows
whatever the corpus holds; only that table comes to the driver. The Martello-Toth reduction fixes bins that dominate
every other way to place their largest item (alone or with one partner), then the rest is placed by best fit in
decreasing order, both on counts of equal lengths at once. The plan says, for ranges of the pieces of a length, which
bins they fill; pieces are numbered within (length, bucket), so the numbering is a window over a small share of rows.

Defined results: a null text is an empty document (one piece, the end id alone); repeated rows are documents of their
own; documents that tie in length are told apart by id, piece and checksum; an empty table gives no rows; columns of the
input other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholia.llm.store import Stored

CAPACITY = 1024
END_ID = 2
#: Pieces of one length that one task numbers.
BUCKET_ROWS = 1_000_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Ids of a text by a byte-level vocabulary (`<name>.json`, its ranks beside it as `<name>.tiktoken`).

    The ranks hold the same vocabulary as the JSON file and give the same ids about four times as fast; `same_ids`
    checks that. With `special`, a special token's string in a text is its one id, as the JSON file's defaults have it;
    without, it is ordinary text.
    """

    def __init__(self, vocabulary: str, special: bool = False):
        import base64
        import json

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(vocabulary.replace(".json", ".tiktoken")), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        tokens = {}
        if special:
            with open(public_tokenizers.path(vocabulary), encoding="utf-8") as f:
                tokens = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        self.special = set(tokens)
        self.encoding = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=tokens)

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        return self.encoding.encode_to_numpy(text, allowed_special=self.special, disallowed_special=()).astype("<u4").tobytes()


def same_ids(vocabulary: str, texts: list[str]) -> bool:
    """Whether the encoder gives the ids of the JSON file for these texts."""
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(vocabulary))
    t.encode_special_tokens = True
    e = Encoder(vocabulary)
    return all(np.frombuffer(e.ids(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids for x in texts)


def _pieces(vocabulary: str, capacity: int, end_id: int, special: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary, special)
        end = np.array([end_id], "<u4").tobytes()
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

        def out(rows):
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = encoder.ids(text.as_py() or "") + end
                n = len(raw) // 4
                start, k = 0, 0
                length = n % capacity or capacity
                while start < n:
                    rows.append((doc_id, k, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)])))
                    start, k, length = start + length, k + 1, capacity
                if len(rows) > 20_000:
                    yield out(rows)
                    rows = []
            if rows:
                yield out(rows)

    return run


def pieces(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", capacity: int = CAPACITY, end_id: int = END_ID, special: bool = False) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of `docs` (doc_id, text)."""
    return docs.select("doc_id", "text").mapInArrow(_pieces(vocabulary, capacity, end_id, special), PIECES)


def reduce_and_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """[(number of bins, lengths in each of them)] that hold `counts[length]` pieces of every length.

    Works on counts, so its cost depends on the number of different lengths and not on the number of pieces.
    """
    left = {x: n for x, n in counts.items() if n > 0}
    out: list[tuple[int, list[int]]] = []

    def fix(n: int, items: list[int]) -> None:
        out.append((n, items))
        for x in items:
            left[x] -= n
            if not left[x]:
                del left[x]

    changed = True
    while changed:
        changed = False
        for x in sorted(left, reverse=True):
            while x in left:
                room = capacity - x
                sizes = sorted(left)
                fits = sizes[: bisect_right(sizes, room)]
                if fits and fits[-1] == x and left[x] == 1:
                    fits.pop()
                if not fits:  # alone: nothing else can go with it
                    fix(left[x], [x])
                    changed = True
                    continue
                # {x, best} dominates if it is full, or if whatever else can go with x fits into the place of best
                best = fits[-1]
                few = _least(fits, left, x, 3)
                if not (best == room or len(few) < 2 or few[0] + few[1] > room or ((len(few) < 3 or sum(few) > room) and _best_pair(fits, left, x, room) <= best)):
                    break
                fix(left[x] // 2 if best == x else min(left[x], left[best]), [x, best])
                changed = True
    # best fit, in decreasing order; bins with equal contents are one entry
    bins: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    for x in sorted(left, reverse=True):
        n = left[x]
        while n:
            room = min((r for r in bins if r >= x and bins[r]), default=0)
            if room:
                m, items = bins[room].pop()
                k = room // x
                full = min(m, n // k)
                if full:
                    bins[room - k * x].append((full, items + [x] * k))
                    n -= full * k
                    if m > full and n:  # the last bin takes what is left
                        bins[room - n * x].append((1, items + [x] * n))
                        n, full = 0, full + 1
                    if m > full:
                        bins[room].append((m - full, items))
                else:
                    bins[room - n * x].append((1, items + [x] * n))
                    if m > 1:
                        bins[room].append((m - 1, items))
                    n = 0
            else:
                k = capacity // x
                full, rest = divmod(n, k)
                if full:
                    bins[capacity - k * x].append((full, [x] * k))
                if rest:
                    bins[capacity - rest * x].append((1, [x] * rest))
                n = 0
    return out + [b for group in bins.values() for b in group]


def _least(fits: list[int], left: dict[int, int], x: int, k: int) -> list[int]:
    """The k smallest items beside one x."""
    out: list[int] = []
    for y in fits[: k + 1]:
        out += [y] * min(k, left[y] - (y == x))
    return out[:k]


def _best_pair(fits: list[int], left: dict[int, int], x: int, room: int) -> int:
    """The most that two items beside x can take."""
    best, hi = 0, len(fits) - 1
    for y in fits:
        while hi >= 0 and y + fits[hi] > room:
            hi -= 1
        if hi < 0 or fits[hi] < y:
            break
        z = fits[hi]
        if z == y and left[y] - (y == x) < 2:
            continue
        best = max(best, y + z)
    return best


def _ranges(plan: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, past the last rank, first sequence, pieces of that length in a bin, offset of the first)."""
    used: dict[int, int] = defaultdict(int)
    out, seq = [], 0
    for n, items in plan:
        at, by = 0, defaultdict(int)
        for x in items:
            by[x] += 1
        for x, k in by.items():
            out.append((x, used[x], used[x] + n * k, seq, k, at))
            used[x] += n * k
            at += x * k
        seq += n
    return out


def _place(before: dict[tuple[int, int], int], ranges: list[tuple[int, int, int, int, int, int]]):
    by: dict[int, np.ndarray] = {}
    for x in sorted({r[0] for r in ranges}):
        by[x] = np.array(sorted(r[1:] for r in ranges if r[0] == x), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, bucket, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "bucket", "rank"))
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            key = length * 1_000_000 + bucket
            order = np.argsort(key, kind="stable")
            for cut in np.split(order, np.flatnonzero(np.diff(key[order])) + 1) if len(order) else []:
                x = int(length[cut[0]])
                r = rank[cut] - 1 + before[x, int(bucket[cut[0]])]
                low, _, first, k, at = by[x][np.searchsorted(by[x][:, 0], r, side="right") - 1].T
                seq[cut] = first + (r - low) // k
                off[cut] = at + (r - low) % k * x
            yield pa.record_batch([b.column(i) for i in range(5)] + [pa.array(seq), pa.array(off)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, *, vocabulary: str = "byte_bpe_50k.json", capacity: int = CAPACITY, end_id: int = END_ID, bucket_rows: int = BUCKET_ROWS, special: bool = False) -> DataFrame:
    """Every piece of `docs` with its sequence_id and offset.

    A piece as long as a sequence is one, without any shuffle. Of the others only counts by (length, bucket) come to the
    driver, and only they and the plan go to the tasks: at most `capacity` and one for each `bucket_rows` pieces.
    """
    store = Stored(docs.sparkSession)
    p = store.keep(pieces(docs, vocabulary, capacity, end_id, special))
    counts = {r["length"]: r["n"] for r in p.groupBy("length").agg(F.count("*").alias("n")).collect()}
    full = p.where(F.col("length") == capacity)
    counts.pop(capacity, None)
    buckets = F.array(*[F.lit(1 + counts.get(x, 0) // bucket_rows) for x in range(capacity)])
    some = p.where(F.col("length") < capacity).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.get(buckets, F.col("length").cast("int"))).cast("int"))
    per = {(r["length"], r["bucket"]): r["n"] for r in some.groupBy("length", "bucket").agg(F.count("*").alias("n")).collect()}
    seen: dict[int, int] = defaultdict(int)
    before = {}
    for (length, bucket), n in sorted(per.items()):
        before[length, bucket] = seen[length]
        seen[length] += n
    plan = reduce_and_fit(counts, capacity)
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    placed = some.withColumn("rank", rank).mapInArrow(_place(before, _ranges(plan)), f"{PIECES}, sequence_id long, offset long")
    return placed.unionByName(full.withColumn("sequence_id", F.lit(sum(n for n, _ in plan)) + F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long")))
