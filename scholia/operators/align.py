"""Embedding and cosine alignment of chunks with standards."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions.standards import FLAG_SCORE, grade_distance
from scholia.sources.corpus import stored

TOP_K, THRESHOLD, PENALTY = 5, 0.65, 0.02
#: A character that isn't white space.
INK = r"[^ \t\n\f\r]"
#: Rows and bytes of vectors in a block, at most; each task compares one block of either side.
BLOCK_ROWS = 4096
MOST_BLOCK = 16 << 20


def pending(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Live chunks without an embedding; chunks without an id are ignored."""
    return chunks.where("stale = 0 and chunk_id is not null").join(embeddings.select("chunk_id"), "chunk_id", "left_anti")


def embed_input(title: Column, content: Column, limit: int = 2000) -> Column:
    return F.substring(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(content, F.lit(""))), 1, limit)


def hashing_embedder(dimensions: int = 64) -> Callable[[list[str]], list[list[float] | None]]:
    """A deterministic embedder for tests: signed counts of hashed words. No text is without a direction: where these counts
    cancel out it is that of the counts without signs, where there are no words the first one."""

    def embed(texts: list[str]) -> list[list[float] | None]:
        out = []
        for t in texts:
            v = np.zeros(dimensions)
            hashes = [int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") for w in t.lower().split()]
            for h in hashes:
                v[h % dimensions] += 1 if h >> 63 else -1
            if not v.any():
                for h in hashes or [0]:
                    v[h % dimensions] += 1
            out.append(v.tolist())
        return out

    return embed


def embed_pending(chunks: DataFrame, embeddings: DataFrame, embedder: Callable[[list[str]], list[list[float] | None]], *, model: str, batch: int = 16, tries: int = 3) -> DataFrame:
    """Embeddings of the pending chunks by a pluggable embedder; what it fails on yields no row and stays pending.

    A chunk of white space only (title and content) has nothing to embed; one whose text begins later than the embedder's
    input is embedded like any other."""
    filled = F.col("title").rlike(INK) | F.col("content").rlike(INK)
    texts = pending(chunks, embeddings).where(filled).select("chunk_id", embed_input(F.col("title"), F.col("content")).alias("text"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for at in range(0, len(pdf), batch):
                some = pdf.iloc[at : at + batch]
                for attempt in range(tries):
                    try:
                        found = embedder(some["text"].tolist())
                        break
                    except Exception:
                        found = [None] * len(some) if attempt == tries - 1 else None
                rows += [(i, model, v, len(v)) for i, v in zip(some["chunk_id"], found, strict=True) if v is not None]
            yield pd.DataFrame(rows, columns=["chunk_id", "model", "vector", "dimensions"])

    return texts.mapInPandas(run, "chunk_id string, model string, vector array<double>, dimensions int")


def is_generic_exercise(content_type: Column, title: Column) -> Column:
    """Exercise sets of no topic, by the end of their title."""
    t = F.rtrim(title)
    return (content_type == "exercise_set") & (t.endswith("Writing Exercises") | t.endswith("Self Check"))


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / (np.sqrt((x * x).sum(1, keepdims=True)) + 1e-9)


def _matrix(t: pa.Table) -> np.ndarray:
    flat = t["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
    return unit_rows(flat.reshape(len(t), -1))


#: Cells that vectors are dealt into at most, each around a vector of the right side.
CELLS = 256


def in_cells(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """The rows with `cell`, the pivot that is nearest by angle, and `far`, the angle to it; -1 and null for vectors without a
    direction or of another length."""
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        for b in batches:
            v = b.column(b.schema.get_field_index("vector"))
            sizes = pc.fill_null(pc.list_value_length(v), -1).to_numpy()
            cell, far = np.full(len(b), -1, np.int32), np.full(len(b), np.nan)
            rows = np.flatnonzero(sizes == p.shape[1])
            if len(rows):
                x = v.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), -1)
                norm = np.sqrt((x * x).sum(1))
                good = np.isfinite(norm) & (norm > 1e-2)
                cos = (x[good] / norm[good, None]) @ p.T
                cell[rows[good]] = cos.argmax(1)
                far[rows[good]] = np.arccos(np.clip(cos.max(1), -1, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(far, mask=np.isnan(far))], names=[*b.schema.names, "cell", "far"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{kinds}, cell int, far double")


def cell_bounds(pivots: np.ndarray, left_far: dict[int, float], right_far: dict[int, float]) -> dict[tuple[int, int], float]:
    """For each pair of cells the highest cosine that any two of their vectors can have: the angle between them is at least
    that of the pivots less how far either cell reaches."""
    angle = np.arccos(np.clip(pivots @ pivots.T, -1, 1)) if len(pivots) else np.empty((0, 0))
    reach = lambda a, b: max(0.0, angle[a, b] - left_far[a] - right_far[b] - 1e-9)
    return {(a, b): 1.0 if a < 0 or b < 0 else float(np.cos(min(np.pi, reach(a, b)))) for a in left_far for b in right_far}


def _alike(t: pa.Table, by: str | None) -> dict[tuple[int, object], pa.Table]:
    """The rows of a table by the length of their vectors and by `by`."""
    sizes = pc.list_value_length(t["vector"])
    out = {}
    for d in pc.unique(sizes).to_pylist():
        some = t.filter(pc.equal(sizes, d))
        for x in pc.unique(some[by]).to_pylist() if by else [None]:
            out[d, x] = some.filter(pc.equal(some[by], x) if x is not None else pc.is_null(some[by])) if by else some
    return out


def _block_pairs(left: DataFrame, right: DataFrame, penalty: Callable[[pa.Table, pa.Table], np.ndarray | float], *, k: int, threshold: float, digits: int, block: int, most: int, by: str | None = None) -> DataFrame:
    """(left_id, right_id, score) of the k best right rows of each left row (id, vector, ...): cosine less `penalty`; with `by`,
    of each value that this column of the right side has.

    A side of one block at most (counted first: `block` rows and `most` bytes) goes to every task as it is, and the other side
    stays where it lies. Else both are dealt into blocks by a hash, every pair of blocks is one group, and only counts come
    to the driver. Blocks are parts of cells, each the vectors around a pivot; pairs of cells whose angles keep all scores
    below `threshold` are not compared. Then the cells that are nearest to each left cell are compared first, and of the rest only
    those that can still reach the k-th score of a row. k of each row are kept in each task and merged by a window. Vectors
    of different lengths are not compared."""
    count = lambda df: df.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first()
    n, m = count(left), count(right)
    rows = max(1, min(block, most // (8 * max(n["d"] or 1, m["d"] or 1, 1))))
    own, other = max(1, -(-n["n"] // rows)), max(1, -(-m["n"] // rows))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        got = [pd.DataFrame({"left_id": [], "right_id": [], "score": []})]
        if len(a) and len(b):
            y, right_id = _matrix(b), b["id"].to_numpy()
            for at in range(0, len(a), 1024):
                some = a.slice(at, 1024)
                s = _matrix(some) @ y.T - penalty(some, b)
                c = min(k, s.shape[1])
                floor = np.partition(s, s.shape[1] - c, axis=1)[:, s.shape[1] - c, None]
                i, j = np.nonzero((s >= threshold) & (s >= floor - 1e-9))  # ties at the edge stay for the ranking
                g = pd.DataFrame({"left_id": some["id"].to_numpy()[i], "right_id": right_id[j], "score": s[i, j]})
                g["score"] = g["score"].round(digits)
                got.append(g.sort_values(["score", "right_id"], ascending=[False, True]).groupby("left_id", sort=False).head(k))
        out = pd.concat(got[1:]) if len(got) > 1 else got[0]
        cells = {"left_id": pa.array(out["left_id"], a.schema.field("id").type), "right_id": pa.array(out["right_id"], b.schema.field("id").type), "score": pa.array(out["score"], pa.float64())}
        if by:
            cells[by] = pa.array([b[by][0].as_py() if len(b) else None] * len(out), b.schema.field(by).type)
        return pa.table(cells)

    lt, rt = left.schema["id"].dataType.simpleString(), right.schema["id"].dataType.simpleString()
    named = f", {by} {right.schema[by].dataType.simpleString()}" if by else ""
    if min(own, other) == 1:
        small, large, swapped = (right, left, False) if other == 1 else (left, right, True)
        sent = left.sparkSession.sparkContext.broadcast(_alike(small.where("vector is not null").toArrow(), by if not swapped else None))  # one block

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for (d, _), some in _alike(pa.table(batch), by if swapped else None).items():
                    for (e, _), known in sent.value.items():
                        if d == e:
                            yield from run(known, some).to_batches() if swapped else run(some, known).to_batches()

        out = large.where("vector is not null").mapInArrow(meet, f"left_id {lt}, right_id {rt}, score double{named}")
    else:
        out = _by_cells(left, right, run, k=k, threshold=threshold, rows=rows, cells=min(CELLS, max(own, other)), by=by, kinds=f"left_id {lt}, right_id {rt}, score double{named}")
    w = Window.partitionBy("left_id", *([by] if by else [])).orderBy(F.desc("score"), "right_id")
    return out.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).drop("n")


def _by_cells(left: DataFrame, right: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], *, k: int, threshold: float, rows: int, cells: int, by: str | None, kinds: str) -> DataFrame:
    """The best pairs of cells first, then those that the k-th scores leave. Pivots, and counts and reach of each cell, come to the
    driver: `cells` rows of each side."""
    spark = left.sparkSession
    some = right.where("vector is not null").orderBy(F.xxhash64("id", "vector")).limit(cells).select("vector").collect()
    d = len(some[0]["vector"]) if some else 0
    pivots = np.array([r["vector"] for r in some if len(r["vector"]) == d and None not in r["vector"]], float).reshape(-1, d)
    pivots = pivots[np.isfinite(pivots).all(1) & ((pivots * pivots).sum(1) > 1e-12)]
    pivots = unit_rows(pivots)
    laid = []
    for df, name in ((left, "a"), (right, "b")):
        df = df.where("vector is not null")
        df = in_cells(df, pivots) if len(pivots) else df.withColumn("cell", F.lit(-1)).withColumn("far", F.lit(None).cast("double"))
        laid.append(stored(df.withColumn("d", F.size("vector"))))
    sizes = [{r["cell"]: r for r in df.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()} for df in laid]
    parts = [{c: max(1, -(-r["n"] // rows)) for c, r in side.items()} for side in sizes]
    bound = cell_bounds(pivots, *({c: r["far"] for c, r in side.items()} for side in sizes))
    open_ = {p for p, x in bound.items() if x >= threshold - 1e-6}

    def compared(pairs: set[tuple[int, int]]) -> DataFrame:
        number = [(a, b, parts[0][a], parts[1][b]) for a, b in sorted(pairs)]
        table = lambda: F.broadcast(spark.createDataFrame(number, "ca int, cb int, na int, nb int"))  # noqa: E731  `cells` squared rows at most
        keys = ["ca", "cb", "pa", "pb", "d"]
        part = lambda n: F.pmod(F.xxhash64("id", "vector"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        x = laid[0].drop("far").join(table(), F.col("cell") == F.col("ca")).withColumn("pa", part("na")).withColumn("pb", every("nb"))
        y = laid[1].drop("far").join(table(), F.col("cell") == F.col("cb")).withColumn("pb", part("nb")).withColumn("pa", every("na"))
        if by:  # the left rows meet every part
            x, keys = x.crossJoin(F.broadcast(laid[1].select(F.col(by).alias("part_of")).distinct())), [*keys, "part_of"]
            y = y.withColumn("part_of", F.col(by))
        x, y = x.drop("na", "nb", "cell"), y.drop("na", "nb", "cell")
        return x.groupBy(*keys).cogroup(y.groupBy(*keys)).applyInArrow(run, kinds)

    # for each left cell the cells of highest bound that have k rows together
    first: set[tuple[int, int]] = set()
    for a in sizes[0]:
        have = 0
        for x, b in sorted(((-x, b) for (c, b), x in bound.items() if c == a and (c, b) in open_)):
            if have >= k:
                break
            first.add((a, b))
            have += sizes[1][b]["n"]
    found = stored(compared(first))
    key = ["left_id", *([by] if by else [])]
    w = Window.partitionBy(*key).orderBy(F.desc("score"), "right_id")
    kth = found.withColumn("n", F.row_number().over(w)).where(F.col("n") == k).groupBy("left_id").agg(F.min("score").alias("kth"), F.count("*").alias("full"))
    full = laid[1].select(F.count_distinct(by)).first()[0] if by else 1  # rows lack a bound until they have k of every part
    least = laid[0].select(F.col("id").alias("left_id"), "cell").join(kth, "left_id", "left")
    least = least.groupBy("cell").agg(F.min(F.when(F.col("full") == full, F.col("kth")).otherwise(-3.0)).alias("least")).collect()
    least = {r["cell"]: r["least"] if r["least"] is not None else -3.0 for r in least}
    rest = {(a, b) for a, b in open_ - first if bound[a, b] >= least[a] - 1e-6}
    return found.unionByName(compared(rest)) if rest else found


def cosine_top_k(left: DataFrame, right: DataFrame, *, k: int, threshold: float, block: int = BLOCK_ROWS, most: int = MOST_BLOCK, by: str | None = None) -> DataFrame:
    """(left_id, right_id, score) of the k right rows with the highest cosine of each left row (id, vector), from `threshold`;
    with `by`, the k of each value of that column of the right rows, which is a column of the result then."""
    right = right.select("id", "vector", *([by] if by else []))
    return _block_pairs(left.select("id", "vector"), right, lambda a, b: 0.0, k=k, threshold=threshold, digits=9, block=block, most=most, by=by)


def align(chunks: DataFrame, vectors: DataFrame, standards: DataFrame, standard_vectors: DataFrame, *, k: int = TOP_K, threshold: float = THRESHOLD, flag: float = FLAG_SCORE, penalty: float = PENALTY, system: str | None = None, books: list[str] | None = None, block: int = BLOCK_ROWS, most: int = MOST_BLOCK) -> DataFrame:
    """Every live chunk's k best standards by cosine less `penalty` for each year outside its grade band, from `threshold`.

    chunks: chunk_id, title, content_type, grade_band, book_id, stale; vectors: chunk_id, vector; standards: standard_id,
    system, grade; standard_vectors: standard_id, vector. The penalty is the same for all chunks of a band, so a standard
    carries its years for each band (a fixed few).
    """
    s = standards.where(F.col("system") == system) if system else standards
    names = ("K-5", "K-8", "6-8", "9-12", "college")
    years = F.array(*[grade_distance(F.lit(b), F.col("grade")).cast("double") for b in names])
    s = s.join(standard_vectors, "standard_id").select(F.col("standard_id").alias("id"), years.alias("years"), "vector")
    c = chunks.where("stale = 0").where(~F.coalesce(is_generic_exercise(F.col("content_type"), F.col("title")), F.lit(False)))
    c = c.where(F.col("book_id").isin(books)) if books else c
    c = c.join(vectors, "chunk_id").select(F.col("chunk_id").alias("id"), "grade_band", "vector")
    place = {b.lower(): i for i, b in enumerate(names)}

    def less(a: pa.Table, b: pa.Table) -> np.ndarray:
        band = np.array([place.get((x or "").strip().lower(), -1) for x in a["grade_band"].to_pylist()])
        far = np.array(b["years"].to_pylist(), float).reshape(len(b), len(names)).T * penalty
        return np.where(band[:, None] >= 0, far[band], 0)

    found = _block_pairs(c, s, less, k=k, threshold=threshold, digits=12, block=block, most=most)
    return found.select(F.col("left_id").alias("chunk_id"), F.col("right_id").alias("standard_id"), F.round("score", 4).alias("alignment_score"), (F.col("score") >= flag).alias("flagged"))


def alignment_summary(chunks: DataFrame, aligned: DataFrame) -> DataFrame:
    """Chunks with an alignment, alignments, those to annotate, generic chunks skipped."""
    skipped = chunks.where("stale = 0").agg(F.count_if(is_generic_exercise(F.col("content_type"), F.col("title"))).alias("skipped"))
    return aligned.agg(F.countDistinct("chunk_id").alias("chunks"), F.count("*").alias("alignments"), F.count_if("flagged").alias("to_annotate")).crossJoin(skipped)
