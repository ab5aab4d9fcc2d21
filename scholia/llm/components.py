"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.store import Stored


#: Ends that a task holds at once: bounds its memory.
HELD_IDS = 1_000_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces a partition's links by spanning stars of their components, some links at a time."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    def stars() -> Iterator[pa.RecordBatch]:
        ids = list(parent)
        for i in range(0, len(ids), 50_000):
            part = ids[i : i + 50_000]
            yield pa.record_batch([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], names=["u", "v"])
        parent.clear()

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            u, v = root(u), root(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
        if len(parent) > HELD_IDS:
            yield from stars()
    yield from stars()


def connected_components(links: DataFrame, store: Stored) -> DataFrame:
    """(id, component) of every end of a link (columns a, b: long); component is the smallest id that can be reached.

    Every round joins links with the smallest neighbour of their ends and shuffles by that id; no link, vertex or
    component leaves the executors, and each round's links are written to the shared folder.
    """
    e = links.where("a is not null and b is not null and a <> b").selectExpr("greatest(a, b) u", "least(a, b) v")
    e = store.keep(e.mapInArrow(_forest, "u long, v long").where("u <> v").distinct())
    state = None
    while True:
        both = e.unionByName(e.selectExpr("v as u", "u as v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) m")
        large = both.where("v > u").join(low, "u").selectExpr("v as u", "m as v").where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").selectExpr("v as u", "m as v").unionByName(low.selectExpr("u", "m as v")).distinct()
        new = store.keep(small)
        store.drop(e)
        e = new
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    return e.selectExpr("u as id", "v as component").unionByName(e.selectExpr("v as id", "v as component").distinct())
