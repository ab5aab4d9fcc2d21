"""Joins on keys of which a few may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than this share of the rows: at most so many keys can be.
HOT_KEYS = 2048


def attach(rows: DataFrame, table: DataFrame, keys: list[str], counted: str, total: int, *, row_bytes: int = 256, most_bytes: int = 16 << 20) -> DataFrame:
    """`rows` with the columns of `table`, which has one row for each key and, in `counted`, how many of the `total` rows have it.

    Rows of hot keys meet a broadcast of these: fewer than HOT_KEYS keys can hold more than total / HOT_KEYS rows each, so
    its size has a proven bound (with wide rows fewer keys are hot, so that it stays below `most_bytes`). All other keys are
    shuffled, none of which holds more rows than that. The result is what a plain inner join gives.
    """
    hot = max(1, min(HOT_KEYS, most_bytes // row_bytes))
    often = F.col(counted) > total / hot
    name = "_hot"
    few = F.broadcast(table.where(often))
    marked = rows.join(F.broadcast(table.where(often).select(*keys, F.lit(True).alias(name))), keys, "left")
    rest = marked.where(F.col(name).isNull()).drop(name).join(table.where(~often), keys)
    return rows.join(few, keys).unionByName(rest)
