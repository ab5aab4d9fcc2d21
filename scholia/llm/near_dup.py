"""Near-duplicate documents by bottom-k sketches of word shingles.

1. One hash function orders the shingles of a document; the k smallest are its sketch. Documents with equal sets are one
   node from here on, so groups of exact copies, however large, cost one member.
2. Inverted lists of the retained values generate overlaps. Two sketches whose overlap can pass step 4 have one of their
   rarest values in common (a prefix in the order of list length), so only those are listed, and a value that many texts
   share is no one's candidate unless almost all that a text retains is as common.
3. In each list all members meet one leader of their size first; what that links is one group. Then members outside of a
   list's largest group meet a few members of other groups, are grouped anew, meet more, and at last all that are still
   in other groups, dealt into blocks of a bounded size where a list is long. A member with many links finds one among
   few, so a group of m near copies costs about m comparisons, not m * m. Two texts below the
   threshold may share many lists; where these are met whole, they meet in the first of them only. A pair is let through only if its sizes and its parity signatures can reach the
   threshold: each shingle flips one bit of 512, so signatures differ in no more bits than the sets in shingles, an exact
   bound that loses nothing.
4. The share of the union's bottom k that both hold estimates the similarity; pairs five standard deviations below the
   threshold go.
5. The rest is confirmed on full sets.

Full sets are 64-bit hashes of the shingles. Nothing but counts reaches the driver.

Defined results: a null or empty text, or one of white space only, has no shingles and links with nothing; a text with
fewer words than a shingle has one, of all its words; rows with one doc_id and one text are alike in every column; rows
with one doc_id and different texts are one document that is linked with whatever any of its texts is linked with; a row
without doc_id has its text's component (null if no other row has one) and is kept only then; an empty table gives no
rows; other columns of the input are ignored; a very long text is hashed alone and costs memory for its own set.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm.components import connected_components
from scholia.llm.store import Stored
from scholia.llm.textvec import shingles, slices, tidy

#: Retained values: at similarity 0.8 the estimate from 48 has a standard deviation of 0.058.
SKETCH = 48
#: Standard deviations below the threshold at which an estimate ends a pair.
DEVIATIONS = 5
#: 64-bit words of a parity signature.
SIGNATURE = 8
#: Leaders that a document meets before groups are formed; what they leave apart meets in its lists.
LEADERS = 6
#: Members of a list that those outside of its largest group meet in the first round, and how many times more in each next.
ROUND_ROWS, ROUND_GROWTH = 32, 16
#: Members of a list that one task compares with others at once.
BLOCK_ROWS = 1024
#: Ids (of 32 bytes) that may be sent to every task to find their texts; more are joined by a shuffle.
MOST_BROADCAST_IDS = 1_000_000
#: Passes over a table that are made before it is shuffled instead.
MOST_PASSES = 4

_SIG = [f"s{i}" for i in range(SIGNATURE)]


def _longs(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    flat = np.concatenate(values) if values else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int64)))


def _keys(sets: list[np.ndarray]) -> pa.Array:
    return pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary())


def _parity(s: np.ndarray) -> np.ndarray:
    odd = np.bincount(s & (64 * SIGNATURE - 1), minlength=64 * SIGNATURE) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def _sketches(width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in slices(b.column(1)):
                sets = shingles(texts, width)
                sig = np.stack([_parity(s) for s in sets])
                fixed = [b.column(0).slice(at, len(texts)), pa.array([len(s) for s in sets], pa.int64()), _keys(sets), _longs([s[:k] for s in sets])]
                yield pa.record_batch([*fixed, *(pa.array(sig[:, i]) for i in range(SIGNATURE))], names=["doc_id", "n", "key", "sketch", *_SIG])

    return tidy(run)


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, texts in slices(b.column(1)):
                sets = shingles(texts, width)
                yield pa.record_batch([_keys(sets), _longs(sets)], names=["key", "s"])

    return tidy(run)


def _can_link(na: str, nb: str, sa: str, sb: str, percent: int) -> Column:
    """Sizes and signatures that can reach the threshold: of na + nb shingles that two sets have together, linked ones
    have (100 - percent) / (100 + percent) at most on one side only."""
    apart = " + ".join(f"bit_count({sa}{x} ^ {sb}{x})" for x in _SIG)
    return F.expr(f"least({na}, {nb}) * 100 >= {percent} * greatest({na}, {nb}) and ({apart}) * {100 + percent} <= {100 - percent} * ({na} + {nb})")


def _meetings(few: DataFrame, some: DataFrame, met: int, can_link: Column) -> DataFrame:
    """Pairs (a, b) of different groups that meet in a list; `pre` are the lists of a member before this one, in one order.

    Lists are ordered by their length, so of those that two share, the first is met whole before or with the others: once
    is enough. Where all members are in the round, it also is for two that are both outside of the largest group.
    """
    x, y = few.alias("x"), some.alias("y")
    meet = (F.col("x.t") == F.col("y.t")) & (F.col("x.bx") == F.col("y.bx")) & (F.col("x.by") == F.col("y.by")) & (F.col("x.g") != F.col("y.g")) & F.expr(f"y.in_main or x.m > {met} or x.node < y.node")
    first = F.expr(f"x.m > {met} or not arrays_overlap(x.pre, y.pre)")
    return x.join(y, meet & can_link & first).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))


def _ends(pairs: DataFrame) -> DataFrame:
    """Each end (node) of pairs (a, b) once."""
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def _rows_of(table: DataFrame, ids: DataFrame, name: str, most: int = MOST_BROADCAST_IDS) -> DataFrame:
    """The rows of a wide table whose id is among the different `ids`. Only what is wanted of the table is shuffled later:
    the ids go to every task, in several passes over the table where they are many, unless these would be very many."""
    count = ids.count()
    parts = max(1, -(-count // most))
    if parts > MOST_PASSES:
        return table.join(ids, name, "left_semi")
    part = F.pmod(F.xxhash64(name), F.lit(parts))
    passes = [table.where(part == i).join(F.broadcast(ids.where(part == i)), name, "left_semi") for i in range(parts)]
    return reduce(DataFrame.unionByName, passes)


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, sketch: int = SKETCH, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of `docs` (doc_id, text).

    Documents are linked if 100 * common shingles >= `percent` * shingles of either.
    """
    store = Stored(docs.sparkSession)
    share = percent / 100
    least = share - DEVIATIONS * math.sqrt(share * (1 - share) / sketch)
    sig = ", ".join(f"{x} long" for x in _SIG)
    rows = store.keep(docs.select("doc_id", "text").mapInArrow(_sketches(width, sketch), f"doc_id long, n long, key binary, sketch array<long>, {sig}"))
    nodes = rows.where("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first(F.struct("n", "sketch", *_SIG)).alias("x"))
    nodes = store.keep(nodes.select("key", "rep", "x.*", F.monotonically_increasing_id().alias("node"), F.size("x.sketch").alias("held")))

    # inverted lists of the rarest values of each sketch
    values = nodes.select("node", F.explode("sketch").alias("v"))
    lists = store.keep(values.groupBy("v").agg(F.count("*").alias("m")).where("m > 1").withColumn("t", F.monotonically_increasing_id()))
    listed = values.join(lists, "v").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("m", "t"))).alias("l"))
    # a pair needs so many common values; all partners of a small set have all their shingles in the sketch
    needed = f"if(n * 100 <= {percent * sketch}, ceil(n * {percent} / 100), ceil(held * {least!r}D))"
    prefix = nodes.select("node", "n", "held", *_SIG).join(listed, "node").withColumn("take", F.expr(f"int(size(l) - {needed} + 1)"))
    prefix = store.keep(prefix.where("take > 0").select("node", "n", *_SIG, F.expr("slice(l, 1, take).t").alias("ts")))
    store.drop(lists)
    keyed = prefix.select("node", "n", *_SIG, F.posexplode("ts").alias("at", "t")).withColumn("band", F.expr(f"int(floor(ln(n) / ln(100 / {percent})))"))

    estimate = F.expr(f"size(array_intersect(slice(array_sort(array_union(sa, sb)), 1, {sketch}), array_intersect(sa, sb))) / least({sketch}, size(array_union(sa, sb)))")

    def estimated(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b), those that the union sketch leaves."""
        pairs = store.keep(pairs)
        ends = store.keep(_ends(pairs))
        sketches = store.keep(_rows_of(nodes.select("node", "sketch"), ends, "node"))
        p = pairs.join(sketches.selectExpr("node as a", "sketch as sa"), "a").join(sketches.selectExpr("node as b", "sketch as sb"), "b")
        left = store.keep(p.where(estimate >= least).select("a", "b"))
        store.drop(pairs, ends, sketches)
        return left

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b), those whose full sets are similar enough."""
        some = store.keep(_ends(pairs))
        ends = store.keep(_rows_of(nodes.select("node", "key", "rep"), some, "node"))
        store.drop(some)
        count = ends.count()
        if not count:
            return pairs
        small = F.broadcast if count <= MOST_BROADCAST_IDS else lambda x: x
        texts = docs.select("doc_id", "text").join(small(ends.selectExpr("rep as doc_id").distinct()), "doc_id", "left_semi").select("doc_id", "text")
        sets = store.keep(texts.mapInArrow(_sets(width), "key binary, s array<long>").join(small(ends.select("key", "node")), "key").select("node", "s"))
        p = pairs.join(sets.selectExpr("node as a", "s as sa"), "a").join(sets.selectExpr("node as b", "s as sb"), "b").withColumn("both", F.size(F.array_intersect("sa", "sb")))
        links = store.keep(p.where(f"100 * both >= {percent} * (size(sa) + size(sb) - both)").select("a", "b"))
        store.drop(ends, sets)
        return links

    # every member of a list meets a leader of its size: one for all lists of equal members, so that copies have one
    leaders = keyed.groupBy("t", "band").agg(F.min_by(F.struct("node", "n", *_SIG), F.xxhash64("node")).alias("l"), F.count("*").alias("m")).where("m > 1").drop("m")
    led = keyed.join(leaders, ["t", "band"]).where("node <> l.node").where(_can_link("n", "l.n", "", "l.", percent))
    led = led.groupBy("node").agg(F.slice(F.sort_array(F.collect_set(F.struct(F.xxhash64("l.node").alias("h"), F.col("l.node").alias("r")))), 1, LEADERS).alias("ls"))
    star = led.select("node", F.explode("ls.r").alias("r")).select(F.least("node", "r").alias("a"), F.greatest("node", "r").alias("b")).distinct()
    links = confirmed(estimated(star))
    groups = store.keep(connected_components(links, store))

    sizes = store.keep(keyed.groupBy("t").agg(F.count("*").alias("m")).where("m > 1"))
    longest = sizes.agg(F.max("m")).first()[0] or 0
    # rows of lists stay narrow; signatures and lists before this one come to those that meet
    member = store.keep(keyed.select("node", "at", "t").join(sizes, "t"))
    store.drop(sizes)
    met = 0
    while met < longest:
        before, met = met, met * ROUND_GROWTH or ROUND_ROWS
        # in lists that no round had whole yet, those outside of the largest group meet members of other groups
        g = member.where(f"m > {before}").join(groups.selectExpr("id as node", "component"), "node", "left").withColumn("g", F.coalesce("component", "node"))
        g = store.keep(g.drop("component"))
        parts = g.groupBy("t", "g").agg(F.count("*").alias("m"))
        parts = parts.groupBy("t").agg(F.max_by("g", F.struct("m", "g")).alias("main"), F.count("*").alias("groups"), (F.sum("m") - F.max("m")).alias("others")).where("groups > 1")
        # both sides are dealt into blocks, so a task has a bounded number of either
        split = g.join(parts.select("t", "main", "others"), "t").withColumn("own", F.expr(f"1 + others div {block_rows}")).withColumn("blocks", F.expr(f"1 + least(m, {met}) div {block_rows}"))
        own = prefix.select("node", "n", *_SIG, "ts")
        few = split.where("g <> main").select("t", "node", "at", "g", "m", "own", "blocks").join(own, "node").withColumn("pre", F.expr("slice(ts, 1, at)")).drop("ts", "at")
        few = few.withColumn("bx", F.expr("pmod(xxhash64(node, 2), own)")).withColumn("by", F.explode(F.expr("sequence(0L, blocks - 1)"))).drop("own", "blocks")
        some = split.where(f"m <= {met} or pmod(xxhash64(node, 1), m) < {met}").selectExpr("t", "node", "at", "g", "g = main as in_main", "own", "blocks").join(own, "node").withColumn("pre", F.expr("slice(ts, 1, at)")).drop("ts", "at")
        some = some.withColumn("by", F.expr("pmod(xxhash64(node), blocks)")).withColumn("bx", F.explode(F.expr("sequence(0L, own - 1)"))).drop("own", "blocks")
        late = _meetings(few, some, met, _can_link("x.n", "y.n", "x.", "y.", percent)).distinct()
        links = confirmed(estimated(late))
        store.drop(g)
        if links.take(1):
            groups = store.keep(connected_components(groups.selectExpr("id as a", "component as b").unionByName(links), store))

    # texts of one doc_id are one document
    texts = rows.where("key is not null and doc_id is not null").select("doc_id", "key", F.xxhash64("key").alias("h"))
    several = store.keep(texts.groupBy("doc_id").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high").select("doc_id"))
    if several.take(1):
        own = texts.join(several, "doc_id").join(nodes.select("key", "node"), "key").select("doc_id", "node")
        links = groups.selectExpr("id as a", "component as b").unionByName(own.join(own.groupBy("doc_id").agg(F.min("node").alias("b")), "doc_id").selectExpr("node as a", "b"))
        groups = connected_components(links, store)
    # a component is named by its smallest doc_id
    named = store.keep(nodes.select("key", "rep", "node").join(groups.selectExpr("id as node", "component"), "node", "left"))
    names = named.where("component is not null").groupBy("component").agg(F.min("rep").alias("name"))
    known = store.keep(named.join(names, "component", "left").selectExpr("key", "coalesce(name, rep) component_id"))
    store.drop(nodes, prefix, member, several, named)
    full = rows.where("key is not null").join(known, "key", "left").select("doc_id", "n", "component_id")
    out = full.unionByName(rows.where("key is null").selectExpr("doc_id", "n", "doc_id as component_id"))
    return out.selectExpr("doc_id", "n as n_shingles", "component_id", "coalesce(doc_id = component_id, component_id is null) as kept")
