"""A prefix trie of conversations, by ternary search trees over ranges of sorted conversations.

Turns are dictionary-encoded: each different (role, text) gets a long. A conversation is then an array of longs and of byte
lengths. Equal rebuilt conversations become one with a count. These are sorted and cut into range shards of bounded size; a
shard builds a ternary search tree (the median conversation first, so that each node's siblings are balanced), walks it with
an explicit stack and adds members, leaves and savings from the last node to the first. A node on the path that a shard's
first conversation shares with the one before it, or its last with the one after it, is a boundary node: it is in more than
one shard. Every such node is new in exactly one shard, the first that has it, and only that one counts it as a child or
subtracts its one kept copy; so all values of boundary nodes are sums over shards, whatever the depth, and are merged by
one aggregate. Their smallest member then goes back to the shards for the nodes below.

Defined results: turns are ordered by `turn`, null first, equal ones by a hash of role and text; null role or text is empty;
repeated rows are turns like any other; rows without conv_id belong to no conversation; a very long text is one turn; columns
beside conv_id, turn, role and text are ignored; an empty table has no conversation and so no node, not even the root. One
rebuilt conversation is one row of 12 bytes a turn, the largest thing that a task holds beside a shard. Turns and
conversations are told apart by 128 bits of a hash. Spark's range partitioner brings a sample of a hundred conversations a
partition to the driver, as for every sort.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm.spread import attach
from scholia.llm.store import Stored

#: A rebuilt conversation takes up to HEAD - 1 turns of the one whose id is divisible by GROUP.
HEAD, GROUP = 9, 5
#: Turns of a shard (one longer conversation is a shard of its own).
SHARD_TURNS = 1 << 16
#: Bytes of conversation ids that are hashed as one row.
PIECE_BYTES = 1 << 15
EMPTY = hashlib.sha256(b"").hexdigest()

NODE = "shard long, key binary, parent_key binary, boundary boolean, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _codes(*what: Column) -> list[Column]:
    return [F.xxhash64(*what), F.xxhash64(F.lit(7), *what)]


def encode(turns: DataFrame, store: Stored) -> DataFrame:
    """(conv_id, ids, sizes): the codes and byte lengths of each conversation's turns, in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    a, b = _codes(role, text)
    rows = turns.where("conv_id is not null").select("conv_id", "turn", a.alias("ka"), b.alias("kb"), F.octet_length(text).alias("size"))
    rows = store.keep(rows)  # texts are read once
    book = store.keep(rows.groupBy("ka", "kb").agg(F.count("*").alias("rows"), F.min("size").alias("size")).withColumn("id", F.monotonically_increasing_id()))
    total = book.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    coded = attach(rows.select("conv_id", "turn", "ka", "kb"), book, ["ka", "kb"], "rows", total, row_bytes=64)
    place = F.struct(F.col("turn").isNotNull().alias("o"), F.coalesce("turn", F.lit(0)).alias("t"), "ka", "kb", "id", "size")
    gathered = coded.groupBy("conv_id").agg(F.array_sort(F.collect_list(place)).alias("s"))
    return gathered.select("conv_id", F.col("s.id").alias("ids"), F.col("s.size").cast("array<long>").alias("sizes"))


def rebuild(convs: DataFrame) -> DataFrame:
    """The first h turns of the first conversation of the group, then those of the conversation itself after its first h."""
    h = (F.crc32(F.col("conv_id").cast("string")) % HEAD).cast("int")
    heads = convs.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), F.slice("ids", 1, HEAD - 1).alias("base_ids"), F.slice("sizes", 1, HEAD - 1).alias("base_sizes"))
    both = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP).withColumn("h", h).join(heads, "base", "left")
    none = F.array().cast("array<long>")
    join = lambda own, base: F.concat(F.slice(F.coalesce(base, none), 1, F.col("h")), F.slice(own, F.col("h") + 1, F.size(own)))
    return both.select("conv_id", join("ids", "base_ids").alias("ids"), join("sizes", "base_sizes").alias("sizes"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sa, sb, conv_id) in order -> runs of ids of one conversation text, joined by commas, as rows of bounded size."""
    schema = pa.schema([("sa", pa.int64()), ("sb", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
    key, first, run, size, out, held = None, None, [], 0, [], 0

    def close():
        nonlocal run, size, held
        out.append((*key, first, ",".join(run)))
        held += size
        run, size = [], 0

    def table():
        nonlocal out, held
        b = pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema=schema)
        out, held = [], 0
        return b

    for b in batches:
        for sa, sb, c in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if run and (key != (sa, sb) or size > PIECE_BYTES):
                close()
                if held > 1 << 20 or len(out) > 10_000:
                    yield table()
            if not run:
                key, first = (sa, sb), c
            run.append(str(c))
            size += len(run[-1]) + 1
    if run:
        close()
    yield table()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sa, sb, first, ids) in order -> one digest for each (sa, sb), from piece to piece."""
    key, state = None, None
    for b in batches:
        done = []
        for sa, sb, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
            if key != (sa, sb):
                if state:
                    done.append((*key, state.hexdigest()))
                key, state = (sa, sb), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield _digest_rows(done)
    yield _digest_rows([(*key, state.hexdigest())] if state else [])


def _digest_rows(done: list[tuple[int, int, str]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["sa", "sb", "sha"])


def ends(convs: DataFrame) -> DataFrame:
    """(sa, sb, sha): of each different conversation the digest of the ids that have it."""
    run = convs.select("sa", "sb", "conv_id").repartitionByRange("sa", "sb", "conv_id").sortWithinPartitions("sa", "sb", "conv_id")
    pieces = run.mapInArrow(_pieces, "sa long, sb long, first long, ids string")
    return pieces.repartition("sa", "sb").sortWithinPartitions("sa", "sb", "first").mapInArrow(_digests, "sa long, sb long, sha string")


def _cut(shard_turns: int):
    """Sorted rows (ids, ...) -> the same with their shard: numbers of one partition follow each other, from partition << 32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, held = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            shards = []
            for turns in pc.list_value_length(b.column(0)).to_pylist():
                if held and held + turns > shard_turns:
                    shard, held = shard + 1, 0
                held += turns + 1
                shards.append(shard)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shards, pa.int64())], names=[*b.schema.names, "shard"])

    return run


def shared_prefixes(cut: DataFrame, store: Stored) -> DataFrame:
    """(shard, next, shared): how long a prefix the last conversation of a shard and the first of the next one have in common.

    Only the last shard number of each partition comes to the driver.
    """
    sides = store.keep(cut.groupBy("shard").agg(F.min("ids").alias("lowest"), F.max("ids").alias("highest")))
    last = sorted(r["m"] for r in sides.groupBy(F.shiftright("shard", 32).alias("p")).agg(F.max("shard").alias("m")).collect())
    jumps = [(m, b >> 32 << 32) for m, b in zip(last, last[1:], strict=False)] + [(m, -1) for m in last[-1:]]
    jump = F.broadcast(cut.sparkSession.createDataFrame(jumps, "shard long, jump long"))  # a row for each partition
    pair = sides.select("shard", "highest").join(jump, "shard", "left").withColumn("next", F.coalesce("jump", F.col("shard") + 1))
    pair = pair.join(sides.select(F.col("shard").alias("next"), "lowest"), "next")
    m = F.least(F.size("highest"), F.size("lowest"))
    differ = F.array_position(F.zip_with(F.slice("highest", 1, m), F.slice("lowest", 1, m), lambda x, y: x == y), False)
    return store.keep(pair.select("shard", "next", F.when(differ > 0, differ - 1).otherwise(m).cast("long").alias("shared")))


class Tree:
    """A ternary search tree of sequences of longs. Node 0 is the root of the trie; the others have a code and three links."""

    def __init__(self):
        self.code, self.less, self.more, self.below = [0], [-1], [-1], [-1]
        self.parent, self.depth, self.size = [-1], [0], [0]

    def _node(self, code: int, parent: int, size: int) -> int:
        self.code.append(code)
        self.less.append(-1)
        self.more.append(-1)
        self.below.append(-1)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.size.append(size)
        return len(self.code) - 1

    def insert(self, ids: list[int], sizes: list[int]) -> int:
        """The node at which the sequence ends."""
        at = 0
        for code, size in zip(ids, sizes, strict=True):
            here = self.below[at]
            if here < 0:
                here = self.below[at] = self._node(code, at, size)
            while (other := self.code[here]) != code:
                link = self.less if code < other else self.more
                if link[here] < 0:
                    link[here] = self._node(code, at, size)
                here = link[here]
            at = here
        return at

    def walk(self) -> list[int]:
        """All nodes, each before those below it, siblings by falling code, with a stack."""
        out, todo = [], [0]
        while todo:
            at = todo.pop()
            out.append(at)
            if at:
                todo += [x for x in (self.less[at], self.more[at]) if x >= 0]
            if self.below[at] >= 0:
                todo.append(self.below[at])
        return out


def medians(n: int) -> list[int]:
    """0 to n - 1, the middle of each range before its halves."""
    out, todo = [], [(0, n)]
    while todo:
        a, b = todo.pop()
        if a < b:
            m = (a + b) // 2
            out.append(m)
            todo += [(m + 1, b), (a, m)]
    return out


def shard_nodes(shard: int, ids: list[list[int]], sizes: list[list[int]], n: list[int], conv: list[int], sha: list[str], before: int | None, after: int | None) -> dict[str, list]:
    """Columns of NODE for the sorted different conversations of a shard.

    before, after: how much of a path the first one shares with its predecessor and the last one with its successor, null
    where there is none. The parent_conv_id of a node below a boundary node is left null.
    """
    t = Tree()
    end = [0] * len(ids)
    for i in medians(len(ids)):
        end[i] = t.insert(ids[i], sizes[i])
    size = len(t.code)
    members, smallest, digest = [0] * size, [None] * size, [EMPTY] * size
    children, leaves, saved = [0] * size, [0] * size, [0] * size
    inherited, boundary = [False] * size, [False] * size
    keys: dict[int, bytes] = {}
    for path, at, most, old in ((ids[0], end[0], before, True), (ids[-1], end[-1], after, False)):
        chain = []
        while at >= 0:
            chain.append(at)
            at = t.parent[at]
        h = hashlib.blake2b(digest_size=16)
        for depth, node in enumerate(reversed(chain)):
            if depth > (most or 0):
                break
            if depth:
                h.update(path[depth - 1].to_bytes(8, "little", signed=True))
            boundary[node] = True
            inherited[node] |= old and before is not None
            keys[node] = h.copy().digest()
    for i, at in enumerate(end):
        members[at], smallest[at], digest[at] = n[i], conv[i], sha[i]
    grown = [x >= 0 for x in t.below]  # has a child in this shard
    if after is not None and after == len(ids[-1]):
        grown[end[-1]] = True  # in the next one
    for at in reversed(t.walk()):
        leaves[at] += not grown[at]  # an inherited node always has a child here
        saved[at] += (members[at] - (not inherited[at])) * t.size[at]
        up = t.parent[at]
        if up >= 0:
            members[up] += members[at]
            smallest[up] = smallest[at] if smallest[up] is None else min(smallest[up], smallest[at])
            children[up] += not inherited[at]
            leaves[up] += leaves[at]
            saved[up] += saved[at]
    parent = t.parent
    return {
        "shard": [shard] * size, "key": [keys.get(i) for i in range(size)], "parent_key": [keys.get(p) for p in parent], "boundary": boundary, "depth": t.depth, "conv_id": smallest,
        "parent_conv_id": [None if p < 0 or boundary[p] else smallest[p] for p in parent], "n_convs": members, "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": digest,
    }


_TYPES = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}
_NODE = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in NODE.split(", ")])


def _nodes(group: pa.Table) -> pa.Table:
    rows = group.select(["ids", "sizes", "n", "conv_id", "sha", "before", "after", "shard"]).to_pydict()
    order = sorted(range(len(rows["ids"])), key=rows["ids"].__getitem__)
    col = {k: [v[i] for i in order] for k, v in rows.items()}
    got = shard_nodes(col["shard"][0], col["ids"], col["sizes"], col["n"], col["conv_id"], col["sha"], col["before"][0], col["after"][-1])
    return pa.Table.from_pydict(got, schema=_NODE)


def prefix_trie(turns: DataFrame, *, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations of `turns` (conv_id, turn, role, text).

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    store = Stored(turns.sparkSession)
    convs = rebuild(store.keep(encode(turns, store)))
    a, b = _codes(F.col("ids"))
    convs = store.keep(convs.withColumn("sa", a).withColumn("sb", b))
    # equal conversations meet in their tasks first
    one = convs.groupBy("sa", "sb").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    first = convs.select("conv_id", "ids", "sizes")
    one = one.join(first, "conv_id").join(ends(convs), ["sa", "sb"])
    cut = one.select("ids", "sizes", "n", "conv_id", "sha").repartitionByRange("ids").sortWithinPartitions("ids")
    cut = store.keep(cut.mapInArrow(_cut(shard_turns), "ids array<long>, sizes array<long>, n long, conv_id long, sha string, shard long"))
    shared = shared_prefixes(cut, store)
    marked = cut.join(shared.select("shard", F.col("shared").alias("after")), "shard", "left").join(shared.select(F.col("next").alias("shard"), F.col("shared").alias("before")), "shard", "left")
    nodes = store.keep(marked.groupBy("shard").applyInArrow(_nodes, NODE))
    store.drop(cut)
    # boundary nodes are sums over shards
    parts = nodes.where("boundary")
    met = store.keep(
        parts.groupBy("key").agg(
            *(F.min(c).alias(c) for c in ("parent_key", "depth", "conv_id")), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
            F.coalesce(F.max(F.when(F.col("ends_sha256") != EMPTY, F.col("ends_sha256"))), F.lit(EMPTY)).alias("ends_sha256"),
        )
    )
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    above = met.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("up"))
    at_boundary = met.join(above, "parent_key", "left").withColumn("parent_conv_id", F.col("up")).select(*out)
    # the smallest members of boundary nodes go back to each shard, for the nodes below
    back = parts.select("shard", F.col("key").alias("parent_key")).join(above, "parent_key")
    inner = nodes.where("not boundary")
    below = inner.where("parent_key is not null").join(back, ["shard", "parent_key"]).withColumn("parent_conv_id", F.col("up")).select(*out)
    return inner.where("parent_key is null").select(*out).unionByName(below).unionByName(at_boundary)


def oracle() -> str:
    """The nodes in DuckDB SQL (equal turn numbers, which the given tables don't hold, by role and text)."""
    return """WITH turns AS (SELECT conv_id, turn, coalesce(role, '') r, coalesce(text, '') x FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'r': r, 'x': x} ORDER BY turn NULLS FIRST, r, x) s FROM turns GROUP BY conv_id),
h AS (SELECT conv_id, s, list_reduce(flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda a, v: CASE WHEN v >= 0 THEN xor(a, v) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, 4294967295::BIGINT) c FROM own),
rebuilt AS (SELECT a.conv_id, list_concat(coalesce(b.s[:(xor(a.c, 4294967295) % 9)], []), a.s[(xor(a.c, 4294967295) % 9 + 1):]) s FROM h a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 5),
paths AS (SELECT conv_id, s, unnest(range(len(s) + 1)) d FROM rebuilt),
nodes AS (SELECT s[:d] p, d, min(conv_id) conv_id, count(*) n_convs, coalesce(string_agg(CASE WHEN len(s) = d THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '') ends FROM paths GROUP BY 1, 2),
linked AS (SELECT n.*, u.conv_id parent_conv_id FROM nodes n LEFT JOIN nodes u ON n.d > 0 AND u.d = n.d - 1 AND u.p = n.p[:(n.d - 1)]),
kids AS (SELECT p[:(d - 1)] p, count(*) n FROM nodes WHERE d > 0 GROUP BY 1),
own_values AS (SELECT l.*, coalesce(k.n, 0) n_children, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * strlen(l.p[d].x) END own FROM linked l LEFT JOIN kids k ON k.p = l.p),
up AS (SELECT p[:e] p, sum(own)::BIGINT saved_tokens, sum((n_children = 0)::INT)::BIGINT n_leaves FROM (SELECT p, own, n_children, unnest(range(d + 1)) e FROM own_values) GROUP BY 1)
SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(ends) AS ends_sha256 FROM own_values JOIN up USING (p)"""
