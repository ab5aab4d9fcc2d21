import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from scholia.llm.prefix_trie import Tree, medians, oracle, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Every prefix of every rebuilt conversation, kept with its members."""
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            turns[c].append(((t is not None, t or 0), (r or "", x or "")))
    own = {c: [x for _, x in sorted(v, key=lambda z: z[0])] for c, v in turns.items()}
    members, whole = defaultdict(list), {}
    for c, v in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - (c % 5 if c >= 0 else -(-c % 5))
        whole[c] = own.get(base, [])[:h] + v[h:]
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
    below = defaultdict(list)
    for k in members:
        if k:
            below[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in below[k]) or 1
        saved[k] = (len(members[k]) - 1) * (len(k[-1][1].encode()) if k else 0) + sum(saved[x] for x in below[k])
    sha = lambda k: hashlib.sha256(",".join(str(c) for c in sorted(members[k]) if len(whole[c]) == len(k)).encode()).hexdigest()
    return sorted(((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(below[k]), leaves[k], saved[k], sha(k)) for k, m in members.items()), key=str)


def found(df, **how):
    return sorted((tuple(r) for r in prefix_trie(df, **how).collect()), key=str)


@pytest.fixture
def many_partitions(spark):
    """Shuffles keep all their partitions, so that boundary nodes lie across them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("shard_turns", [3, 40, 1 << 16])
def test_nodes_equal_brute_force(spark, many_partitions, shard_turns):
    r = random.Random(3)
    rows = []
    for c in range(-20, 160):
        for t in range(r.choice([0, 1, 2, 3, 5, 12])):
            rows.append((c if r.random() < 0.98 else None, t if t or r.random() < 0.5 else None, r.choice(["user", None, "a"]), r.choice(["x", "yé", None, ""])))
    got = found(spark.createDataFrame(rows, SCHEMA).repartition(5), shard_turns=shard_turns)
    assert got == brute(rows) and len(got) > 200


def test_hot_conversations_long_ones_and_clashing_columns(spark, many_partitions):
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 300, 5) for t in range(3)]  # equal ones
    rows += [(1000, t, "user", f"long {t % 7}") for t in range(400)] + [(1005, 0, "user", "w" * 200_000), (1010, 0, None, None)]
    df = spark.createDataFrame([(*x, 1, "s") for x in rows], SCHEMA + ", depth long, shard string")
    assert found(df, shard_turns=50) == brute(rows)


def test_repeated_rows_turnless_and_empty(spark):
    rows = [(1, 0, "u", "a"), (1, 0, "u", "a"), (6, 4, "u", "b"), (None, 0, "u", "c")]  # 1 and 6 lose their first turns: their groups have no first conversation
    got = found(spark.createDataFrame(rows, SCHEMA))
    assert got == brute(rows)
    assert found(spark.createDataFrame([], SCHEMA)) == [] and found(spark.createDataFrame([(None, 0, "u", "c")], SCHEMA)) == []
    turnless = [(7, 0, "u", "a")]
    assert zlib.crc32(b"7") % 9 >= 1 and found(spark.createDataFrame(turnless, SCHEMA)) == [(7, 0, None, 1, 0, 1, 0, hashlib.sha256(b"7").hexdigest())]


def test_equal_turn_numbers_have_one_order(spark):
    rows = [(0, 1, "u", x) for x in "abc"]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df) == found(df.orderBy("text", ascending=False).repartition(3))


def test_ends_of_a_common_conversation_are_hashed_in_pieces(spark, many_partitions):
    rows = [(c, 0, "u", "same") for c in range(0, 60_000, 5)]
    got = {r["depth"]: r for r in prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1]["ends_sha256"] == hashlib.sha256(",".join(str(c) for c in range(0, 60_000, 5)).encode()).hexdigest() and got[1]["n_convs"] == 12_000


def test_median_insertion_balances_siblings():
    t = Tree()
    for i in medians(1000):
        t.insert([i], [1])
    depth = {}
    for at in t.walk():  # a node comes after the one that links to it
        for x in (t.less[at], t.more[at]):
            if x >= 0:
                depth[x] = depth.get(at, 0) + 1
    assert max(depth.values()) <= 10 and len(t.walk()) == 1001


def test_sql(spark, tmp_path):
    import duckdb

    rows = [(c, t, "u", f"{(c * 7 + t) % 3}") for c in range(-7, 60) for t in range((c % 6 + 6) % 6)]
    df = spark.createDataFrame(rows, SCHEMA)
    con = duckdb.connect()
    con.register("conversations", df.toPandas())
    assert sorted(con.execute(oracle()).fetchall(), key=str) == found(df) == brute(rows)
