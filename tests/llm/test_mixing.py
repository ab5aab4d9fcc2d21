import numpy as np
import pytest

from scholia.llm.mixing import flight, land, mix_sources, numbered, targets
from scholia.llm.store import Stored


def test_targets_are_shares_with_stops():
    t = targets([("b", 100), ("a", 1000), (None, 50), ("c", 10)])
    assert t["c"] == 30 and t[None] == pytest.approx(150) and sum(t.values()) == pytest.approx(1160)
    assert t["b"] == pytest.approx(300) and t["a"] == pytest.approx(1160 - 30 - 150 - 300)
    assert targets([("a", 0)]) == {"a": 0.0} and targets([]) == {}


@pytest.mark.parametrize("seed", range(20))
def test_flight_keeps_totals(seed):
    r = np.random.default_rng(seed)
    n = int(r.integers(0, 300))
    size, p = r.integers(0, 500, n), r.random(n)
    q = flight(p, size)
    assert ((q > 0) & (q < 1)).sum() <= 2 and ((q >= 0) & (q <= 1)).all()
    assert q @ size == pytest.approx(p @ size, abs=1e-3) and q.sum() == pytest.approx(p.sum(), abs=1e-5)
    assert set(land(p, q, size)) <= {0.0, 1.0}


def test_sources_come_near_their_targets(spark):
    r = np.random.default_rng(5)
    rows = [(i, "w " * int(r.integers(0, 90)), ["a", "b", "c", None][int(r.integers(0, 4)) if i % 3 else 0], 9, 9) for i in range(3000)] + [(5000, None, "d", 1, 1), (5001, "", "d", 1, 1), (None, "x y", "a", 1, 1), (None, "x y", "a", 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, target int")
    got = mix_sources(df, block_rows=100).collect()
    assert len(got) == len(rows)
    source = {i: s for i, _, s, _, _ in rows}
    sums, goal = {}, {}
    for g in got:
        assert g["taken"] == g["copies"] * g["size"] and 0 <= g["taken"] <= 3 * g["size"]
        s = source[g["doc_id"]]
        sums[s] = sums.get(s, 0) + g["taken"]
        goal[s] = g["target"]
    assert all(abs(sums[s] - goal[s]) <= 60 for s in goal)
    assert sum(goal.values()) == pytest.approx(sum(len((t or "").split()) for _, t, *_ in rows))
    key = lambda x: sorted((str(r["doc_id"]), r["taken"]) for r in x)
    assert key(mix_sources(df.repartition(7), block_rows=100).collect()) == key(got)
    assert mix_sources(df.where("false")).collect() == []


def test_small_sources_land_with_others_beside_a_large_one(spark):
    r = np.random.default_rng(9)
    small = [(f"s{k}", int(r.integers(1, 400))) for k in range(12) for _ in range(40)]
    two_blocks = [("t", int(r.integers(1, 400))) for _ in range(150)]
    rows = [(i, "w " * n, s) for i, (s, n) in enumerate(small + two_blocks + [("z", 30)] * 700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    miss, source = {}, {i: s for i, _, s in rows}
    for g in mix_sources(df, block_rows=100, weights=(1, 2, 3, 1.5, 2.5)).collect():
        s = source[g["doc_id"]]
        miss[s] = miss.get(s, -g["target"]) + g["taken"]
    assert all(abs(x) <= 10 for s, x in miss.items() if s != "z"), miss
    assert abs(miss["z"]) <= 30


@pytest.mark.parametrize("seed", range(12))
def test_flight_and_landing_equal_enumeration(seed):
    """Of all choices for a block's documents the landing takes the one whose words, then number, come nearest."""
    r = np.random.default_rng(seed)
    n = int(r.integers(1, 10))
    size, p = r.integers(0, 300, n), r.random(n)
    got = land(p, flight(p, size), size)
    choices = [np.array([k >> i & 1 for i in range(n)]) for k in range(1 << n)]
    miss = lambda c: (round(abs(float(c @ size - p @ size)), 6), round(abs(float(c.sum() - p.sum())), 6))
    if ((q := flight(p, size)) % 1 > 0).any():
        assert miss(got) == min(map(miss, choices))
    else:
        assert (got == q).all()


def test_equal_rows_and_rows_without_id_share_no_block(spark, tmp_path):
    text = "five words are in here"
    df = spark.range(100_000).selectExpr("cast(null as long) doc_id", f"'{text}' text", "'a' source").unionByName(spark.range(5000).selectExpr("id doc_id", "concat('w ', id) text", "'b' source"))
    rows = numbered(df, Stored(spark), equal_rows=1000)
    assert rows.count() == 105_000 == rows.select("h").distinct().count()
    block = rows.where("source = 'a'").selectExpr("pmod(xxhash64(h, 98L), 98L) b").groupBy("b").count().agg({"count": "max"}).first()[0]
    assert block < 1400  # 100,000 equal rows in 98 blocks
    got = mix_sources(df, block_rows=1024, weights=(1, 1)).groupBy("source_size", "target").sum("taken", "size").collect()
    assert all(abs(g["sum(taken)"] - g["target"]) <= 10 and g["sum(size)"] == g["source_size"] for g in got) and len(got) == 2


def test_ties_in_id_and_size_have_one_mix(spark):
    rows = [(1, f"{'abcdefghij'[i % 10]} x y", "ab"[i % 2], i) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, row long")
    key = lambda d: sorted((r["row"], r["copies"]) for r in mix_sources(d, carry=("row",), block_rows=50).collect())
    assert key(df) == key(df.orderBy("row", ascending=False).repartition(6))
