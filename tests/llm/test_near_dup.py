import random
import re

import pytest
from pyspark.sql import functions as F

from scholia.llm.components import connected_components
from scholia.llm.near_dup import _meetings, _rows_of, near_duplicates
from scholia.llm.store import Stored

DDL = "doc_id long, text string, n long, key string, sketch string"


def shingle_set(text, width):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute(rows, width, percent):
    sets = {i: shingle_set(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus(seed, docs=150):
    """Copies, near copies, a passage and a line that many share, short and odd texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdef") for _ in range(r.randint(1, 4)))
    base = [[word() for _ in range(r.choice([1, 2, 3, 4, 5, 6, 8, 20, 40, 120]))] for _ in range(12)]
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(docs):
        w = list(r.choice(base)) if r.random() < 0.7 else [word() for _ in range(r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            if w:
                w[r.randrange(len(w))] = word()
        if r.random() < 0.4:
            w = w[:20] + passage
        rows.append((i, r.choice([" ", "\n", "\t "]).join(w).title() if r.random() < 0.2 else " ".join(w)))
    return rows


@pytest.mark.parametrize(("width", "seed"), [(2, 1), (5, 2)])
def test_equals_brute_force(spark, width, seed):
    rows = corpus(seed) + [(900, None), (901, ""), (902, " \n "), (903, "One"), (904, "one"), (905, "É" * 50_000), (906, "É" * 50_000)]
    df = spark.createDataFrame([(i, t, 7, "k", "s") for i, t in rows], DDL)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(df, width=width, percent=80, block_rows=4).collect()}
    assert got == brute(rows, width, 80)


def test_no_rows_and_rows_without_id(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "q r s t u v"), (None, None)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in got) == [("1", "1", True), ("1", "1", True), ("None", "1", False), ("None", "None", True), ("None", "None", True)]


def test_a_doc_id_with_several_texts_is_one_document(spark):
    rows = [(5, "a b c d e f"), (5, "q r s t u v"), (2, "a b c d e f"), (9, "q r s t u v"), (7, "k l m n o p")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got) == [(2, 2, True), (5, 2, False), (5, 2, False), (7, 7, True), (9, 2, False)]


def test_a_large_group_of_near_copies(spark):
    r = random.Random(5)
    base = [f"w{r.randrange(500)}" for _ in range(90)]
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(r.choice([1, 2, 3, 5])):
            w[r.randrange(len(w))] = r.choice(["x", "y", f"z{i}"])
        rows.append((i, " ".join(w)))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"], x["kept"]) for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block_rows=16).collect()}
    assert got == brute(rows, 5, 80)


def test_two_that_share_many_lists_meet_once(spark):
    r = random.Random(3)
    lists = {node: sorted(r.sample(range(30), 12)) for node in range(40)}
    rows = [(t, node, node % 4, 40, node % 4 == 0, 0, 0, ts[:at]) for node, ts in lists.items() for at, t in enumerate(ts)]
    some = spark.createDataFrame(rows, "t long, node long, g long, m long, in_main boolean, bx long, by long, pre array<long>")
    got = [(x["a"], x["b"]) for x in _meetings(some.where("not in_main").drop("in_main"), some.drop("m"), 40, F.lit(True)).collect()]
    want = {(a, b) for a in lists for b in lists if a < b and a % 4 != b % 4 and set(lists[a]) & set(lists[b])}
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize(("most", "shuffled"), [(1000, False), (7, False), (1, True)])
def test_a_wide_table_is_not_shuffled_for_few_ids(spark, most, shuffled):
    table = spark.range(200).selectExpr("id as node", "array(id, id) as sketch")
    ids = spark.range(0, 60, 3).selectExpr("id as node")
    some = _rows_of(table, ids, "node", most)
    assert sorted(x["node"] for x in some.collect()) == list(range(0, 60, 3))
    assert ("strategy=broadcast" in some._jdf.queryExecution().optimizedPlan().toString()) is not shuffled


def test_components_of_paths_and_cliques(spark):
    links = [(i, i + 1) for i in range(40)] + [(100 + i, 100 + j) for i in range(5) for j in range(i)] + [(7, 7), (None, 3), (200, 201)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long").repartition(5), Stored(spark)).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(5)}, 200: 200, 201: 200}
