"""Loads and re-splits that rewrite only what they change, walks and descents of any depth."""

import os

import pytest
from pyspark.sql import functions as F

from scholia.operators import paths
from scholia.sources import columns as C
from scholia.sources import layout


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def chunk_rows(n):
    return [(f"c{i}", "K-5" if i % 2 else None, f"text {i}", "2020", "2021", int(i % 10 == 0)) for i in range(n)]


CHUNK = "chunk_id string, grade_band string, content string, created_at string, last_verified string, stale int"


def test_load_rewrites_touched_buckets_only(spark, tmp_path):
    path = f"{tmp_path}/s"
    old = spark.createDataFrame(chunk_rows(200), CHUNK)
    layout.lay_out_chunks(old, path, buckets=16)
    before = files(f"{path}/chunks")
    arrivals = [("c1", "K-5", "new text"), ("c3", None, "text 3"), ("c5", "K-5", "text 5"), ("c10", None, "text 10"), ("n1", None, "added"), ("n1", None, "added"), ("c7", "K-5", None)]
    change = layout.load_changes(spark, path, spark.createDataFrame(arrivals, "chunk_id string, grade_band string, content string"), now="2026", buckets=16)
    assert dict(change.collect()) == {"c1": "updated", "c3": "updated", "c5": "same", "c10": "updated", "n1": "added", "c7": "updated"}
    got = {r["chunk_id"]: r for r in layout.read_chunks(spark, path).collect()}
    assert len(got) == 201 and got["c1"]["content"] == "new text" and got["c3"]["grade_band"] is None and got["c7"]["content"] is None
    assert got["c10"]["stale"] == 0 and got["c10"]["created_at"] == "2020" and got["n1"]["created_at"] == "2026"
    assert got["c5"]["last_verified"] == got["c1"]["last_verified"] == "2026" and got["c2"]["last_verified"] == "2021"
    touched = {r["b"] for r in spark.createDataFrame([(x,) for x in ("c1", "c3", "c10", "n1", "c7")], "chunk_id string").select(layout.bucket_of(F.col("chunk_id"), 16).alias("b")).collect()}
    after = files(f"{path}/chunks")
    same = {p for p in before if after.get(p) == before[p]}
    assert {p for p in before if int(p.split("bucket=")[1].split("/")[0]) not in touched} == same and len(touched) < 16


def test_load_of_nothing_new_writes_no_chunk(spark, tmp_path):
    path = f"{tmp_path}/s"
    layout.lay_out_chunks(spark.createDataFrame(chunk_rows(20), CHUNK), path)
    before = files(f"{path}/chunks")
    change = layout.load_changes(spark, path, spark.createDataFrame([("c1", "K-5", "text 1")], "chunk_id string, grade_band string, content string"), now="2026")
    assert dict(change.collect()) == {"c1": "same"} and files(f"{path}/chunks") == before
    empty = layout.load_changes(spark, path, spark.createDataFrame([], "chunk_id string, grade_band string, content string"), now="2027")
    assert empty.count() == 0 and files(f"{path}/chunks") == before and layout.read_chunks(spark, path).count() == 20


def part_tables(spark):
    books = spark.createDataFrame([("b1", "core", "CC BY"), ("b2", "core", "CC BY-NC"), ("b3", "ncsa", "CC BY-NC"), ("b4", "ap", "CC BY-NC")], "book_id string, part string, license string")
    chunks = spark.createDataFrame([(f"c{i}", f"b{1 + i % 4}", ("core", "core", "ncsa", "ap")[i % 4], f"text {i}") for i in range(12)], "chunk_id string, book_id string, part string, content string")
    facts = chunks.select("chunk_id", "part")
    return {"books": books, "chunks": chunks, "embeddings": facts.where("chunk_id <> 'c1'").withColumn("vector", F.array(F.lit(1.0))), "alignments": facts.withColumn("standard_id", F.explode(F.array(F.lit("S1"), F.lit("S2"))))}


def test_resplit_moves_books_with_all_their_facts(spark, tmp_path):
    root = f"{tmp_path}/parts"
    layout.lay_out_parts(part_tables(spark), root)
    before = files(root)
    report = {(r["table"], r["part"]): r for r in layout.resplit(spark, root).collect()}
    assert all(r["ok"] for r in report.values())
    assert [report[t, "core"]["moved"] for t in layout.TABLES] == [-1, -3, -2, -6] and report["chunks", "ncsa"]["after"] == 6
    assert {r["part"] for r in layout.read_part_table(spark, root, "chunks").where("book_id = 'b2'").collect()} == {"ncsa"}
    after = files(root)
    assert all(after.get(p) == before[p] for p in before if "part=ap" in p) and not any(after.get(p) == before[p] for p in before if "part=core" in p)
    again = layout.resplit(spark, root).collect()
    assert all(r["moved"] == 0 and r["ok"] for r in again) and files(root) == after


def test_resplit_reports_orphans_and_empties_a_part(spark, tmp_path):
    root = f"{tmp_path}/parts"
    tables = part_tables(spark)
    tables["books"] = tables["books"].where("book_id <> 'b1'")
    layout.lay_out_parts(tables, root)
    report = {(r["table"], r["part"]): r for r in layout.resplit(spark, root).collect()}
    assert report["books", "core"]["after"] == 0 and report["books", "core"]["before"] == 1 and report["books", "ncsa"]["after"] == 2
    assert report["chunks", "core"]["orphans"] == 3 and not report["chunks", "core"]["ok"] and report["chunks", "ncsa"]["ok"]
    with pytest.raises(FileNotFoundError):
        layout.read_part_table(spark, f"{tmp_path}/none", "books")


def test_a_filter_on_part_reads_only_its_folder(spark, tmp_path):
    root = f"{tmp_path}/parts"
    layout.lay_out_parts(part_tables(spark), root)
    df = layout.read_part_table(spark, root, "chunks").where("part = 'ap'")
    assert df.count() == 3 and len(df.inputFiles()) <= 4 and "PartitionFilters: [isnotnull(part" in df._jdf.queryExecution().toString()


def test_descendants_of_a_chain_a_cycle_and_a_star(spark):
    chain = [(i, i - 1) for i in range(1, 1000)]
    cycle = [(2000, 2002), (2001, 2000), (2002, 2001), (2003, 2002)]
    star = [(3000 + i, 3000) for i in range(1, 500)]
    nodes = spark.createDataFrame(chain + cycle + star + [(None, 1), (5000, None)], "id long, parent_id long")
    roots = spark.createDataFrame([(0, 1), (500, 2), (2000, 3), (3000, 4), (5000, 5), (0, 1)], "id long, root_order int")
    got = {(r["id"], r["root_order"]): r["distance"] for r in C.descendants(nodes, roots).collect()}
    want = {(i, 1): i for i in range(1000)} | {(i, 2): i - 500 for i in range(500, 1000)} | {(2000, 3): 0, (2001, 3): 1, (2002, 3): 2, (2003, 3): 3, (5000, 5): 0}
    assert got == want | {(3000 + i, 4): int(i > 0) for i in range(500)}


def test_descendants_with_two_parents_take_the_shortest_way(spark):
    nodes = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("d", "a")], "id string, parent_id string")
    got = {r["id"]: r["distance"] for r in C.descendants(nodes, spark.createDataFrame([("a", 1)], "id string, root_order int")).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 1}
    assert C.descendants(nodes, spark.createDataFrame([], "id string, root_order int")).count() == 0


def test_a_walk_reads_the_edges_once_a_step_and_ends_in_cycles(spark, monkeypatch):
    st = spark.createDataFrame([(f"S{i}", "x") for i in range(60)] + [("T", "y")], "standard_id string, system string")
    edges = spark.createDataFrame([(f"S{i}", f"S{i + 1}", "prerequisite") for i in range(50)] + [("S50", "S3", "prerequisite"), ("S1", "T", "prerequisite"), ("S0", "S9", "related")], "source_id string, target_id string, relationship string")
    q = spark.createDataFrame([(1, "S0", "x"), (2, "S48", "x"), (3, "none", "x")], "question_id int, standard_id string, system string")
    made = []
    keep = paths.stored
    monkeypatch.setattr(paths, "stored", lambda df: made.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df))
    out = paths.prerequisites(q, st, edges, depth=80)
    got = {(r["question_id"], r["standard_id"]): r["distance"] for r in out.collect()}
    assert got == {(1, f"S{i}"): i for i in range(51)} | {(2, "S48"): 0, (2, "S49"): 1, (2, "S50"): 2} | {(2, f"S{i}"): i for i in range(3, 48)}
    assert len(made) == 2 + 51  # edges, the start, and a step for each distance, the last of them empty
    assert all(plan.count("target_id") and plan.count("Relation [") <= 3 + i for i, plan in enumerate(made[2:]))
