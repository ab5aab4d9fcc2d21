"""Interval joins of prefixes, reports in one pass, integrity from one table of keys, the vector codec."""

import random
import struct

from pyspark.sql import functions as F

from scholia.operators import audit, coverage, merge
from scholia.sources import columns as C
from scholia.sources import corpus as IO


def test_ids_with_prefix(spark):
    r = random.Random(1)
    ids = sorted({".".join(r.choice(["A", "B", "10", "1", "é", "Z"]) for _ in range(r.randint(1, 4))) for _ in range(300)})
    prefixes = ["A", "A.1", "A.10", "", "é", "Z.Z.Z.Z.Z", "1", "10.", "none", "B.A"]
    p = spark.createDataFrame(list(enumerate(prefixes)) + [(99, None)], "question_id int, prefix string")
    i = spark.createDataFrame([(x,) for x in ids] + [(None,)], "standard_id string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = coverage.ids_with_prefix(p, i)
        got = sorted((r["question_id"], r["standard_id"]) for r in out.collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == sorted((n, x) for n, q in enumerate(prefixes) for x in ids if x.startswith(q))
    assert coverage.ids_with_prefix(p, i.where("false")).count() == 0
    # the join is on the range alone, and the sort dealt the ids into several
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "(range#" in plan.split("Join Inner")[1].split("\n")[0]


def test_reports_in_one_pass_equal_the_single_ones(spark):
    chunks = spark.createDataFrame([("c1", "K-5", "s1", 0), ("c2", None, "s1", 0), ("c3", "K-5", "s2", 0), ("c4", "6-8", "s2", 1), ("c5", None, None, 0)], "chunk_id string, grade_band string, source_id string, stale int")
    alignments = spark.createDataFrame([("c1", "A", 0.9, "human", 0), ("c1", "B", 0.5, "embedding", 0), ("c2", "A", 0.8, None, 0), ("c4", "C", 0.95, "human", 0), ("zz", "D", 0.1, "embedding", 0), ("c3", "A", 0.7, "human", 1)], "chunk_id string, standard_id string, alignment_score double, alignment_source string, stale int").withColumn("coverage_notes", F.lit(None).cast("string"))
    out = audit.quality_reports(chunks, alignments)
    cols = ["chunks", "standards", "alignments", "avg_score", "min_score", "max_score", "strong_percent"]
    for c in ("grade_band", "source_id"):
        one = audit.by_group(chunks, alignments, c).select(F.col(c).alias("value"), *cols)
        assert sorted(map(str, out.where(F.col("report") == c).select("value", *cols).collect())) == sorted(map(str, one.collect()))
    tier = audit.by_tier(alignments).selectExpr("alignment_source as value", "n", "avg_score", "min_score", "max_score", "strong_percent")
    assert sorted(map(str, out.where("report = 'alignment_source'").selectExpr("value", "alignments as n", "avg_score", "min_score", "max_score", "strong_percent").collect())) == sorted(map(str, tier.collect()))
    per = audit.source_quality(chunks, alignments).selectExpr("source_id as value", "human", "embedding", "strong")
    assert sorted(map(str, out.where("report = 'source_id'").select("value", "human", "embedding", "strong").collect())) == sorted(map(str, per.collect()))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 2 and plan.count("Join ") == 1


def test_integrity_counts_rows_of_every_kind(spark):
    c = spark.createDataFrame([("c1", "core", "summary"), ("c1", "core", "summary"), ("c2", "core", None), ("c2", "ap", "odd"), ("c3", "ap", "summary")], "chunk_id string, part string, content_type string")
    a = spark.createDataFrame([("c1", "S1", "human", 0.5), ("c1", "S1", "human", 1.5), ("zz", "S1", "who", None), ("zz", "S1", "human", 0.1), ("c3", "S9", None, -0.1), (None, "S1", "human", 0.2)], "chunk_id string, standard_id string, alignment_source string, alignment_score double")
    s = spark.createDataFrame([("S1",)], "standard_id string")
    got = dict(merge.integrity(c, a, s, ("summary",), ("human",)).collect())
    assert got == {"duplicate chunk": 1, "duplicate alignment": 2, "alignment without chunk": 3, "alignment without standard": 1, "content type": 2, "tier": 2, "score": 3}
    assert set(dict(merge.integrity(c.where("false"), a.where("false"), s, ("summary",), ("human",)).collect()).values()) == {0}


def test_vectors_of_any_length_and_null(spark):
    rows = [(1, struct.pack("<3f", 1.5, -2.0, 0.25)), (2, b""), (3, None), (4, b"abc"), (5, struct.pack("<f", 7.0)), (6, b"xxxxx")]
    df = spark.createDataFrame(rows, "id int, b binary").repartition(2)
    got = {r["id"]: r["v"] for r in df.select("id", IO.decode_vectors(F.col("b")).alias("v")).collect()}
    assert got == {1: [1.5, -2.0, 0.25], 2: [], 3: None, 4: None, 5: [7.0], 6: None}
    vectors = spark.createDataFrame([(1, [1.5, -2.0]), (2, None), (3, []), (4, [0.1])], "id int, v array<double>")
    back = {r["id"]: (None if r["b"] is None else bytes(r["b"])) for r in vectors.select("id", IO.encode_vectors(F.col("v")).alias("b")).collect()}
    assert back == {1: struct.pack("<2f", 1.5, -2.0), 2: None, 3: b"", 4: struct.pack("<f", 0.1)}


def test_bands_of_tested_grades_and_page_categories(spark):
    g = spark.createDataFrame([(x,) for x in ("3", "4", "8", "9", "10", "12", "K", None)], "g string")
    got = {r["g"]: (r["n"], r["s"]) for r in g.select("g", C.tested_band(F.col("g"), "national").alias("n"), C.tested_band(F.col("g"), "state").alias("s")).collect()}
    assert got == {"3": (None, "K-5"), "4": ("K-5", "K-5"), "8": ("6-8", "6-8"), "9": (None, None), "10": (None, "9-12"), "12": ("9-12", None), "K": (None, None), None: (None, None)}
    c = spark.createDataFrame([(x,) for x in ("kindergarten", "grade-1", "grade-8", "grade-9", "high-school-x", "")], "c string")
    grade, band = C.grade_of_category(F.col("c"))
    assert {r["c"]: (r["g"], r["b"]) for r in c.select("c", grade.alias("g"), band.alias("b")).collect()} == {"kindergarten": ("K", "K-5"), "grade-1": ("1", "K-5"), "grade-8": ("8", "6-8"), "grade-9": ("HS", "9-12"), "high-school-x": ("HS", "9-12"), "": ("HS", "9-12")}
