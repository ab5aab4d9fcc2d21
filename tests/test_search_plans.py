"""Top-k in two levels and keyword search by essential words: the same rows as ranking everything, fewer rows joined."""

import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from scholia.functions.standards import content_rank, tier_rank
from scholia.operators import align, retrieve, search
from scholia.operators.align import cosine_top_k


def test_two_levels_join_few_rows_of_a_hot_standard(spark):
    n, k = 100_000, 3
    hot = spark.range(n).select(F.concat(F.lit("c"), F.col("id") % 5000).alias("chunk_id"), F.lit("A").alias("standard_id"), F.lit("x").alias("standard_system"), ((F.col("id") * 7919 % 1009) / 1009).alias("alignment_score"), F.lit("embedding").alias("alignment_source"), F.lit(None).cast("string").alias("coverage_notes"), F.lit(0).alias("stale"))
    own = spark.range(300).select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.concat(F.lit("A.B."), F.col("id") % 30).alias("standard_id"), F.lit("x").alias("standard_system"), (F.col("id") / 300).alias("alignment_score"), F.lit("human").alias("alignment_source"), F.lit("n").alias("coverage_notes"), F.lit(0).alias("stale"))
    alignments = hot.unionByName(own)
    chunks = spark.range(5000).select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.lit("s").alias("source_id"), F.lit("core").alias("part"), F.lit("t").alias("title"), F.lit("text").alias("content"), F.when(F.col("id") % 3 == 0, "worked_example").otherwise("summary").alias("content_type"), F.lit(None).cast("string").alias("grade_band"), F.lit(None).cast("int").alias("dok_level"), F.lit(None).cast("string").alias("exam_series"), F.lit(0).alias("stale"))
    questions = spark.createDataFrame([(i, f"A.B.{i % 30}") for i in range(200)], "question_id int, standard_id string")
    order = [content_rank(F.col("content_type")).desc(), tier_rank(F.col("alignment_source")).desc(), F.desc("alignment_score"), "chunk_id", "standard_id"]
    best = retrieve.best_of_standards(alignments, chunks.select("chunk_id", "content_type"), order, k=k)
    joined = retrieve.above(questions).join(best, "standard_id").count()
    assert joined <= 200 * 3 * k  # questions x ancestors x k; ranking after the join would meet 200 x 100,000
    got = sorted((r["question_id"], r["rank"], r["chunk_id"], r["standard_id"]) for r in retrieve.content_for_standards(questions, alignments, chunks, k=k).collect())
    kind = {r["chunk_id"]: r["content_type"] for r in chunks.collect()}
    by = defaultdict(list)
    for r in alignments.collect():
        by[r["standard_id"]].append((-(3 if kind[r["chunk_id"]] == "worked_example" else 1), -(4 if r["alignment_source"] == "human" else 1), -r["alignment_score"], r["chunk_id"], r["standard_id"]))
    want = []
    for i in range(200):
        rows = sorted(by["A"] + by["A.B"] + by[f"A.B.{i % 30}"])[:k]
        want += [(i, j + 1, x[3], x[4]) for j, x in enumerate(rows)]
    assert got == sorted(want)


def bm25(queries, docs, allowed, limit):
    """Every score of every pair, by part."""
    words = {(p, c): re.findall(r"\w+", f"{t} {x}".lower()) for c, p, t, x in docs}
    out = {}
    for part in {p for p, _ in words}:
        here = {c: w for (p, c), w in words.items() if p == part}
        n, mean = len(here), sum(map(len, here.values())) / len(here)
        df = Counter(t for w in here.values() for t in set(w))
        for q, text in queries:
            scores = []
            for c, w in here.items():
                tf, s = Counter(w), 0.0
                for t, times in Counter(re.findall(r"\w+", text.lower())).items():
                    if tf[t]:
                        s += times * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(w) / mean))
                if s and (part, c) in allowed:
                    scores.append((-round(s, 6), c))
            out[q, part] = [(c, -s) for s, c in sorted(scores)[:limit]]
    return {k: v for k, v in out.items() if v}


def corpus(spark, n=400, seed=1):
    r = random.Random(seed)
    rare = [f"w{i}" for i in range(300)]
    docs = [(f"c{i:03d}", "abcd"[i % 4 if i % 7 else 0], r.choice(rare), " ".join(["the"] * r.randint(1, 4) + r.choices(["of", "and", "to"], k=6) + r.choices(rare, k=5))) for i in range(n)]
    queries = [(i, " ".join(["the the"] + r.choices(rare, k=2) + r.choices(["of", "missing"], k=1))) for i in range(40)] + [(50, "the"), (51, ""), (52, "missing")]
    return docs, queries, spark.createDataFrame(docs, "chunk_id string, part string, title string, content string"), spark.createDataFrame(queries, "query_id int, query_text string")


def found(df, part=None):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out[r["query_id"], part or r["part"]].append((r["chunk_id"], r["score"]))
    return dict(out)


def test_keyword_hits_equal_every_score(spark):
    docs, queries, d, q = corpus(spark)
    one = [(c, "all", t, x) for c, _, t, x in docs]
    some = d.where("chunk_id not like '%5'")
    for limit in (1, 3, 50):
        assert found(search.keyword_hits(q, d, limit=limit), "all") == bm25(queries, one, {("all", c) for c, _, _, _ in docs}, limit)
        assert found(search.keyword_hits(q, d, some, limit=limit, by=("part",))) == bm25(queries, docs, {(p, c) for c, p, _, _ in docs if not c.endswith("5")}, limit)


def test_a_stop_word_makes_no_rows_of_queries_by_documents(spark):
    r = random.Random(2)
    docs = spark.createDataFrame([(f"c{i}", "", f"the of w{i % 500} v{r.randrange(50)}") for i in range(5000)], "chunk_id string, title string, content string")
    q = spark.createDataFrame([(i, f"the w{i} of") for i in range(300)], "query_id int, query_text string")
    words = search.query_terms(q)
    posted, stats = search.postings(words, docs)
    scored = search.weighed(posted, stats)
    split = search.split_terms(words, scored, limit=5)
    assert {r["term"][0] for r in split.where("essential").collect()} == {"w"}
    rows = search.candidates(split, scored).count()
    assert rows == 300 * 10  # the chunks of the rare words; the stop words stand in 5000 chunks for each of 300 queries
    assert search.keyword_hits(q, docs, limit=5).count() == 300 * 5


def test_hybrid_search_reads_chunks_once_whatever_the_parts(spark, tmp_path):
    docs, _, d, q = corpus(spark, 80)
    scans = []
    for parts in (d, d.withColumn("part", F.concat("part", F.substring("chunk_id", 4, 1)))):
        path = f"{tmp_path}/{len(scans)}"
        parts.withColumn("stale", F.lit(0)).write.parquet(path)
        chunks = spark.read.parquet(path)
        plan = search.hybrid_search(q, chunks, limit=2)._jdf.queryExecution().optimizedPlan().toString()
        scans.append(plan.count("Relation ["))
    assert scans[0] == scans[1] <= 12


def test_hybrid_search_of_one_and_of_several_parts(spark):
    docs, queries, d, q = corpus(spark, 120)
    d = d.withColumn("stale", F.lit(0))
    one = search.hybrid_search(q, d.withColumn("part", F.lit("core")), limit=4)
    want = bm25(queries, [(c, "core", t, x) for c, _, t, x in docs], {("core", c) for c, _, _, _ in docs}, 4)
    got = defaultdict(list)
    for r in sorted(one.where("mode <> 'empty_query'").collect(), key=lambda r: r["rank"]):
        got[r["query_id"], r["part"]].append((r["chunk_id"], r["score"]))
    assert dict(got) == want
    assert [(r["query_id"], r["chunk_id"]) for r in one.where("mode = 'empty_query'").collect()] == [(51, None)]
    several = search.hybrid_search(q, d.withColumn("part", F.expr("if(part = 'a', 'core', if(part = 'b', 'ncsa', part))")), limit=3)
    first = {r["query_id"]: r for r in several.where("rank = 1").collect()}
    assert first[50]["part"] == "core" and abs(first[50]["score"] - round(1 / 61, 9)) < 1e-12


def test_a_small_side_goes_to_the_tasks_and_gives_the_same_rows(spark):
    r = random.Random(5)
    vector = lambda d=6: [r.gauss(0, 1) for _ in range(d)]
    left = spark.createDataFrame([(i, vector(6 if i % 9 else 4)) for i in range(120)] + [(900, None)], "id long, vector array<double>").repartition(3)
    right = spark.createDataFrame([(i, vector(6 if i % 5 else 4)) for i in range(70)] + [(901, None)], "id long, vector array<double>").repartition(3)
    rows = lambda df: sorted(tuple(x) for x in df.collect())
    dealt = rows(cosine_top_k(left, right, k=4, threshold=-2.0, block=16))
    for a, b in ((left, right), (right, left)):
        small = cosine_top_k(a, b, k=4, threshold=-2.0)
        assert "MapInArrow" in small._jdf.queryExecution().optimizedPlan().toString()
        assert rows(small) == rows(cosine_top_k(a, b, k=4, threshold=-2.0, block=16))
    # the larger side is not shuffled: one side alone is beyond a block
    assert rows(cosine_top_k(left, right, k=4, threshold=-2.0, block=100)) == dealt == rows(cosine_top_k(left, right, k=4, threshold=-2.0))
    assert rows(cosine_top_k(left, right.where("false"), k=4, threshold=-2.0)) == [] == rows(cosine_top_k(left.where("false"), right, k=4, threshold=-2.0))


def test_cells_that_cannot_reach_a_score_are_not_compared(spark, monkeypatch):
    r = random.Random(6)
    centres = [[r.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    near = lambda c: [x + r.gauss(0, 0.03) for x in c]
    rows = lambda df: sorted(tuple(x) for x in df.collect())
    left = spark.createDataFrame([(i, near(centres[i % 12])) for i in range(360)] + [(1000, [0.0] * 16), (1001, [1.0] * 5)], "id long, vector array<double>")
    right = spark.createDataFrame([(i, near(centres[i % 12]), "ab"[i // 12 % 2]) for i in range(480)] + [(2000, [0.0] * 16, "a"), (2001, [2.0] * 5, "a")], "id long, vector array<double>, part string")
    shares = []
    bounds = align.cell_bounds

    def seen(*args):
        found = bounds(*args)
        shares.append(sum(x < 0.6 for x in found.values()) / len(found))
        return found

    monkeypatch.setattr(align, "cell_bounds", seen)
    for k, threshold in ((3, 0.6), (5, -2.0)):
        assert rows(cosine_top_k(left, right, k=k, threshold=threshold, block=20)) == rows(cosine_top_k(left, right, k=k, threshold=threshold))
    assert min(shares) > 0.4  # of the pairs of cells so many are out of reach of 0.6
    assert rows(cosine_top_k(left, right, k=4, threshold=-2.0, block=20, by="part")) == rows(cosine_top_k(left, right, k=4, threshold=-2.0, by="part"))
    reach = bounds(align.unit_rows(align.np.array([[1.0, 0.0], [0.0, 1.0]])), {0: 0.1, 1: 0.2}, {0: 0.0, 1: 0.3, -1: None})
    assert abs(reach[0, 1] - math.cos(math.pi / 2 - 0.4)) < 1e-6 and reach[0, 0] == 1.0 and reach[1, -1] == 1.0
