"""Literal cases of the corpus operators."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholia.functions import standards as S
from scholia.operators import align, assess, audit, coverage, evals, merge, paths, retrieve, review, search
from scholia.sources import columns as C
from scholia.sources import corpus as IO
from scholia.sources import documents as D

CHUNKS = "chunk_id string, book_id string, source_id string, part string, title string, content string, content_type string, grade_band string, dok_level int, exam_series string, stale int, ord long"
ALIGN = "chunk_id string, standard_id string, standard_system string, alignment_score double, alignment_source string, coverage_notes string, stale int, align_id long"


def chunk(i, kind="exposition", part="core", stale=0, band="6-8", exam=None, title="t", ord=0, book="b"):
    return (i, book, "src", part, title, f"content of {i}", kind, band, 2 if kind == "assessment" else None, exam, stale, ord)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_ranking_of_content(spark):
    chunks = spark.createDataFrame([chunk("e"), chunk("w", "worked_example"), chunk("p"), chunk("s", stale=1), chunk("n", band=None)], CHUNKS)
    a = [("e", "S.1", "ccss", 0.98, "embedding"), ("p", "S.1", "ccss", 0.90, "publisher_guide"), ("w", "S.1", "ccss", 0.72, "embedding"), ("s", "S.1", "ccss", 0.99, "human"), ("n", "S", "ccss", 0.70, "embedding")]
    al = spark.createDataFrame([(*x, None, 0, i) for i, x in enumerate(a)], ALIGN)
    q = spark.createDataFrame([(1, "S.1", "ccss"), (2, "X.9", "ccss")], "question_id long, standard_id string, system string")
    got = retrieve.content_for_standards(q, al, chunks, k=4).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == ["w", "p", "e", "n"] and got[0]["content"] is None
    none = retrieve.unanswered(q, retrieve.content_for_standards(q, al, chunks), chunks).collect()
    assert [(r["question_id"], r["available_sources"]) for r in none] == [(2, "src")]
    assert retrieve.content_for_standards(q, al, chunks, system="ap").count() == 0


def test_neighbours_and_details(spark):
    chunks = spark.createDataFrame([chunk("a", ord=1), chunk("b", ord=2, stale=1), chunk("c", ord=3), chunk("a", part="ncsa", ord=9, title="second")], CHUNKS)
    al = spark.createDataFrame([("a", "S.1", "ccss", 0.8, "human", None, 0, 1), ("a", "S.2", "ccss", 0.9, "human", None, 0, 2), ("a", "S.3", "ccss", 0.9, "human", None, 1, 3)], ALIGN)
    got = {r["chunk_id"]: r for r in retrieve.chunk_details(spark.createDataFrame([("a",), ("zz",)], "chunk_id string"), chunks, al, include_adjacent=True).collect()}
    assert got["a"]["title"] == "t" and [x["standard_id"] for x in got["a"]["alignments"]] == ["S.2", "S.1"] and (got["a"]["previous"], got["a"]["next"]) == (None, "c")
    assert got["zz"]["result"] == "not_found"


def test_coverage_of_a_cluster(spark):
    st = spark.createDataFrame([(f"M.6.RP.{i}", "ccss", "RP", "A", "6", f"text {i}") for i in (1, 2, 3)], "standard_id string, system string, domain string, cluster string, grade string, standard_text string")
    chunks = spark.createDataFrame([chunk("x"), chunk("y")], CHUNKS)
    al = spark.createDataFrame([("x", "M.6.RP.1", "ccss", 0.80, "embedding", None, 0, 1), ("y", "M.6.RP.2", "ccss", 0.72, "embedding", None, 0, 2), ("y", "M.6.RP.1", "ccss", 0.79, "human", None, 0, 3)], ALIGN)
    q = spark.createDataFrame([(1, "M.6.RP.1", "ccss"), (2, "M.6.RP.A", "ccss"), (3, "M.9", "ccss"), (4, "M.6.R", "ccss")], "question_id long, standard_id string, system string")
    got = {r["question_id"]: r for r in coverage.coverage_report(q, st, al, chunks).collect()}
    assert [got[i]["standards_checked"] for i in (1, 2, 3, 4)] == [3, 3, 0, 3]
    assert got[1]["overall_coverage"] == "moderate" and got[1]["gaps"] == "M.6.RP.3" and got[3]["result"] == "unknown_standard"
    assert one(spark, S.coverage_band(F.lit(0.80), F.lit("publisher_guide"))) == "moderate" and one(spark, S.coverage_band(F.lit(0.64), F.lit("embedding"))) == "none"


def test_paths_end_on_cycles(spark):
    st = spark.createDataFrame([(x, "ccss") for x in "ABCXY"], "standard_id string, system string")
    e = spark.createDataFrame([("A", "B", "prerequisite"), ("B", "C", "prerequisite"), ("X", "Y", "prerequisite"), ("Y", "X", "prerequisite"), ("A", "X", "related")], "source_id string, target_id string, relationship string")
    q = spark.createDataFrame([(1, "A", "ccss"), (2, "X", "ccss"), (3, "nope", "ccss")], "question_id long, standard_id string, system string")
    got = sorted((r["question_id"], r["distance"], r["standard_id"]) for r in paths.prerequisites(q, st, e, depth=5).collect())
    assert got == [(1, 0, "A"), (1, 1, "B"), (1, 2, "C"), (2, 0, "X"), (2, 1, "Y")]


def test_crosswalk_and_items(spark):
    q = spark.createDataFrame([(1, "M.8.EE.1", "ccss")], "question_id long, standard_id string, system string")
    walk = spark.createDataFrame([("M.8.EE", "SAT", "d"), ("M.8", "ACT", "d"), ("M.8.G", "NAEP Grade 8", "d")], "standard_id string, exam_series string, skill_domain string")
    chunks = spark.createDataFrame([chunk("i1", "assessment", exam="SAT"), chunk("i2", "assessment", part="ncsa", exam="SAT"), chunk("i3", "assessment", exam="SAT")], CHUNKS)
    al = spark.createDataFrame([("i1", "M.8.EE.1", "ccss", 0.5, "embedding", None, 0, 1), ("i2", "M.8.EE.1", "ccss", 0.9, "human", None, 0, 2), ("i3", "M.8.EE", "ccss", 0.9, "human", None, 0, 3)], ALIGN)
    r = assess.assessment_map(q, walk, al, chunks).first()
    assert (r["exams"], r["with_items"], r["items"], r["gaps"]) == ("ACT,SAT", "SAT", 2, "ACT")
    assert [x["chunk_id"] for x in assess.exam_items(q, al, chunks, items_per_exam=1).collect()] == ["i1"]
    assert assess.assessment_map(q, walk, al, chunks.drop("exam_series")).first()["items_status"] == "no_item_store"


def test_tier_merge_equals_a_fold(spark):
    r = random.Random(3)
    rank = S.TIERS
    rows = [(r.choice("ab"), r.choice("xyz"), r.choice(list(rank)), r.random(), int(r.random() < 0.2), i) for i in range(200)]
    kept: dict = {}
    for c, s, t, score, human, i in rows:
        old = kept.get((c, s))
        if old is None:
            kept[c, s] = [t, score, human, i]
        elif not old[2] and rank[t] >= rank[old[0]]:
            kept[c, s] = [t, score, old[2], i]
    df = spark.createDataFrame(rows, "chunk_id string, standard_id string, alignment_source string, alignment_score double, verified_by_human int, arrival long")
    got = {(x["chunk_id"], x["standard_id"]): x["arrival"] for x in merge.merge_alignments(df.repartition(5)).collect()}
    assert got == {k: v[3] for k, v in kept.items()}


def test_upserts_are_idempotent(spark):
    ddl = "chunk_id string, title string, content string, content_hash string, last_verified string, created_at string, stale int"
    old = spark.createDataFrame([("a", "A", "x", "h", "1", "1", 1), ("b", "B", "y", "h", "1", "1", 0)], ddl)
    new = spark.createDataFrame([("a", None, "z"), ("c", "C", "w")], "chunk_id string, title string, content string")
    first = merge.upsert_chunks(old, new, now="2")
    assert merge.change_counts(first).first().asDict() == {"added": 1, "updated": 1, "kept": 1}
    a = first.where("chunk_id = 'a'").first()
    assert (a["title"], a["created_at"], a["stale"], a["last_verified"]) == (None, "1", 0, "2")
    again = merge.upsert_chunks(first.drop("_change"), new, now="2")
    assert again.drop("_change").exceptAll(first.drop("_change")).count() == 0
    books = spark.createDataFrame([("b", "6-8")], "id string, grade_band string")
    assert merge.inherit_grades(spark.createDataFrame([("c", "b", None), ("d", "b", "K-5")], "chunk_id string, book_id string, grade_band string"), books).orderBy("chunk_id").toPandas()["grade_band"].tolist() == ["6-8", "K-5"]
    snaps = spark.createDataFrame([("src-book-m1", "/p")], "prefix string, path string")
    assert merge.attach_snapshots(spark.createDataFrame([("src-book-m1-expo1",)], "chunk_id string"), snaps).first()["snapshot_path"] == "/p"
    assert merge.insert_absent(first, new, "chunk_id").count() == 0
    assert [one(spark, merge.series_family(F.lit(x))) for x in ("SAT", "Smarter Balanced 8", "NAEP Grade 4")] == ["sat", "smarter-balanced", "naep"]
    with pytest.raises(Exception, match="unknown exam series"):
        one(spark, merge.series_family(F.lit("X")))
    log = merge.run_record("src", merge.change_counts(first), spark.createDataFrame([("w",)], "warning string"), run_date="2026-01-01").first()
    assert json.loads(log["warnings"]) == ["w"] and log["added"] == 1


def test_verdicts(spark):
    al = spark.createDataFrame([("a", "S", "ccss", 0.7, "embedding", None, 0, 1), ("b", "S", "ccss", 0.7, "publisher_guide", None, 0, 2), ("c", "S", "ccss", 0.7, "human", None, 0, 3)], ALIGN)
    v = spark.createDataFrame([("a", "S", "verified", "n1"), ("b", "S", "verified", "n2"), ("c", "S", "reject", "n3"), ("z", "S", "verified", "n4")], "chunk_id string, standard_id string, verdict string, note string")
    once = merge.apply_verdicts(al, v)
    assert {r["chunk_id"]: (r["alignment_source"], r["stale"], r["coverage_notes"]) for r in once.collect()} == {"a": ("llm_verified", 0, "n1"), "b": ("publisher_guide", 0, None), "c": ("human", 1, "n3")}
    assert merge.apply_verdicts(once, v).exceptAll(once).count() == 0
    assert merge.verdict_counts(al, v).first().asDict() == {"verified": 2, "rejected": 1, "missing": 1}
    with pytest.raises(Exception, match="unknown verdict"):
        merge.apply_verdicts(al, v.withColumn("verdict", F.lit("maybe"))).collect()


def test_grades_and_ids(spark):
    d = lambda b, g: one(spark, S.grade_distance(F.lit(b).cast("string"), F.lit(g).cast("string")))
    assert [d("6-8", "K"), d("6-8", "3"), d("6-8", "HS"), d("6-8", "7"), d("K-12", "3"), d(None, "3"), d("6-8", None), d(" k-5 ", "8")] == [6, 3, 2, 0, 0, 0, 0, 3]
    ids = lambda f, xs: [one(spark, f(F.lit(x))) for x in xs]
    m = "CCSS.MATH."
    assert ids(S.id_from_lesson_tag, ["3.MD.B.3", "6.G.A.1", "HSA-CED.A.2", "3.MD.B", "6.G.A", "nope", "K.CC.A.1.a", "7.RP.A.2.b"]) == [m + "3.MD.B.3", m + "6.G.1", m + "HSA.CED.A.2", m + "3.MD.B", None, None, m + "K.CC.A.1", m + "7.RP.2"]
    assert ids(S.id_from_item_tag, ["3.OA.8", "6.RP.A.3", "F-IF.4", "6.RP", "x.y.z"]) == [m + "3.OA.8", m + "6.RP.3", m + "HSF.IF.4", None, None]
    assert ids(S.id_from_state_name, ["7.NS.A.2", "3.MD.A.1", "G-SRT.B.5", "A1.A-REI.A.1", "8.EE.1", "?"]) == [m + "7.NS.2", m + "3.MD.A.1", m + "HSG.SRT.B.5", m + "HSA.REI.A.1", m + "8.EE.1", None]
    assert ids(S.id_from_problem_tag, ["A-SSE.3", "3.OA.8", "DOK 2", "Someone"]) == [m + "HSA.SSE.3", m + "3.OA.8", None, None]


def test_alignment(spark):
    e = np.eye(4)
    chunks = spark.createDataFrame([("c1", "Fractions", "exposition", "6-8", "b", 0), ("c2", "Self Check ", "exercise_set", "6-8", "b", 0), ("c3", "Old", "exposition", "6-8", "b", 1)], "chunk_id string, title string, content_type string, grade_band string, book_id string, stale int")
    v = spark.createDataFrame([(c, (e[0] + 0.2 * e[1]).tolist()) for c in ("c1", "c2", "c3")], "chunk_id string, vector array<double>")
    st = spark.createDataFrame([("S1", "ccss", "7"), ("S2", "ccss", "K"), ("S3", "ap", "7")], "standard_id string, system string, grade string")
    sv = spark.createDataFrame([("S1", e[1].tolist()), ("S2", e[0].tolist()), ("S3", e[0].tolist())], "standard_id string, vector array<double>")
    got = align.align(chunks, v, st, sv, system="ccss", threshold=0.1).collect()
    base = 1 / np.sqrt(1.04)
    assert {(r["chunk_id"], r["standard_id"], r["alignment_score"], r["flagged"]) for r in got} == {("c1", "S2", round(base - 0.12, 4), True), ("c1", "S1", round(0.2 * base, 4), False)}
    top = align.cosine_top_k(v.selectExpr("chunk_id id", "vector"), sv.selectExpr("standard_id id", "vector"), k=1, threshold=0.5, most=1)
    assert {(r["left_id"], r["right_id"]) for r in top.collect()} == {("c1", "S2"), ("c2", "S2"), ("c3", "S2")}

    def flaky(texts):
        raise OSError("down")

    docs = spark.createDataFrame([("a", "t", "x", 0), ("b", "t", "", 0)], "chunk_id string, title string, content string, stale int")
    none = spark.createDataFrame([], "chunk_id string")
    assert align.embed_pending(docs, none, flaky, model="m").count() == 0
    assert align.embed_pending(docs, docs.limit(1), align.hashing_embedder(8), model="m").count() == 1
    assert one(spark, F.get(IO.decode_vectors(IO.encode_vectors(F.array(F.lit(0.5), F.lit(2.0)))), F.lit(1))) == 2.0


def test_alignment_in_blocks_sends_one_block_or_pivots(spark, monkeypatch):
    r = np.random.default_rng(3)
    x, y = r.normal(size=(90, 6)), r.normal(size=(70, 6))
    y[40:50] = y[:10]
    left = spark.createDataFrame([(f"c{i:02}", v.tolist()) for i, v in enumerate(x)], "chunk_id string, vector array<double>").repartition(3)
    sv = spark.createDataFrame([(f"s{i:02}", v.tolist()) for i, v in enumerate(y)], "standard_id string, vector array<double>")
    st = sv.selectExpr("standard_id", "'ccss' system", "'7' grade")
    chunks = left.selectExpr("chunk_id", "'t' title", "'exposition' content_type", "'K-5' grade_band", "'b' book_id", "0 stale")
    cos = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T
    best = lambda s, k, low: {(f"c{i:02}", f"s{j:02}") for i in range(90) for j in sorted((j for j in range(70) if s[i, j] >= low), key=lambda j: (-round(s[i, j], 9), j))[:k]}

    collect, to_arrow, sent = type(left).collect, type(left).toArrow, []

    def pivots_only(df):
        out = collect(df)
        assert "vector" not in df.columns or len(out) <= -(-90 // sent[-1]) <= align.CELLS
        return out

    def a_block_only(df):
        out = to_arrow(df)
        assert "vector" not in out.column_names or len(out) <= sent[-1]
        return out

    monkeypatch.setattr(type(left), "toArrow", a_block_only)
    monkeypatch.setattr(type(left), "collect", pivots_only)
    rows = lambda df: df.toPandas().itertuples(index=False, name=None)
    ids = lambda df: df.selectExpr(f"{df.columns[0]} id", "vector")
    for block in (4096, 75, 16):
        sent.append(block)
        assert {(a, b) for a, b, _ in rows(align.cosine_top_k(ids(left), ids(sv), k=4, threshold=0.3, block=block))} == best(cos, 4, 0.3)
        assert {(a, b) for a, b, *_ in rows(align.align(chunks, left, st, sv, k=4, threshold=0.3, block=block))} == best(cos - 0.04, 4, 0.3)


def test_search(spark):
    rows = [chunk("c-frac", title="dividing fractions", part=p) for p in ("core", "ncsa")] + [chunk("c-ratio", title="ratios and rates"), chunk("c-int", "worked_example", title="integers")]
    q = spark.createDataFrame([(1, "Dividing FRACTIONS"), (2, "!!!"), (3, "ratios")], "query_id long, query_text string")
    got = search.hybrid_search(q, spark.createDataFrame(rows, CHUNKS)).collect()
    assert [r["chunk_id"] for r in got if r["query_id"] == 1 and r["rank"] == 1] == ["c-frac"] and sum(r["query_id"] == 1 for r in got) == 1
    assert [(r["mode"], r["chunk_id"]) for r in got if r["query_id"] == 2] == [("empty_query", None)]
    assert search.hybrid_search(q, spark.createDataFrame(rows, CHUNKS), content_type="worked_example").where("query_id < 3 and chunk_id is not null").count() == 0
    vec = spark.createDataFrame([("c-frac", [1.0, 0.0]), ("c-ratio", [0.0, 1.0])], "id string, vector array<double>")
    qv = spark.createDataFrame([(3, [0.0, 1.0])], "id long, vector array<double>")
    both = search.hybrid_search(q.where("query_id = 3"), spark.createDataFrame(rows[1:], CHUNKS), query_vectors=qv, chunk_vectors=vec).orderBy("rank").collect()
    assert both[0]["chunk_id"] == "c-ratio" and both[0]["mode"] == "hybrid"


def test_review(spark):
    assert [one(spark, review.parse_verdict(F.lit(x))) for x in (" yes it is", "NO", "maybe")] == [True, False, None]
    assert one(spark, review.template_note(F.lit("Practice"), F.lit("exercise_set"), F.lit(None).cast("string"), F.lit("M.6.RP.3"), F.lit("Ratios: more"))).startswith("Provides practice problems for Ratios.")
    al = spark.createDataFrame([(1, 0.7, "embedding"), (2, 0.7, "embedding"), (3, 0.7, "embedding"), (4, 0.94, "embedding")], "align_id long, alignment_score double, alignment_source string")
    ans = spark.createDataFrame([(1, '{"aligned": true}'), (2, '{"aligned": false}'), (3, "oops"), (4, '{"aligned": true}')], "align_id long, answer string")
    assert {r["align_id"]: (r["alignment_score"], r["outcome"]) for r in review.rescore(al, ans).collect()} == {1: (0.75, "aligned"), 2: (0.6, "not_aligned"), 3: (0.7, "error"), 4: (0.95, "aligned")}


def test_acceptance(spark):
    c = spark.createDataFrame([(f"c{i}", "a fraction", "fraction text", "src", 0) for i in range(20)], "chunk_id string, title string, content string, attribution string, stale int")
    a = spark.createDataFrame([("c1", "S", 0)], "chunk_id string, standard_id string, stale int")
    checks = audit.acceptance(c, c.limit(3), a, min_chunks=10)
    assert audit.passed(checks).first()["passed"] and not checks.where("name = 'embedded'").first()["ok"]
    assert not audit.passed(audit.acceptance(c.withColumn("attribution", F.lit(None).cast("string")), c, a, min_chunks=10)).first()["passed"]


def test_evaluation(spark):
    rows = [("x", "y", w) for w in ["x"] * 7 + ["y"] * 2 + ["tie", None]]
    r = evals.win_rates(spark.createDataFrame(rows, "left string, right string, winner string")).first()
    assert (r["win_rate"], r["target_met"], r["ties"], r["unparsed"]) == (0.778, True, 1, 1)
    assert [one(spark, evals.parse_preference(F.lit(x))) for x in ("A", "b.", "It is a TIE", "I prefer B", "both B and A", "no ties", "1. tie", "none")] == ["A", "B", "TIE", "B", "B", None, "TIE", None]
    h = spark.createDataFrame([(True, True, "B\nbetter"), (False, True, " \n a wins"), (True, False, "hm"), (None, True, None), (False, False, "")], "a_ok boolean, b_ok boolean, answer string")
    assert evals.head_to_head(h).first().asDict() == {"a_wins": 1, "b_wins": 1, "ties": 2, "a_passed": 2, "b_passed": 3, "n": 5}
    s = spark.createDataFrame([("s1", ["f"], ["f"], 1, ["Yes"], "oh YES"), ("s2", ["f", "g"], ["f"], 1, [], ""), ("s3", ["f"], ["f"], 2, [], ""), ("s4", [], [], 0, ["no"], "x")], "scenario string, expected_tools array<string>, called_tools array<string>, min_calls int, phrases array<string>, answer string")
    assert {r["scenario"]: r["reason"] for r in evals.check_scenarios(s).collect()} == {"s1": "ok", "s2": "tools not called: g", "s3": "too few calls", "s4": "phrase missing: no"}
    top = spark.createDataFrame([(1, 2, "b", "y"), (1, 1, "a", "x")], "question_id long, rank int, content string, attribution string")
    assert evals.context(top).first()["context"] == "a\n[x]\n\nb\n[y]"


def test_sources(spark, tmp_path):
    spark.createDataFrame([("c1", "t")], "chunk_id string, title string").write.parquet(f"{tmp_path}/core")
    parts = IO.read_parts(spark, f"{tmp_path}/core", {"ncsa": f"{tmp_path}/none"})
    assert parts.count() == 1
    with pytest.raises(FileNotFoundError):
        IO.read_parts(spark, f"{tmp_path}/missing")
    healed, added = IO.heal(parts)
    assert len(added) == 7 and IO.heal(healed)[1] == []
    seed = '// a comment\n{"crosswalks": [\n {"standard_id": "M.8", "url": "https://x.y"}\n]}'
    df = spark.createDataFrame([(seed,), ('[{"standard_id": "M.9", "url": null}]',)], "value string")
    assert sorted(r["standard_id"] for r in IO.read_seed(df, "standard_id string, url string", "crosswalks").collect()) == ["M.8", "M.9"]
    raw = spark.createDataFrame([("s", "a:b/c", "2026-01-02T03:04:05", "x")], "source_id string, key string, fetched_at string, payload string")
    assert IO.snapshot_paths(raw).first()["path"] == "s/2026-01-02/a__b_c.txt"
    IO.write_snapshots(raw, f"{tmp_path}/snap")
    IO.write_snapshots(raw.withColumn("fetched_at", F.lit("2026-01-03")), f"{tmp_path}/snap")
    IO.write_snapshots(raw.withColumn("fetched_at", F.lit("2026-01-03")), f"{tmp_path}/snap")
    assert spark.read.parquet(f"{tmp_path}/snap").count() == 2
    IO.write_report(raw, f"{tmp_path}/report")
    IO.write_result(raw, f"{tmp_path}/result")
    assert spark.read.csv(f"{tmp_path}/report", header=True).count() == spark.read.json(f"{tmp_path}/result").count() == 1


def test_columns(spark):
    vtt = "WEBVTT\n\n1\n00:00 --> 00:02\n- [Voiceover] Hello <i>there</i>\n\n00:02 --> 00:03\nHello there\nfriend\nNOTE x\n"
    assert one(spark, C.transcript_text(F.lit(vtt))) == "Hello there friend"
    g = lambda t: one(spark, C.grade_band(F.lit(t)))
    assert [g(t) for t in ("Kindergarten", "3rd grade", "7th grade", "Algebra 1", "Arithmetic", "11th grade")] == ["K-5", "K-5", "6-8", "9-12", None, "9-12"]
    assert one(spark, C.administration(F.lit("62025"))).asDict() == {"month": 6, "year": 2025}
    key = one(spark, C.scoring_key(F.lit("Algebra I June '25 7 1 MC 2\nAlgebra I June '25 8 4 MC 2")))
    assert key == {7: 1, 8: 4}
    assert one(spark, C.objective_ids(F.lit("x aplo-2-01 aplo-2-1 aplo-3-4"), F.lit("ap-bio"))) == ["AP.AP_BIO.2.1", "AP.AP_BIO.3.4"]
    title = lambda *h: one(spark, C.page_title(F.array(*map(F.lit, h)), F.lit("Unit 1")))
    assert title("", "x" * 100, "Warm up (12 minutes)", "z") == "Unit 1: Warm up" and title("") == "Unit 1"
    choices = F.array(F.struct(F.lit("B").alias("id"), F.lit("four").alias("text")))
    answer = lambda r: one(spark, C.rubric_answer(F.lit(r), choices))
    assert answer('{"ScoreGroups": [{"RubricStates": [{"id": "B"}, {"val": "7"}]}, {}]}') == "Correct: (B) four; (7)"
    assert answer('{"HumanScoringGuide": " <p>Give one point</p>"}') == "Give one point" and answer("{}") is None and answer(None) is None
    perf = '{"result": {"series": [{"dataPoints": [{"AxisLabel": "x", "YValues": [1]}, {"AxisLabel": "y*", "YValues": [45, 2]}]}]}}'
    assert one(spark, C.percent_correct(F.lit(perf))) == 0.45 and one(spark, C.percent_correct(F.lit('{"result": {}}'))) is None and one(spark, C.percent_correct(F.lit(None).cast("string"))) is None
    assert [one(spark, C.item_type(F.lit(x), c)) for x, c in (("SR", "state"), ("mc", "national"), ("GI", "consortium"), ("?", "state"))] == ["multiple_choice", "multiple_choice", "performance_task", "constructed_response"]
    lit = F.lit
    assert one(spark, C.catalogue_lines(lit(7), lit("Equation"), lit("7.NS.A.1"), lit(""), lit(0), lit("NS"), lit(None), lit("T"), lit("u"))) == "Smarter Balanced Grade 7 Mathematics Assessment Item\nType: Equation\nStandard: CCSS.MATH.Content.7.NS.A.1\nDomain: NS\nTarget: T\n\nView item: u"
    booklet = "Cover page " * 12 + "\nQuestion 3 " + "solve this now " * 8 + "\nGO ON TO THE NEXT PAGE. 4\n2. Find " + "the value here " * 8 + "© 2024 College Board. Visit collegeboard.org.\nProblem 9 short"
    assert [(x["number"], x["text"][:10], x["text"][-4:]) for x in one(spark, C.free_response(F.lit(booklet)))] == [(3, "Question 3", " now"), (2, "2. Find th", "here")]
    assert one(spark, C.child_numbers(F.lit('href="/u/10" href="/u/2" href="/u/2"'), "/u")) == [2, 10]
    books = spark.createDataFrame([("b", [["m1", "m2"], ["m3"]])], "slug string, chapters array<array<string>>")
    mods = spark.createDataFrame([("b", "m0"), ("b", "m2"), ("b", "m3")], "slug string, module_id string")
    assert sorted((r["module_id"], r["chapter"], r["section"]) for r in C.place_in_book(books, mods).collect()) == [("m2", 1, 2), ("m3", 2, 1)]
    nodes = spark.createDataFrame([("r1", None), ("r2", None), ("a", "r1"), ("b", "a"), ("b", "r2")], "id string, parent_id string")
    roots = spark.createDataFrame([("r1", 1, "3rd grade"), ("r2", 2, "7th grade")], "id string, root_order int, title string")
    assert {r["id"]: r["band"] for r in C.inherited_grades(nodes, roots).collect()} == {"r1": "K-5", "r2": "6-8", "a": "K-5", "b": "K-5"}
    dup = spark.createDataFrame([("c", "x", None, 1), ("c", "y", "K-5", 2)], "content_id string, id string, band string, ord int")
    assert C.one_per_content(dup).first()["id"] == "y"


MODULE = """<document xmlns="x" xmlns:m="y"><title>Adding</title><content><section class="lead"><para>Add <m:math><m:mfrac><m:mn>1</m:mn><m:mn>4</m:mn></m:mfrac></m:math> now.</para></section>
<section><title>More</title><para>Prose here.</para><example class="aplo-2-1"><title>Try</title><para>Worked out.</para></example><media>no</media></section>
<section class="x key-concepts"><title>Sum</title><para>In short.</para></section><section class="section-exercises"><section><title>Verbal</title><para>1. Do it.</para></section><section/><section><para>2. Again.</para></section></section></content></document>"""


def test_documents(spark):
    got = D.split_module(MODULE, "m1", "src-b-m1")
    assert [c[:3] for c in got] == [
        ("src-b-m1-expo1", "exposition", "Adding"), ("src-b-m1-ex1", "worked_example", "Adding — Example 1"), ("src-b-m1-expo2", "exposition", "Adding: More"),
        ("src-b-m1-summary", "summary", "Adding — Key Concepts"), ("src-b-m1-set1", "exercise_set", "Adding — Verbal"), ("src-b-m1-set3", "exercise_set", "Adding — Exercises"),
    ]
    text = {c[0][9:]: c[3] for c in got}
    assert text["expo1"] == r"Add $\frac{1}{4}$ now." and text["ex1"] == "Try\nWorked out." and text["expo2"] == "More\nProse here." and got[1][4] == "aplo-2-1"
    flat = D.split_module(MODULE.replace("section-exercises", "review").replace("key-concepts", "summary"), "m1", "p", "science")
    assert [c[0] for c in flat] == ["p-expo1", "p-ex1", "p-expo2", "p-summary", "p-set1"] and flat[-1][2] == "Adding — Review"
    assert D.split_module("<broken", "m", "p") == []
    math = lambda x: D.latex(D.ET.fromstring(f"<math>{x}</math>"))
    assert math("<mn>2</mn><mo>×</mo><mi>x</mi>") == r"2\times x" and math("<msup><mi>ab</mi><mn>2</mn></msup>") == "{ab}^{2}" and math("<mtext>cm</mtext><mspace/>") == r"\text{cm}\ "
    assert math("<mfenced open='['><mi>a</mi><mi>b</mi></mfenced>") == "[a, b)" and math("<munder><mi>x</mi><mspace/></munder>") == "x"
    assert math("<mtable><mtr><mtd><mn>1</mn></mtd><mtd><mn>2</mn></mtd></mtr><mtr><mtd><mn>3</mn></mtd></mtr></mtable>") == r"\begin{matrix}1 & 2 \\ 3\end{matrix}"
    raw = spark.createDataFrame([("b", "m1", "math", MODULE), ("b", "m2", "math", None)], "slug string, module_id string, profile string, payload string")
    assert D.parse_modules(raw, "src").count() == 6
    long = "What is the value of x in this equation here"
    exam = f"Part I\nUse this space for\n1 {long}\n 7 (axis)\n2 {long}\nPart II\n[3]\n3 {long}\nHigh School Math Reference Sheet\n4 inches"
    assert [(n, t.split("\n")[0][:6]) for n, t in D.split_exam(exam)] == [(1, "1 What"), (2, "2 What"), (3, "3 What")] and "Reference" not in D.split_exam(exam)[2][1]
    item = json.dumps({"a": [{"prompt": "<p>What%20is it?</p>"}, {"tag": "STYLE", "html": "no text"}, {"html": "<i>And this.</i>"}], "b": {"distractors": [{"letter": "A", "content": "<b>one</b>"}, {"id": 2, "content": "two"}, {"content": "three"}], "prompt": "What is it?"}})
    assert D.item_content(item) == ("What is it?\n\nAnd this.", [("A", "one"), ("2", "two"), ("", "three")]) and D.item_content("{") == ("", [])
    block = "Forty characters of text or more are here, yes."
    page = f'<h1 class="im-c-hero__heading">Lesson  (12 minutes)</h1><div class="im-c-content"><div class="im-c-content">{block}</div><script>x</script></div><div class="im-c-content">{block}</div><div class="im-c-content">short</div>'
    page += '<p class="im-c-hero__underline">Addressing</p><span></span><ul><li><a>6.RP.A.1</a> <a>nope</a></li></ul><p class="im-c-hero__underline">Building On</p><ul><li><a>K.CC.A.1</a></li></ul>'
    r = D.parse_lessons(spark.createDataFrame([("k", "Unit 1", page.replace("hero__heading", "hero__heading", 1))], "key string, base string, payload string"), least_words=5).first()
    assert (r["title"], r["addressing"], r["content"]) == ("Unit 1: Lesson", ["CCSS.MATH.6.RP.1"], block) and r["standards"]["Building On"] == ["CCSS.MATH.K.CC.A.1"]
    prob = '<meta name="keywords" content="DOK 3: more, F-IF.4"><article><p>Directions: Fill the boxes with digits. Hint Think of ten. Source x</p></article><a rel="tag" href="#">3.OA.8</a><a rel="tag" href="#">Open Middle</a><a rel="tag" href="#">Ann Lee</a>'
    p = D.parse_problems(spark.createDataFrame([("k", "u", prob), ("k2", "u", prob), ("k3", "v", "<p>Directions: Fill the boxes.</p>")], "key string, url string, payload string")).collect()
    assert [tuple(x) for x in p] == [("k", "u", "k", "Directions: Fill the boxes with digits.\n\nAnswer/Hint: Think of ten.", ["CCSS.MATH.3.OA.8", "CCSS.MATH.HSF.IF.4"], 3, "Ann Lee", "HS", "9-12")]
    shot = '<img alt="x"><img alt="Screen shot of an interactive question. QUESTION TEXT: What &amp; why? ANSWER CHOICES: A. one">'
    pages = [(1, shot, ""), (2, "<p>a <b>b</b></p>", "<i>x</i>\u00a0 y &lt; z\\r\\nend"), (3, None, None), (4, '<img alt="QUESTION TEXT: lost"><img alt="the longest alternative of this page">&amp;', " " + "ab " * 300)]
    got = {r["key"]: (r["question"], r["answer_key"]) for r in D.parse_question_pages(spark.createDataFrame(pages, "key int, payload string, guide string")).collect()}
    assert got == {1: ("What & why?\nA. one", None), 2: ("a b", "x y < z\nend"), 3: ("", None), 4: ("&", ("ab " * 300)[:500])}


def test_validation(spark):
    c = spark.createDataFrame([("s", "exercise_set", "x", "by me"), ("s", "assessment", " ", None)], "source_id string, content_type string, content string, attribution string").selectExpr("*", "string(null) grade_band", "1 as dok_level")
    r = {x["source_id"]: (x["ok"], x["errors"], x["warnings"]) for x in audit.validation_report(c, spark.createDataFrame([("s",), ("t",)], "source_id string")).collect()}
    assert r == {"s": (False, "1 with empty content; 1 with empty attribution", "no exposition chunks; 2 items without standard alignment"), "t": (False, "no chunks produced", "")}
