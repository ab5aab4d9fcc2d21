"""The registered queries of the corpus operators over the fixture views, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.functions import standards as S
from scholia.operators import align, assess, audit, coverage, evals, inventory, merge, paths, retrieve, review, search
from scholia.plans.fixtures import view
from scholia.plans.registry import query
from scholia.sources import columns as C
from scholia.sources import layout
from scholia.sources.corpus import shared_folder

# pieces of SQL
_TIER = "CASE {} WHEN 'human' THEN 4 WHEN 'publisher_guide' THEN 3 WHEN 'llm_verified' THEN 2 ELSE 1 END"
_CONTENT = "CASE {} WHEN 'worked_example' THEN 3 WHEN 'exposition' THEN 2 WHEN 'exercise_set' THEN 2 ELSE 1 END"
_PART = "CASE {} WHEN 'core' THEN 0 WHEN 'ncsa' THEN 1 WHEN 'ap' THEN 2 WHEN 'state' THEN 3 ELSE 4 END"
_BAND = (
    "CASE WHEN {0} IS NULL THEN 'none' WHEN {1} IN ('human', 'publisher_guide', 'llm_verified') THEN CASE WHEN {0} >= 0.85e0 THEN 'strong' WHEN {0} >= 0.65e0 THEN 'moderate' WHEN {0} >= 0.45e0 THEN 'light' ELSE 'none' END "
    "ELSE CASE WHEN {0} >= 0.78e0 THEN 'strong' WHEN {0} >= 0.70e0 THEN 'moderate' WHEN {0} >= 0.65e0 THEN 'light' ELSE 'none' END END"
)
_TIERS = ", ".join(f"count(*) FILTER (alignment_source = '{t}') {t}" for t in ("human", "publisher_guide", "llm_verified", "embedding"))
_ANCESTORS = "SELECT question_id, array_to_string(list_slice(p, 1, i), '.') standard_id FROM (SELECT question_id, p, unnest(range(1, len(p) + 1)) i FROM (SELECT question_id, string_split(standard_id, '.') p FROM fx_questions))"
_BEST = f"""SELECT standard_id, alignment_score, alignment_source, chunk_id FROM (SELECT a.standard_id, a.alignment_score, a.alignment_source, a.chunk_id,
  row_number() OVER (PARTITION BY a.standard_id ORDER BY a.alignment_score DESC, {_PART.format('c.part')}, a.chunk_id) rn
  FROM fx_alignments a JOIN fx_chunks c USING (chunk_id) WHERE a.stale = 0 AND c.stale = 0) WHERE rn = 1"""
_GRADE = "CASE WHEN grade = 'K' THEN 0 WHEN grade = 'HS' THEN 10 ELSE TRY_CAST(grade AS INTEGER) END"
_LO = "CASE grade_band WHEN 'K-5' THEN 0 WHEN 'K-8' THEN 0 WHEN '6-8' THEN 6 WHEN '9-12' THEN 9 WHEN 'college' THEN 13 END"
_HI = "CASE grade_band WHEN 'K-5' THEN 5 WHEN 'K-8' THEN 8 WHEN '6-8' THEN 8 WHEN '9-12' THEN 12 WHEN 'college' THEN 16 END"
_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"


# ---- retrieval ----


@query(f"""SELECT question_id, CAST(rank AS INTEGER) rank, chunk_id, standard_id, round(alignment_score, 4) alignment_score, alignment_source, coverage_notes, source_id, part, title, content_type, grade_band, dok_level, exam_series FROM (
SELECT q.question_id, a.*, c.* EXCLUDE (chunk_id, stale), row_number() OVER (PARTITION BY q.question_id ORDER BY {_CONTENT.format('c.content_type')} DESC, {_TIER.format('a.alignment_source')} DESC, a.alignment_score DESC, a.chunk_id, a.standard_id) rank
FROM ({_ANCESTORS}) q JOIN fx_alignments a USING (standard_id) JOIN fx_chunks c USING (chunk_id) WHERE a.stale = 0 AND c.stale = 0) WHERE rank <= 3""")
def q1_content_for_standards(s: SparkSession, d: str) -> DataFrame:
    return retrieve.content_for_standards(view(s, d, "fx_questions"), view(s, d, "fx_alignments"), view(s, d, "fx_chunks"), k=3).drop("content")


@query(f"""SELECT question_id, CAST(rank AS INTEGER) rank, chunk_id, alignment_source, dok_level FROM (
SELECT q.question_id, a.chunk_id, a.alignment_source, c.dok_level, row_number() OVER (PARTITION BY q.question_id ORDER BY {_CONTENT.format('c.content_type')} DESC, {_TIER.format('a.alignment_source')} DESC, a.alignment_score DESC, a.chunk_id, a.standard_id) rank
FROM ({_ANCESTORS}) q JOIN fx_alignments a USING (standard_id) JOIN fx_chunks c USING (chunk_id) WHERE a.stale = 0 AND c.stale = 0 AND c.content_type = 'assessment' AND c.dok_level = 2 AND c.source_id = 'src-3') WHERE rank <= 5""")
def q4_filtered_content(s: SparkSession, d: str) -> DataFrame:
    out = retrieve.content_for_standards(view(s, d, "fx_questions"), view(s, d, "fx_alignments"), view(s, d, "fx_chunks"), k=5, dok_level=2, source="src-3")
    return out.select("question_id", "rank", "chunk_id", "alignment_source", "dok_level")


@query(f"""SELECT q.question_id, q.standard_id, 'no_aligned_content' reason, (SELECT string_agg(DISTINCT source_id, ',' ORDER BY source_id) FROM fx_chunks WHERE stale = 0) available_sources
FROM fx_questions q WHERE NOT EXISTS (SELECT 1 FROM ({_ANCESTORS}) p JOIN fx_alignments a USING (standard_id) JOIN fx_chunks c USING (chunk_id) WHERE p.question_id = q.question_id AND a.stale = 0 AND c.stale = 0 AND c.content_type = 'assessment' AND c.dok_level = 2 AND c.source_id = 'src-3')""")
def q6_unanswered(s: SparkSession, d: str) -> DataFrame:
    chunks = view(s, d, "fx_chunks")
    hits = retrieve.content_for_standards(view(s, d, "fx_questions"), view(s, d, "fx_alignments"), chunks, k=1, dok_level=2, source="src-3")
    return retrieve.unanswered(view(s, d, "fx_questions"), hits, chunks)


@query("""SELECT i.chunk_id, CASE WHEN c.chunk_id IS NULL THEN 'not_found' ELSE 'found' END AS result, c.title, CAST(coalesce(n, 0) AS BIGINT) AS alignments, first_standard
FROM (SELECT chunk_id FROM fx_chunks UNION SELECT 'chunk-0') i LEFT JOIN (SELECT * FROM fx_chunks WHERE stale = 0) c USING (chunk_id)
LEFT JOIN (SELECT chunk_id, count(*) n, first(standard_id ORDER BY alignment_score DESC, standard_id) first_standard FROM fx_alignments WHERE stale = 0 GROUP BY chunk_id) a USING (chunk_id)""")
def q7_chunk_details(s: SparkSession, d: str) -> DataFrame:
    c = view(s, d, "fx_chunks")
    ids = c.select("chunk_id").union(c.select(F.lit("chunk-0")).limit(1))
    out = retrieve.chunk_details(ids, c, view(s, d, "fx_alignments"))
    return out.select("chunk_id", "result", "title", F.coalesce(F.size("alignments"), F.lit(0)).cast("long").alias("alignments"), F.get("alignments", F.lit(0))["standard_id"].alias("first_standard"))


@query("""SELECT chunk_id, part, book_id, lag(chunk_id) OVER w AS previous, lead(chunk_id) OVER w AS next FROM fx_chunks WHERE stale = 0 WINDOW w AS (PARTITION BY part, book_id ORDER BY ord, chunk_id)""")
def q8_neighbours(s: SparkSession, d: str) -> DataFrame:
    return retrieve.neighbours(view(s, d, "fx_chunks"))


# ---- search ----


@query(f"SELECT query_id, term, count(*) times FROM (SELECT query_id, unnest({_WORDS.format('query_text')}) term FROM fx_queries) GROUP BY ALL")
def q9_query_terms(s: SparkSession, d: str) -> DataFrame:
    return search.query_terms(view(s, d, "fx_queries"))


_BM25 = f"""WITH w AS (SELECT chunk_id, stale, {_WORDS.format("concat_ws(' ', title, content)")} w FROM fx_docs), st AS (SELECT count(*) n, sum(len(w)) / count(*) mean FROM w),
q AS (SELECT query_id, term, count(*) times FROM (SELECT query_id, unnest({_WORDS.format('query_text')}) term FROM fx_queries) GROUP BY ALL),
tf AS (SELECT chunk_id, stale, len, term, count(*) tf FROM (SELECT chunk_id, stale, len(w) len, unnest(w) term FROM w) WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) df FROM tf GROUP BY term),
sc AS (SELECT query_id, chunk_id, round(sum(times * ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * len / mean))), 6) score FROM q JOIN df USING (term) JOIN tf USING (term) CROSS JOIN st WHERE stale = 0 GROUP BY ALL),
k AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) rank FROM sc)"""


@query(f"{_BM25} SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) rank FROM k WHERE rank <= 50")
def q10_keyword_search(s: SparkSession, d: str) -> DataFrame:
    docs = view(s, d, "fx_docs")
    return search.keyword_hits(view(s, d, "fx_queries"), docs, search.filtered(docs))


@query("""SELECT query_id, chunk_id, CAST(rank AS INTEGER) rank, score FROM (SELECT q.std_num query_id, c.doc_id chunk_id, round(round(round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9), 6), 4) score,
row_number() OVER (PARTITION BY q.std_num ORDER BY round(round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9), 6) DESC, c.doc_id) rank FROM fx_vec_standards q, fx_vec_chunks c) WHERE rank <= 5""")
def q11_semantic_search(s: SparkSession, d: str) -> DataFrame:
    q = view(s, d, "fx_vec_standards").selectExpr("std_num as id", "embedding as vector")
    c = view(s, d, "fx_vec_chunks").selectExpr("doc_id as id", "embedding as vector")
    return search.semantic_hits(q, c, limit=5).withColumn("score", F.round("score", 4)).select("query_id", "chunk_id", "rank", "score")


_ARMS = f"""WITH w AS (SELECT chunk_id, ord, part, stale, {_WORDS.format("concat_ws(' ', title, content)")} w FROM fx_docs JOIN fx_places USING (chunk_id)), st AS (SELECT part, count(*) n, sum(len(w)) / count(*) mean FROM w GROUP BY part),
q AS (SELECT query_id, term, count(*) times FROM (SELECT query_id, unnest({_WORDS.format('query_text')}) term FROM fx_queries) GROUP BY ALL),
tf AS (SELECT chunk_id, part, stale, len, term, count(*) tf FROM (SELECT chunk_id, part, stale, len(w) len, unnest(w) term FROM w) WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT part, term, count(*) df FROM tf GROUP BY ALL),
sc AS (SELECT query_id, part, chunk_id, round(sum(times * ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * len / mean))), 6) score FROM q JOIN tf USING (term) JOIN df USING (part, term) JOIN st USING (part) WHERE stale = 0 GROUP BY ALL),
kw AS (SELECT query_id, part, chunk_id, row_number() OVER (PARTITION BY query_id, part ORDER BY score DESC, chunk_id) rank FROM sc),
cs AS (SELECT query_id, part, chunk_id, round(round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 9), 6) score FROM fx_queries JOIN embeddings x ON x.vec_id = query_id, w JOIN embeddings y ON y.vec_id = ord WHERE stale = 0),
se AS (SELECT query_id, part, chunk_id, row_number() OVER (PARTITION BY query_id, part ORDER BY score DESC, chunk_id) rank FROM cs),
f AS (SELECT query_id, part, chunk_id, round(sum(1e0 / (60 + rank)), 9) score FROM (SELECT * FROM kw WHERE rank <= 50 UNION ALL SELECT * FROM se WHERE rank <= 50) GROUP BY ALL),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id, part ORDER BY score DESC, chunk_id) rank FROM f)"""


def _document_vectors(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Vectors of the search queries and of the documents: those of their numbers."""
    e = view(s, d, "embeddings")
    q = view(s, d, "fx_queries").join(e, F.col("query_id") == F.col("vec_id")).selectExpr("query_id as id", "embedding as vector")
    return q, view(s, d, "fx_docs").join(e, F.col("ord") == F.col("vec_id")).selectExpr("chunk_id as id", "embedding as vector")


@query(f"{_ARMS.replace('JOIN fx_places USING (chunk_id)', '').replace('ord, part,', """ord, 'all' part,""")} SELECT query_id, chunk_id, round(score, 6) score, CAST(rank AS INTEGER) rank FROM fr WHERE rank <= 10")
def q12_fusion(s: SparkSession, d: str) -> DataFrame:
    docs = view(s, d, "fx_docs")
    q, v = _document_vectors(s, d)
    live = search.filtered(docs)
    out = search.fuse(search.keyword_hits(view(s, d, "fx_queries"), docs, live), search.semantic_hits(q, v, live))
    return out.where("rank <= 10").withColumn("score", F.round("score", 6))


@query(f"""{_ARMS}, p AS (SELECT query_id, chunk_id, part, round(1e0 / (60 + row_number() OVER (PARTITION BY query_id ORDER BY {_PART.format('part')}, rank)), 9) score FROM fr),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) rank FROM p) SELECT query_id, CAST(rank AS INTEGER) rank, chunk_id, part, score, 'hybrid' AS mode FROM t WHERE rank <= 5""")
def q13_hybrid_search(s: SparkSession, d: str) -> DataFrame:
    q, v = _document_vectors(s, d)
    docs = view(s, d, "fx_docs").join(view(s, d, "fx_places"), "chunk_id")
    return search.hybrid_search(view(s, d, "fx_queries"), docs, query_vectors=q, chunk_vectors=v, limit=5)


@query(f"{_BM25} SELECT query_id, CAST(rank AS INTEGER) rank, chunk_id, 'core' part, score, 'keyword_fallback' AS mode FROM k WHERE rank <= 5")
def q25_search_without_vectors(s: SparkSession, d: str) -> DataFrame:
    docs = view(s, d, "fx_docs").withColumn("part", F.lit("core"))
    return search.hybrid_search(view(s, d, "fx_queries"), docs, limit=5)


# ---- coverage ----


@query(f"SELECT standard_id, alignment_score, alignment_source, chunk_id, part FROM (SELECT * FROM ({_BEST}) JOIN (SELECT chunk_id, part FROM fx_chunks) USING (chunk_id))")
def q16_best_alignment(s: SparkSession, d: str) -> DataFrame:
    return coverage.best_alignments(view(s, d, "fx_alignments"), view(s, d, "fx_chunks"))


_CLUSTER = "SELECT q.question_id, t.standard_id FROM fx_questions q JOIN fx_standards e ON e.standard_id = q.standard_id AND e.system = q.system JOIN fx_standards t ON t.system = e.system AND t.domain = e.domain AND t.cluster = e.cluster"


@query(f"""SELECT x.question_id, x.standard_id, {_BAND.format('b.alignment_score', 'b.alignment_source')} coverage, b.chunk_id best_chunk, round(b.alignment_score, 4) alignment_score, b.alignment_source FROM ({_CLUSTER}) x LEFT JOIN ({_BEST}) b USING (standard_id)""")
def q17_coverage_details(s: SparkSession, d: str) -> DataFrame:
    return coverage.coverage_details(view(s, d, "fx_questions"), view(s, d, "fx_standards"), view(s, d, "fx_alignments"), view(s, d, "fx_chunks"))


@query(f"""WITH r AS (SELECT x.question_id, x.standard_id, CASE {_BAND.format('b.alignment_score', 'b.alignment_source')} WHEN 'strong' THEN 3 WHEN 'moderate' THEN 2 WHEN 'light' THEN 1 ELSE 0 END k
FROM ({_CLUSTER}) x LEFT JOIN ({_BEST.replace("a.stale = 0 AND", "a.stale = 0 AND c.source_id = 'src-1' AND")}) b USING (standard_id))
SELECT question_id, count(*) standards_checked, CASE coalesce(min(k) FILTER (k > 0), 0) WHEN 3 THEN 'strong' WHEN 2 THEN 'moderate' WHEN 1 THEN 'light' ELSE 'none' END overall_coverage,
coalesce(string_agg(standard_id, ',' ORDER BY standard_id) FILTER (k = 0), '') gaps, 'full' gap_detection, 'ok' AS result FROM r GROUP BY question_id""")
def q18_coverage_report(s: SparkSession, d: str) -> DataFrame:
    return coverage.coverage_report(view(s, d, "fx_questions"), view(s, d, "fx_standards"), view(s, d, "fx_alignments"), view(s, d, "fx_chunks"), source="src-1")


@query("""SELECT p.n_nationkey question_id, s.standard_id, s.standard_text FROM nation p JOIN fx_standards s ON s.system = 'ccss' AND starts_with(s.standard_id, concat('STD.', CAST(p.n_regionkey AS VARCHAR), '.', CAST(p.n_nationkey AS VARCHAR)))""")
def q15_cluster_by_prefix(s: SparkSession, d: str) -> DataFrame:
    q = view(s, d, "nation").selectExpr("n_nationkey as question_id", "concat('STD.', n_regionkey, '.', n_nationkey, '.A') standard_id", "'ccss' as system")
    return coverage.expand_clusters(q, view(s, d, "fx_standards"))


@query("""SELECT p.n_nationkey question_id, s.standard_id, 'unavailable_without_catalogue' gap_detection FROM nation p JOIN (SELECT DISTINCT standard_id FROM fx_alignments WHERE stale = 0) s ON starts_with(s.standard_id, concat('STD.', CAST(p.n_regionkey AS VARCHAR), '.', CAST(p.n_nationkey AS VARCHAR)))""")
def q19_coverage_without_catalogue(s: SparkSession, d: str) -> DataFrame:
    q = view(s, d, "nation").selectExpr("n_nationkey as question_id", "concat('STD.', n_regionkey, '.', n_nationkey) standard_id")
    return coverage.coverage_without_catalogue(q, view(s, d, "fx_alignments"))


# ---- assessments ----

_ITEMS = f"""SELECT q.question_id, c.exam_series, a.chunk_id, c.part, a.alignment_source, round(a.alignment_score, 4) alignment_score, c.dok_level, row_number() OVER (PARTITION BY q.question_id, c.exam_series ORDER BY {_PART.format('c.part')}, {_TIER.format('a.alignment_source')} DESC, a.alignment_score DESC, a.chunk_id) item_rank
FROM fx_questions q JOIN fx_alignments a USING (standard_id) JOIN fx_chunks c USING (chunk_id) WHERE a.stale = 0 AND c.stale = 0 AND c.content_type = 'assessment' AND c.exam_series IS NOT NULL"""


@query(f"SELECT p.question_id, w.standard_id matched_id, w.exam_series, w.skill_domain FROM ({_ANCESTORS}) p JOIN fx_crosswalk w USING (standard_id)")
def q20_exam_crosswalk(s: SparkSession, d: str) -> DataFrame:
    return assess.exam_crosswalk(view(s, d, "fx_questions"), view(s, d, "fx_crosswalk"))


@query(f"SELECT question_id, exam_series, CAST(item_rank AS INTEGER) item_rank, chunk_id, part, alignment_source, alignment_score, dok_level FROM ({_ITEMS}) WHERE item_rank <= 2")
def q21_exam_items(s: SparkSession, d: str) -> DataFrame:
    return assess.exam_items(view(s, d, "fx_questions"), view(s, d, "fx_alignments"), view(s, d, "fx_chunks"))


@query(f"""WITH w AS (SELECT DISTINCT p.question_id, w.exam_series FROM ({_ANCESTORS}) p JOIN fx_crosswalk w USING (standard_id)), i AS (SELECT question_id, exam_series, count(*) n FROM ({_ITEMS}) WHERE item_rank <= 2 GROUP BY ALL)
SELECT q.question_id, coalesce((SELECT string_agg(exam_series, ',' ORDER BY exam_series) FROM w WHERE w.question_id = q.question_id), '') exams, coalesce((SELECT string_agg(exam_series, ',' ORDER BY exam_series) FROM i WHERE i.question_id = q.question_id), '') with_items,
CAST(coalesce((SELECT sum(n) FROM i WHERE i.question_id = q.question_id), 0) AS BIGINT) items, coalesce((SELECT string_agg(exam_series, ',' ORDER BY exam_series) FROM w WHERE w.question_id = q.question_id AND NOT EXISTS (SELECT 1 FROM i WHERE i.question_id = q.question_id AND i.exam_series = w.exam_series)), '') gaps,
'full' crosswalk_coverage, 'ready' items_status FROM fx_questions q""")
def q22_assessment_map(s: SparkSession, d: str) -> DataFrame:
    return assess.assessment_map(view(s, d, "fx_questions"), view(s, d, "fx_crosswalk"), view(s, d, "fx_alignments"), view(s, d, "fx_chunks"))


# ---- paths ----

_WALK = """WITH RECURSIVE walk(question_id, system, standard_id, distance) AS (SELECT q.question_id, q.system, q.standard_id, 0 FROM fx_questions q UNION
SELECT w.question_id, w.system, e.target_id, w.distance + 1 FROM walk w JOIN fx_prereqs e ON e.source_id = w.standard_id JOIN fx_standards s ON s.standard_id = e.target_id AND s.system = w.system WHERE w.distance < 3),
nodes AS (SELECT question_id, standard_id, CAST(min(distance) AS INTEGER) distance FROM walk GROUP BY ALL)"""


@query(f"{_WALK} SELECT question_id, standard_id, distance FROM nodes")
def q23_prerequisites(s: SparkSession, d: str) -> DataFrame:
    return paths.prerequisites(view(s, d, "fx_questions"), view(s, d, "fx_standards"), view(s, d, "fx_prereqs"), depth=3)


@query(f"""{_WALK}, best AS ({_BEST}), top AS (SELECT standard_id, string_agg(chunk_id, ',' ORDER BY n) content FROM (SELECT a.standard_id, a.chunk_id, row_number() OVER (PARTITION BY a.standard_id ORDER BY {_TIER.format('a.alignment_source')} DESC, a.alignment_score DESC, a.chunk_id) n
FROM fx_alignments a JOIN fx_chunks c USING (chunk_id) WHERE a.stale = 0 AND c.stale = 0) WHERE n <= 2 GROUP BY standard_id)
SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY distance DESC, standard_id) AS INTEGER) AS step, standard_id, distance, {_BAND.format('alignment_score', 'alignment_source')} coverage, coalesce(content, '') AS content, {_BAND.format('alignment_score', 'alignment_source')} = 'none' is_gap
FROM nodes LEFT JOIN best USING (standard_id) LEFT JOIN top USING (standard_id)""")
def q24_learning_paths(s: SparkSession, d: str) -> DataFrame:
    return paths.learning_paths(view(s, d, "fx_questions"), view(s, d, "fx_standards"), view(s, d, "fx_prereqs"), view(s, d, "fx_alignments"), view(s, d, "fx_chunks"), depth=3)


# ---- inventory ----


@query("""SELECT o.part, o.source_id, books, coalesce(chunks, 0) chunks, coalesce(grade_bands, '') grade_bands, coalesce(standards, 0) standards, coalesce(alignments, 0) alignments FROM (SELECT part, source_id, count(DISTINCT book_id) books FROM fx_chunks GROUP BY ALL) o
LEFT JOIN (SELECT part, source_id, count(*) chunks, string_agg(DISTINCT grade_band, ',' ORDER BY grade_band) grade_bands FROM fx_chunks WHERE stale = 0 GROUP BY ALL) h USING (part, source_id)
LEFT JOIN (SELECT part, source_id, count(DISTINCT standard_id) standards, count(*) alignments FROM fx_alignments a JOIN fx_chunks c USING (chunk_id) WHERE a.stale = 0 AND c.stale = 0 GROUP BY ALL) s USING (part, source_id)""")
def q26_source_inventory(s: SparkSession, d: str) -> DataFrame:
    return inventory.source_inventory(view(s, d, "fx_chunks"), view(s, d, "fx_alignments"))


@query(f"""WITH c AS (SELECT coalesce(part, 'all') part, count(*) chunks, count(DISTINCT source_id) sources, count(DISTINCT grade_band) grade_bands, count(DISTINCT exam_series) exams, count(exam_series) exam_items FROM fx_chunks WHERE stale = 0 GROUP BY ROLLUP (part)),
a AS (SELECT coalesce(part, 'all') part, count(*) alignments, count(DISTINCT standard_id) standards, count(DISTINCT standard_system) systems, {_TIERS} FROM fx_alignments a JOIN fx_chunks c USING (chunk_id) WHERE a.stale = 0 AND c.stale = 0 GROUP BY ROLLUP (part))
SELECT * FROM c JOIN a USING (part)""")
def q27_capabilities(s: SparkSession, d: str) -> DataFrame:
    return inventory.capabilities(view(s, d, "fx_chunks"), view(s, d, "fx_alignments"))


@query("SELECT part, exam_series, count(*) AS items FROM fx_chunks WHERE stale = 0 AND exam_series IS NOT NULL GROUP BY ALL")
def q27_items_per_exam(s: SparkSession, d: str) -> DataFrame:
    return inventory.items_per_exam(view(s, d, "fx_chunks"))


# ---- audits ----


def _by_group(column: str) -> str:
    return f"""SELECT {column}, count(DISTINCT c.chunk_id) chunks, count(DISTINCT standard_id) standards, count(standard_id) alignments, CAST(sum(CAST(round(alignment_score * 1e6) AS BIGINT)) AS DOUBLE) / count(alignment_score) / 1e6 avg_score, min(alignment_score) min_score, max(alignment_score) max_score,
round(avg(CASE WHEN alignment_score >= 0.8e0 THEN 100e0 ELSE 0e0 END), 2) strong_percent FROM (SELECT * FROM fx_chunks WHERE stale = 0) c LEFT JOIN (SELECT * FROM fx_alignments WHERE stale = 0) a ON a.chunk_id = c.chunk_id GROUP BY {column}"""


@query(_by_group("grade_band"))
def a1_by_grade(s: SparkSession, d: str) -> DataFrame:
    return audit.by_group(view(s, d, "fx_chunks"), view(s, d, "fx_alignments"), "grade_band")


@query(_by_group("source_id"))
def a2_by_source(s: SparkSession, d: str) -> DataFrame:
    return audit.by_group(view(s, d, "fx_chunks"), view(s, d, "fx_alignments"), "source_id")


@query("""SELECT alignment_source, count(*) n, CAST(sum(CAST(round(alignment_score * 1e6) AS BIGINT)) AS DOUBLE) / count(alignment_score) / 1e6 avg_score, min(alignment_score) min_score, max(alignment_score) max_score, round(1e2 * count(*) FILTER (alignment_score >= 0.8e0) / count(*), 2) strong_percent FROM fx_alignments WHERE stale = 0 GROUP BY ALL""")
def a3_by_tier(s: SparkSession, d: str) -> DataFrame:
    return audit.by_tier(view(s, d, "fx_alignments"))


def _report(name: str, rows: str, chunk: str) -> str:
    return f"""SELECT '{name}' report, {name} AS value, count(DISTINCT {chunk}) chunks, count(DISTINCT standard_id) standards, count(standard_id) alignments, CAST(sum(CAST(round(alignment_score * 1e6) AS BIGINT)) AS DOUBLE) / count(alignment_score) / 1e6 avg_score,
min(alignment_score) min_score, max(alignment_score) max_score, count(*) FILTER (alignment_score >= 0.8e0) strong, {_TIERS}, round(1e2 * count(*) FILTER (alignment_score >= 0.8e0) / count(*), 2) strong_percent FROM {rows} GROUP BY {name}"""


_LIVE = "(SELECT * FROM fx_chunks WHERE stale = 0) c LEFT JOIN (SELECT * FROM fx_alignments WHERE stale = 0) a ON a.chunk_id = c.chunk_id"


@query(" UNION ALL ".join([_report("grade_band", _LIVE, "c.chunk_id"), _report("source_id", _LIVE, "c.chunk_id"), _report("alignment_source", "(SELECT * FROM fx_alignments WHERE stale = 0) a", "a.chunk_id")]))
def a1_a2_a3_a11_reports(s: SparkSession, d: str) -> DataFrame:
    return audit.quality_reports(view(s, d, "fx_chunks"), view(s, d, "fx_alignments"))


@query("""SELECT standard_id, chunks, avg_score, tiers, standard_text FROM (SELECT standard_id, count(DISTINCT chunk_id) chunks, CAST(sum(CAST(round(alignment_score * 1e6) AS BIGINT)) AS DOUBLE) / count(alignment_score) / 1e6 avg_score, string_agg(DISTINCT alignment_source, ',' ORDER BY alignment_source) tiers FROM fx_alignments WHERE stale = 0 GROUP BY standard_id ORDER BY chunks DESC, standard_id LIMIT 20) LEFT JOIN fx_standards USING (standard_id)""")
def a4_top_standards(s: SparkSession, d: str) -> DataFrame:
    return audit.top_standards(view(s, d, "fx_alignments"), view(s, d, "fx_standards"))


@query("""SELECT a.chunk_id, a.standard_id, a.alignment_source, a.alignment_score, c.title FROM fx_alignments a JOIN fx_chunks c USING (chunk_id) WHERE a.stale = 0 AND c.stale = 0 AND a.alignment_source IN ('human', 'publisher_guide') AND a.alignment_score < 0.7e0""")
def a5_outliers(s: SparkSession, d: str) -> DataFrame:
    return audit.outliers(view(s, d, "fx_alignments"), view(s, d, "fx_chunks"))


_LEVELS = """SELECT s.standard_id, s.domain, s.grade, coalesce(n, 0) chunks, avg_score, max_score, CASE WHEN coalesce(n, 0) >= 3 THEN 'strong' WHEN coalesce(n, 0) >= 1 THEN 'weak' ELSE 'none' END AS level FROM fx_catalogue s LEFT JOIN
(SELECT standard_id, count(DISTINCT chunk_id) n, CAST(sum(CAST(round(alignment_score * 1e6) AS BIGINT)) AS DOUBLE) / count(alignment_score) / 1e6 avg_score, max(alignment_score) max_score FROM fx_alignments a JOIN fx_chunks c USING (chunk_id) WHERE a.stale = 0 AND c.stale = 0 GROUP BY standard_id) g USING (standard_id)"""


def _levels(s: SparkSession, d: str) -> DataFrame:
    return audit.standard_coverage(view(s, d, "fx_catalogue"), view(s, d, "fx_alignments"), view(s, d, "fx_chunks"))


@query(f"SELECT * FROM ({_LEVELS}) WHERE chunks = 0 OR (chunks = 1 AND avg_score < 0.75e0)")
def a6_weak_standards(s: SparkSession, d: str) -> DataFrame:
    return audit.weak_standards(_levels(s, d))


@query(f"SELECT count(*) alignments, count(DISTINCT chunk_id) chunks, count(DISTINCT standard_id) standards, CAST(sum(CAST(round(alignment_score * 1e6) AS BIGINT)) AS DOUBLE) / count(alignment_score) / 1e6 avg_score, count(*) FILTER (alignment_score >= 0.8e0) strong, {_TIERS} FROM fx_alignments WHERE stale = 0")
def a7_summary(s: SparkSession, d: str) -> DataFrame:
    return audit.summary(view(s, d, "fx_alignments"))


@query("""SELECT count(*) total, count(coverage_notes) with_note, count(*) FILTER (length(coverage_notes) > 9) good, round(avg(length(coverage_notes)), 4) avg_length, round(1e2 * count(coverage_notes) / count(*), 2) note_percent, round(1e2 * count(*) FILTER (length(coverage_notes) > 9) / count(*), 2) good_percent FROM fx_alignments WHERE stale = 0""")
def a8_note_quality(s: SparkSession, d: str) -> DataFrame:
    return audit.note_quality(view(s, d, "fx_alignments"), length=9)


_DOMAINS = ("FRANCE", "CHINA", "BRAZIL", "KENYA", "INDIA")


@query("SELECT grade, " + ", ".join(f"count(DISTINCT standard_id) FILTER (domain = '{x}') \"{x}\"" for x in _DOMAINS) + " FROM fx_standards WHERE standard_id IN (SELECT standard_id FROM fx_alignments WHERE stale = 0) GROUP BY grade")
def a9_grade_domain_matrix(s: SparkSession, d: str) -> DataFrame:
    return audit.grade_domain_matrix(view(s, d, "fx_standards"), view(s, d, "fx_alignments"), list(_DOMAINS))


@query(f"SELECT level, count(*) standards FROM ({_LEVELS}) GROUP BY level")
def a10_gap_levels(s: SparkSession, d: str) -> DataFrame:
    return audit.level_totals(_levels(s, d))


@query(_LEVELS)
def a10_gap_analysis(s: SparkSession, d: str) -> DataFrame:
    return _levels(s, d)


@query(f"""SELECT source_id, count(DISTINCT c.chunk_id) chunks, count(DISTINCT standard_id) standards, count(standard_id) alignments, CAST(sum(CAST(round(alignment_score * 1e6) AS BIGINT)) AS DOUBLE) / count(alignment_score) / 1e6 avg_score, {_TIERS}, count(*) FILTER (alignment_score >= 0.8e0) strong
FROM (SELECT * FROM fx_chunks WHERE stale = 0) c LEFT JOIN (SELECT * FROM fx_alignments WHERE stale = 0) a ON a.chunk_id = c.chunk_id GROUP BY source_id""")
def a11_source_quality(s: SparkSession, d: str) -> DataFrame:
    return audit.source_quality(view(s, d, "fx_chunks"), view(s, d, "fx_alignments"))


@query("""SELECT standard_id, CAST(rank AS INTEGER) rank, chunk_id, alignment_score, title FROM (SELECT a.standard_id, a.chunk_id, a.alignment_score, c.title, row_number() OVER (PARTITION BY a.standard_id ORDER BY a.alignment_score DESC, a.chunk_id) rank
FROM fx_questions q JOIN fx_alignments a USING (standard_id) JOIN fx_chunks c USING (chunk_id) WHERE a.stale = 0 AND c.stale = 0) WHERE rank <= 3""")
def a12_checkpoint_probe(s: SparkSession, d: str) -> DataFrame:
    return audit.checkpoint_probe(view(s, d, "fx_questions"), view(s, d, "fx_alignments"), view(s, d, "fx_chunks"))


@query("SELECT count(*) alignments, count(DISTINCT chunk_id) chunks, count(DISTINCT standard_id) standards, count(*) FILTER (alignment_score >= 0.85e0) high FROM fx_alignments WHERE stale = 0")
def a12_checkpoint_totals(s: SparkSession, d: str) -> DataFrame:
    return audit.checkpoint_totals(view(s, d, "fx_alignments"))


@query("""WITH c AS (SELECT count(*) FILTER (stale = 0) live, count(*) total, count(*) FILTER (trim(coalesce(content, '')) = '') empty, count(*) FILTER (trim(coalesce(source_id, '')) = '') unattributed, count(*) FILTER (stale = 0 AND regexp_matches(lower(concat_ws(' ', title, content)), '(^|[^\\p{L}\\p{N}_])widget($|[^\\p{L}\\p{N}_])')) hits FROM fx_chunks),
a AS (SELECT count(DISTINCT standard_id) standards, count(*) FILTER (standard_id = 'STD.0.0.1') spot FROM fx_alignments WHERE stale = 0), e AS (SELECT count(*) embedded FROM fx_chunks WHERE stale = 0)
SELECT * FROM (SELECT 'live chunks' AS name, live AS value, live >= 100 AS ok, true AS hard FROM c UNION ALL SELECT 'empty content', empty, empty = 0, true FROM c UNION ALL SELECT 'missing attribution', unattributed, unattributed = 0, true FROM c UNION ALL SELECT 'keyword hits', hits, hits >= 10, true FROM c
UNION ALL SELECT 'embedded', embedded, embedded >= total, false FROM e, c UNION ALL SELECT 'distinct standards', standards, standards >= 200, false FROM a UNION ALL SELECT 'spot standard', spot, spot >= 2, false FROM a)""".replace("\\\\", "\\"))
def a13_acceptance(s: SparkSession, d: str) -> DataFrame:
    c = view(s, d, "fx_chunks").withColumn("attribution", F.col("source_id"))
    return audit.acceptance(c, c.where("stale = 0"), view(s, d, "fx_alignments"), min_chunks=100, word="widget", spot="STD.0.0.1")


_BENCH_TOP = """SELECT question_id, CAST(rank AS INTEGER) rank, chunk_id, title, alignment_score FROM (SELECT q.question_id, c.chunk_id, c.title, a.alignment_score, row_number() OVER (PARTITION BY q.question_id ORDER BY a.alignment_score DESC, a.chunk_id) rank
FROM fx_questions q JOIN fx_alignments a USING (standard_id) JOIN fx_chunks c USING (chunk_id) WHERE a.stale = 0 AND c.stale = 0{}) WHERE rank <= 5"""


def _bench_top(s: SparkSession, d: str, **filters: str) -> DataFrame:
    return audit.benchmark_top(view(s, d, "fx_questions"), view(s, d, "fx_alignments"), view(s, d, "fx_chunks"), **filters)


@query(_BENCH_TOP.format(""))
def a14_benchmark_content(s: SparkSession, d: str) -> DataFrame:
    return _bench_top(s, d)


@query(_BENCH_TOP.format(" AND c.source_id = 'src-1'"))
def a14_benchmark_source(s: SparkSession, d: str) -> DataFrame:
    return _bench_top(s, d, source="src-1")


@query(_BENCH_TOP.format(" AND c.grade_band = '6-8'"))
def a14_benchmark_grade(s: SparkSession, d: str) -> DataFrame:
    return _bench_top(s, d, grade_band="6-8")


@query(f"""{_BM25.replace('fx_docs', "(SELECT chunk_id, title, content, stale FROM fx_chunks)").replace('fx_queries', "(SELECT 0 query_id, 'widget' query_text)")} SELECT chunk_id, score, CAST(rank AS INTEGER) rank FROM k WHERE rank <= 50""")
def a14_benchmark_search(s: SparkSession, d: str) -> DataFrame:
    c = view(s, d, "fx_chunks")
    return search.keyword_hits(s.createDataFrame([(0, "widget")], "query_id int, query_text string"), c, search.filtered(c)).drop("query_id")


@query("SELECT standard_id, count(*) n FROM fx_alignments WHERE stale = 0 GROUP BY 1")
def a14_benchmark_counts(s: SparkSession, d: str) -> DataFrame:
    return audit.benchmark_counts(view(s, d, "fx_alignments"))


@query("SELECT source_id, count(DISTINCT chunk_id) FILTER (stale = 0) chunks FROM fx_chunks GROUP BY source_id")
def a14_benchmark_inventory(s: SparkSession, d: str) -> DataFrame:
    return audit.benchmark_inventory(view(s, d, "fx_chunks"), view(s, d, "fx_chunks"))


@query("""WITH n AS (SELECT source_id, count(*) chunks, """ + ", ".join(f"count(*) FILTER (content_type = '{t}') {t}" for t in S.CONTENT_TYPES) + """, count(*) FILTER (trim(coalesce(content, '')) = '') empty, count(*) FILTER (trim(coalesce(exam_series, '')) = '') unattributed, count(grade_band) graded, count(dok_level) with_dok, count(*) FILTER (trim(coalesce(exam_series, '')) <> '') with_answer, count(*) FILTER (std.n > 0) with_standard
FROM fx_chunks LEFT JOIN (SELECT chunk_id, count(*) n FROM fx_alignments GROUP BY 1) std USING (chunk_id) GROUP BY source_id)
SELECT *, concat_ws('; ', CASE WHEN empty > 0 THEN concat(empty, ' with empty content') END, CASE WHEN unattributed > 0 THEN concat(unattributed, ' with empty attribution') END) errors,
concat_ws('; ', CASE WHEN chunks > assessment AND exposition = 0 THEN 'no exposition chunks' END, CASE WHEN assessment > 0 AND chunks > with_standard THEN concat(chunks - with_standard, ' items without standard alignment') END) warnings, empty + unattributed = 0 ok FROM n""")
def p31_validation_report(s: SparkSession, d: str) -> DataFrame:
    n = view(s, d, "fx_alignments").groupBy("chunk_id").agg(F.count("*").alias("standards"))
    c = view(s, d, "fx_chunks").join(n, "chunk_id", "left").withColumn("attribution", F.col("exam_series")).withColumn("answer_key", F.col("exam_series"))
    return audit.validation_report(c)


# ---- merges ----


@query("SELECT * FROM fx_alignments")
def l5_tier_merge(s: SparkSession, d: str) -> DataFrame:
    return merge.merge_tiers(view(s, d, "fx_alignments_raw").drop("created_at"))


@query("""WITH n AS (SELECT std_num, concat('STD.', CAST(std_num AS VARCHAR)) id, standard_text || ' new' AS title, domain AS source_id FROM fx_standards WHERE std_num % 3 = 0 UNION ALL SELECT std_num, concat('STD.NEW.', CAST(std_num AS VARCHAR)), standard_text, domain FROM fx_standards WHERE std_num % 5 = 0),
o AS (SELECT concat('STD.', CAST(std_num AS VARCHAR)) id, standard_text AS title, 'kept' AS source_id FROM fx_standards)
SELECT coalesce(o.id, n.id) id, CASE WHEN n.id IS NOT NULL THEN n.title ELSE o.title END title, CASE WHEN o.id IS NULL THEN n.source_id ELSE o.source_id END source_id, CASE WHEN n.id IS NULL THEN 'kept' WHEN o.id IS NULL THEN 'added' ELSE 'updated' END _change FROM o FULL OUTER JOIN n ON o.id = n.id""")
def l1_catalogue_upsert(s: SparkSession, d: str) -> DataFrame:
    st = view(s, d, "fx_standards")
    old = st.selectExpr("concat('STD.', std_num) id", "standard_text as title", "'kept' as source_id")
    new = st.where("std_num % 3 = 0").selectExpr("concat('STD.', std_num) id", "concat(standard_text, ' new') title", "domain as source_id")
    return merge.upsert_catalogue(old, new.unionByName(st.where("std_num % 5 = 0").selectExpr("concat('STD.NEW.', std_num) id", "standard_text as title", "domain as source_id")))


@query("""WITH o AS (SELECT chunk_id, grade_band, content, '2020' AS created_at, stale FROM fx_chunks WHERE ord % 3 <> 0), n AS (SELECT chunk_id, CASE WHEN ord % 2 = 0 THEN grade_band END grade_band, title AS content FROM fx_chunks WHERE ord % 3 <> 1)
SELECT coalesce(o.chunk_id, n.chunk_id) chunk_id, CASE WHEN n.chunk_id IS NOT NULL THEN n.grade_band ELSE o.grade_band END grade_band, CASE WHEN n.chunk_id IS NOT NULL THEN n.content ELSE o.content END AS content, CASE WHEN n.chunk_id IS NOT NULL THEN sha256(n.content) END content_hash,
CASE WHEN n.chunk_id IS NOT NULL THEN '2026' END last_verified, CASE WHEN o.chunk_id IS NULL THEN '2026' ELSE o.created_at END created_at, CASE WHEN n.chunk_id IS NOT NULL THEN 0 ELSE o.stale END stale, CASE WHEN n.chunk_id IS NULL THEN 'kept' WHEN o.chunk_id IS NULL THEN 'added' ELSE 'updated' END _change FROM o FULL OUTER JOIN n ON o.chunk_id = n.chunk_id""")
def l2_chunk_upsert(s: SparkSession, d: str) -> DataFrame:
    c = view(s, d, "fx_chunks")
    old = c.where("ord % 3 <> 0").selectExpr("chunk_id", "grade_band", "content", "string(null) content_hash", "string(null) last_verified", "'2020' as created_at", "stale")
    return merge.upsert_chunks(old, c.where("ord % 3 <> 1").selectExpr("chunk_id", "if(ord % 2 = 0, grade_band, null) grade_band", "title as content"), now="2026")


@query("""WITH o AS (SELECT chunk_id, grade_band, title, content, '2020' AS created_at, stale FROM fx_chunks WHERE ord % 3 <> 0),
n AS (SELECT chunk_id, CASE WHEN ord % 7 = 0 THEN NULL ELSE grade_band END grade_band, title, CASE WHEN ord % 11 = 0 THEN title ELSE content END AS content FROM fx_chunks WHERE ord % 3 <> 1)
SELECT coalesce(o.chunk_id, n.chunk_id) chunk_id, CASE WHEN n.chunk_id IS NOT NULL THEN n.grade_band ELSE o.grade_band END grade_band, coalesce(n.content, o.content) AS content, sha256(coalesce(n.content, o.content)) content_hash,
CASE WHEN n.chunk_id IS NOT NULL THEN '2026' ELSE '2021' END last_verified, CASE WHEN o.chunk_id IS NULL THEN '2026' ELSE '2020' END created_at, CASE WHEN n.chunk_id IS NOT NULL THEN 0 ELSE o.stale END stale,
CASE WHEN n.chunk_id IS NULL THEN 'kept' WHEN o.chunk_id IS NULL THEN 'added' WHEN o.stale = 1 OR n.content <> o.content OR n.grade_band IS DISTINCT FROM o.grade_band THEN 'updated' ELSE 'same' END change FROM o FULL OUTER JOIN n ON o.chunk_id = n.chunk_id""")
def l2_delta_upsert(s: SparkSession, d: str) -> DataFrame:
    c, path = view(s, d, "fx_chunks"), shared_folder(s)
    layout.lay_out_chunks(c.where("ord % 3 <> 0").selectExpr("chunk_id", "grade_band", "title", "content", "'2020' as created_at", "'2021' as last_verified", "stale"), path)
    change = layout.load_changes(s, path, c.where("ord % 3 <> 1").selectExpr("chunk_id", "if(ord % 7 = 0, null, grade_band) grade_band", "title", "if(ord % 11 = 0, title, content) content"), now="2026")
    return layout.read_chunks(s, path).drop("title").join(change, "chunk_id", "left").withColumn("change", F.coalesce("change", F.lit("kept")))


@query("""WITH n AS (SELECT chunk_id, standard_id, round(alignment_score - 0.05e0, 4) s, alignment_score - 0.05e0 >= 0.78e0 f FROM fx_alignments WHERE align_id % 2 = 0 UNION ALL SELECT concat('new-', chunk_id), standard_id, alignment_score, alignment_score >= 0.78e0 FROM fx_alignments WHERE align_id % 11 = 0)
SELECT coalesce(o.chunk_id, n.chunk_id) chunk_id, coalesce(o.standard_id, n.standard_id) standard_id, CASE WHEN n.s IS NOT NULL AND coalesce(o.alignment_source, '') <> 'human' THEN n.s ELSE o.alignment_score END alignment_score, coalesce(o.alignment_source, 'embedding') alignment_source, o.coverage_notes,
CASE WHEN n.s IS NOT NULL AND coalesce(o.alignment_source, '') <> 'human' THEN 0 ELSE o.stale END stale, CASE WHEN n.s IS NOT NULL AND coalesce(o.alignment_source, '') <> 'human' THEN n.f END flagged FROM fx_alignments o FULL OUTER JOIN n ON o.chunk_id = n.chunk_id AND o.standard_id = n.standard_id""")
def l6_realign(s: SparkSession, d: str) -> DataFrame:
    a = view(s, d, "fx_alignments")
    n = a.where("align_id % 2 = 0").selectExpr("chunk_id", "standard_id", "round(alignment_score - 0.05D, 4) alignment_score", "alignment_score - 0.05D >= 0.78D flagged")
    return merge.realign(a, n.unionByName(a.where("align_id % 11 = 0").selectExpr("concat('new-', chunk_id) chunk_id", "standard_id", "alignment_score", "alignment_score >= 0.78D flagged")))


@query("""WITH v AS (SELECT chunk_id, standard_id, max(verdict) verdict, arg_max(note, concat(verdict, ' ', note)) note FROM fx_verdicts GROUP BY ALL)
SELECT a.chunk_id, a.standard_id, CASE WHEN verdict = 'verified' AND alignment_source NOT IN ('human', 'publisher_guide') THEN 'llm_verified' ELSE alignment_source END alignment_source,
CASE WHEN verdict = 'reject' OR (verdict = 'verified' AND alignment_source NOT IN ('human', 'publisher_guide')) THEN note ELSE coverage_notes END coverage_notes,
CASE WHEN verdict = 'reject' THEN 1 WHEN verdict = 'verified' AND alignment_source NOT IN ('human', 'publisher_guide') THEN 0 ELSE stale END stale FROM fx_alignments a LEFT JOIN v USING (chunk_id, standard_id)""")
def l7_apply_verdicts(s: SparkSession, d: str) -> DataFrame:
    return merge.apply_verdicts(view(s, d, "fx_alignments"), view(s, d, "fx_verdicts")).select("chunk_id", "standard_id", "alignment_source", "coverage_notes", "stale")


@query("""SELECT count(*) FILTER (a.chunk_id IS NOT NULL AND verdict = 'verified') verified, count(*) FILTER (a.chunk_id IS NOT NULL AND verdict = 'reject') rejected, count(*) FILTER (a.chunk_id IS NULL) missing FROM fx_verdicts v LEFT JOIN fx_alignments a USING (chunk_id, standard_id)""")
def l7_verdict_counts(s: SparkSession, d: str) -> DataFrame:
    return merge.verdict_counts(view(s, d, "fx_alignments"), view(s, d, "fx_verdicts"))


@query("SELECT chunk_id, part, CASE WHEN part = 'core' AND CAST(substr(book_id, 6) AS INTEGER) % 2 = 0 THEN 'ncsa' ELSE part END new_part FROM fx_chunks")
def l11_licence_split(s: SparkSession, d: str) -> DataFrame:
    c = view(s, d, "fx_chunks")
    books = c.select("book_id").distinct().selectExpr("book_id as id", "if(int(substr(book_id, 6)) % 2 = 0, 'CC BY-NC 4.0', 'CC BY 4.0') license")
    return merge.split_by_licence(books, c).select("chunk_id", "part", "new_part")


_SPLIT_TABLES = """WITH b AS (SELECT DISTINCT book_id, part, CASE WHEN CAST(substr(book_id, 6) AS INTEGER) % 3 = 0 THEN 'CC BY-NC 4.0' ELSE 'CC BY 4.0' END license FROM fx_chunks),
c AS (SELECT chunk_id, c.part, c.part = 'core' AND license LIKE '%NC%' goes FROM fx_chunks c JOIN b ON b.book_id = c.book_id AND b.part = c.part),
t AS (SELECT 'books' AS "table", book_id id, part, part = 'core' AND license LIKE '%NC%' goes FROM b UNION ALL SELECT 'chunks', chunk_id, part, goes FROM c
UNION ALL SELECT 'embeddings', chunk_id, part, goes FROM c JOIN embeddings ON chunk_id = concat('chunk-', CAST(vec_id AS VARCHAR)) UNION ALL SELECT 'alignments', concat(chunk_id, ' ', standard_id), part, goes FROM c JOIN fx_alignments USING (chunk_id))"""


def _split_tables(s: SparkSession, d: str) -> str:
    """The corpus laid out by licence partition in a new folder."""
    chunks, root = view(s, d, "fx_chunks"), shared_folder(s)
    books = chunks.select("book_id", "part").distinct().withColumn("license", F.expr("if(int(substr(book_id, 6)) % 3 = 0, 'CC BY-NC 4.0', 'CC BY 4.0')"))
    place = chunks.select("chunk_id", "part")
    vectors = view(s, d, "embeddings").select(F.concat(F.lit("chunk-"), "vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    layout.lay_out_parts({"books": books, "chunks": chunks, "embeddings": vectors.join(place, "chunk_id"), "alignments": view(s, d, "fx_alignments").join(place, "chunk_id")}, root)
    return root


@query(f"""{_SPLIT_TABLES} SELECT "table", id, CASE WHEN goes THEN 'ncsa' ELSE part END part FROM t""")
def l11_resplit_tables(s: SparkSession, d: str) -> DataFrame:
    root = _split_tables(s, d)
    layout.resplit(s, root)
    read = lambda name, key: layout.read_part_table(s, root, name).select(F.lit(name).alias("table"), key.alias("id"), "part")
    out = read("books", F.col("book_id")).unionByName(read("chunks", F.col("chunk_id"))).unionByName(read("embeddings", F.col("chunk_id")))
    return out.unionByName(read("alignments", F.concat_ws(" ", "chunk_id", "standard_id")))


@query(f"""{_SPLIT_TABLES} SELECT "table", p.part, count(*) FILTER (t.part = p.part) AS before, CASE p.part WHEN 'core' THEN -count(*) FILTER (goes) WHEN 'ncsa' THEN count(*) FILTER (goes) ELSE 0 END moved,
count(*) FILTER (CASE WHEN goes THEN 'ncsa' ELSE t.part END = p.part) AS after, 0 AS orphans, true AS ok FROM t CROSS JOIN (SELECT DISTINCT part FROM fx_chunks) p GROUP BY "table", p.part""")
def l11_resplit_report(s: SparkSession, d: str) -> DataFrame:
    return layout.resplit(s, _split_tables(s, d))


@query("""SELECT 'duplicate chunk' AS "check", count(*) violations FROM (SELECT 1 FROM fx_chunks GROUP BY part, chunk_id HAVING count(*) > 1) UNION ALL SELECT 'duplicate alignment', count(*) FROM (SELECT 1 FROM fx_alignments_raw GROUP BY chunk_id, standard_id HAVING count(*) > 1)
UNION ALL SELECT 'alignment without chunk', count(*) FROM fx_alignments_raw WHERE chunk_id NOT IN (SELECT chunk_id FROM fx_chunks) UNION ALL SELECT 'alignment without standard', count(*) FROM fx_alignments_raw WHERE standard_id NOT IN (SELECT standard_id FROM fx_standards)
UNION ALL SELECT 'content type', 0 UNION ALL SELECT 'tier', 0 UNION ALL SELECT 'score', count(*) FROM fx_alignments_raw WHERE NOT (alignment_score BETWEEN 0 AND 1)""")
def l12_integrity(s: SparkSession, d: str) -> DataFrame:
    return merge.integrity(view(s, d, "fx_chunks"), view(s, d, "fx_alignments_raw"), view(s, d, "fx_standards"), S.CONTENT_TYPES, tuple(S.TIERS))


@query("""SELECT coalesce(o.chunk_id, n.chunk_id) chunk_id, CASE WHEN o.chunk_id IS NULL THEN 'new' WHEN n.chunk_id IS NULL THEN 'gone' WHEN o.h = n.h THEN 'same' ELSE 'changed' END AS change
FROM (SELECT chunk_id, sha256(content) h FROM fx_docs WHERE ord % 7 <> 0) o FULL OUTER JOIN (SELECT chunk_id, sha256(CASE WHEN ord % 5 = 0 THEN title ELSE content END) h FROM fx_docs WHERE ord % 9 <> 0) n ON o.chunk_id = n.chunk_id""")
def l13_changes_by_hash(s: SparkSession, d: str) -> DataFrame:
    x = view(s, d, "fx_docs")
    new = x.where("ord % 9 <> 0").select("chunk_id", C.content_hash(F.expr("if(ord % 5 = 0, title, content)")).alias("content_hash"))
    return merge.changes_by_hash(x.where("ord % 7 <> 0").select("chunk_id", C.content_hash(F.col("content")).alias("content_hash")), new)


# ---- alignment ----


def _vector_chunks(s: SparkSession, d: str) -> tuple[DataFrame, ...]:
    v = view(s, d, "fx_vec_chunks").selectExpr("concat('vec-', doc_id) chunk_id", "embedding as vector", "doc_id")
    bands = "case doc_id % 5 when 0 then 'K-5' when 1 then '6-8' when 2 then '9-12' when 3 then 'college' end"
    c = v.selectExpr("chunk_id", "concat('Title ', doc_id, if(doc_id % 13 = 1, ' Self Check', '')) title", "if(doc_id % 2 = 1, 'exercise_set', 'exposition') content_type", f"{bands} grade_band", "'b' as book_id", "0 as stale")
    sv = view(s, d, "fx_vec_standards").selectExpr("concat('S', std_num) standard_id", "embedding as vector", "std_num")
    st = sv.selectExpr("standard_id", "'ccss' as system", "case (std_num div 10) % 11 when 0 then 'K' when 9 then 'HS' when 10 then null else string((std_num div 10) % 11) end grade")
    return c, v.select("chunk_id", "vector"), st, sv.select("standard_id", "vector")


_VEC = f"""WITH c AS (SELECT concat('vec-', doc_id::VARCHAR) chunk_id, embedding::DOUBLE[] v, CASE doc_id % 5 WHEN 0 THEN 'K-5' WHEN 1 THEN '6-8' WHEN 2 THEN '9-12' WHEN 3 THEN 'college' END grade_band FROM fx_vec_chunks WHERE NOT (doc_id % 13 = 1 AND doc_id % 2 = 1)),
s AS (SELECT concat('S', std_num::VARCHAR) standard_id, embedding::DOUBLE[] v, CASE (std_num // 10) % 11 WHEN 0 THEN 'K' WHEN 9 THEN 'HS' WHEN 10 THEN NULL ELSE ((std_num // 10) % 11)::VARCHAR END grade FROM fx_vec_standards),
x AS (SELECT chunk_id, standard_id, list_cosine_similarity(c.v, s.v) - 0.02e0 * coalesce(greatest({_LO} - {_GRADE}, {_GRADE} - {_HI}, 0), 0) raw FROM c, s),
r AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY raw DESC, standard_id) n FROM x WHERE raw >= 0.20e0), f AS (SELECT chunk_id, standard_id, round(raw, 4) alignment_score, raw >= 0.33e0 flagged FROM r WHERE n <= 5)"""


@query(f"{_VEC} SELECT * FROM f")
def e5_cosine_alignment(s: SparkSession, d: str) -> DataFrame:
    return align.align(*_vector_chunks(s, d), threshold=0.20, flag=0.33)


@query(f"{_VEC} SELECT count(DISTINCT chunk_id) chunks, count(*) alignments, count(*) FILTER (flagged) to_annotate, (SELECT count(*) FROM fx_vec_chunks WHERE doc_id % 13 = 1 AND doc_id % 2 = 1) skipped FROM f")
def e10_alignment_summary(s: SparkSession, d: str) -> DataFrame:
    parts = _vector_chunks(s, d)
    return align.alignment_summary(parts[0], align.align(*parts, threshold=0.20, flag=0.33))


@query(f"SELECT chunk_id, standard_id, CAST(coalesce(greatest({_LO} - {_GRADE}, {_GRADE} - {_HI}, 0), 0) AS INTEGER) distance FROM fx_alignments JOIN fx_chunks USING (chunk_id) JOIN fx_standards USING (standard_id)".replace("coalesce(greatest", "CASE WHEN grade_band IS NULL OR " + _GRADE + " IS NULL THEN 0 ELSE (greatest").replace(", 0), 0) AS INTEGER", ", 0)) END AS INTEGER"))
def e6_grade_distance(s: SparkSession, d: str) -> DataFrame:
    j = view(s, d, "fx_alignments").join(view(s, d, "fx_chunks").select("chunk_id", "grade_band"), "chunk_id").join(view(s, d, "fx_standards").select("standard_id", "grade"), "standard_id")
    return j.select("chunk_id", "standard_id", S.grade_distance(F.col("grade_band"), F.col("grade")).alias("distance"))


@query("SELECT chunk_id, substr(concat(coalesce(title, ''), chr(10), coalesce(content, '')), 1, 2000) AS text FROM fx_docs WHERE stale = 0 AND ord % 3 <> 0")
def e1_pending_inputs(s: SparkSession, d: str) -> DataFrame:
    x = view(s, d, "fx_docs")
    return align.pending(x, x.where("ord % 3 = 0")).select("chunk_id", align.embed_input(F.col("title"), F.col("content")).alias("text"))


@query(r"SELECT chunk_id, 'hashing-64' AS model, 64 AS dimensions, true AS filled FROM fx_docs WHERE stale = 0 AND ord % 3 <> 0 AND regexp_matches(content, '\S')")
def e3_embed_pending(s: SparkSession, d: str) -> DataFrame:
    x = view(s, d, "fx_docs")
    out = align.embed_pending(x, x.where("ord % 3 = 0"), align.hashing_embedder(), model="hashing-64")
    return out.select("chunk_id", "model", "dimensions", ((F.size("vector") == 64) & F.exists("vector", lambda v: v != 0)).alias("filled"))


# ---- review ----


def _flagged(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "fx_alignments").withColumn("flagged_for_review", (F.col("alignment_score") >= 0.78).cast("int"))


@query("SELECT a.align_id, a.chunk_id, a.standard_id, a.alignment_score FROM fx_alignments a JOIN fx_chunks c USING (chunk_id) WHERE c.stale = 0 AND alignment_score >= 0.78e0 AND alignment_source = 'embedding'")
def v1_pending_verification(s: SparkSession, d: str) -> DataFrame:
    return review.pending_verification(_flagged(s, d), view(s, d, "fx_chunks")).select("align_id", "chunk_id", "standard_id", "alignment_score")


@query("SELECT align_id, chunk_id, standard_id FROM fx_alignments JOIN fx_chunks USING (chunk_id) WHERE alignment_score >= 0.78e0 AND coverage_notes IS NULL AND alignment_source IN ('embedding', 'llm_verified')")
def v2_pending_annotation(s: SparkSession, d: str) -> DataFrame:
    return review.pending_annotation(_flagged(s, d), view(s, d, "fx_chunks")).select("align_id", "chunk_id", "standard_id")


@query("SELECT align_id, chunk_id, standard_id FROM fx_alignments a JOIN fx_chunks c USING (chunk_id) WHERE a.stale = 0 AND c.stale = 0 AND coalesce(coverage_notes, '') = '' AND (alignment_source IN ('publisher_guide', 'human', 'llm_verified') OR (alignment_source = 'embedding' AND alignment_score >= 0.78e0))")
def v3_strict_annotation(s: SparkSession, d: str) -> DataFrame:
    return review.strict_annotation(view(s, d, "fx_alignments"), view(s, d, "fx_chunks")).select("align_id", "chunk_id", "standard_id")


@query("""SELECT standard_id, standard_text, coalesce(subs, '(none)') sub_standards FROM (SELECT concat('STD.', CAST(r_regionkey AS VARCHAR)) standard_id, r_name AS standard_text, r_regionkey FROM region UNION ALL SELECT 'STD.none', 'nothing', -1)
LEFT JOIN (SELECT n_regionkey r_regionkey, string_agg(concat(CAST(n_nationkey AS VARCHAR), ': ', n_name), '; ' ORDER BY n_nationkey) subs FROM nation GROUP BY n_regionkey) USING (r_regionkey)""")
def v4_standard_context(s: SparkSession, d: str) -> DataFrame:
    r = view(s, d, "region").selectExpr("concat('STD.', r_regionkey) standard_id", "r_name as standard_text")
    r = r.union(r.limit(1).selectExpr("'STD.none'", "'nothing'"))
    return review.standard_context(r, view(s, d, "nation").selectExpr("concat('STD.', n_regionkey) parent_id", "concat('STD.', n_regionkey, '.', n_nationkey) id", "n_nationkey as position", "n_name as text"))


@query("""SELECT align_id, chunk_id, standard_id, CASE align_id % 4 WHEN 0 THEN 'llm_verified' ELSE alignment_source END alignment_source, CASE align_id % 4 WHEN 0 THEN 0.9e0 ELSE alignment_score END alignment_score,
CASE WHEN align_id % 4 = 1 THEN 0 ELSE CAST(alignment_score >= 0.78e0 AS INTEGER) END flagged_for_review, CASE align_id % 4 WHEN 0 THEN 'promoted' WHEN 1 THEN 'rejected' ELSE 'skipped' END outcome FROM fx_alignments WHERE align_id IN (SELECT align_id FROM fx_alignments GROUP BY align_id HAVING count(*) = 1)""")
def v7_apply_answers(s: SparkSession, d: str) -> DataFrame:
    a = _flagged(s, d)
    a = a.join(a.groupBy("align_id").count().where("count = 1").select("align_id"), "align_id")
    answers = a.selectExpr("align_id", "case align_id % 4 when 0 then ' yes, it does' when 1 then 'No.' when 2 then 'unsure' end answer")
    return review.apply_answers(a, answers).select("align_id", "chunk_id", "standard_id", "alignment_source", "alignment_score", "flagged_for_review", "outcome")


@query("""WITH j AS (SELECT a.chunk_id, a.standard_id, a.alignment_score old, c.content_type, c.title, CASE WHEN grade_band IS NULL THEN 6 WHEN contains(grade_band, 'K') THEN 0 WHEN contains(grade_band, '1') AND NOT contains(grade_band, '9') AND NOT contains(grade_band, '10') THEN 1 ELSE coalesce(TRY_CAST(regexp_extract(grade_band, '([0-9]+)', 1) AS INTEGER), 6) END lvl,
CASE WHEN len(string_split(a.standard_id, '.')) >= 4 THEN TRY_CAST(string_split(a.standard_id, '.')[3] AS INTEGER) END std, s.standard_id IS NULL unknown, string_split(a.standard_id, '.')[4] concept FROM fx_alignments a JOIN fx_chunks c USING (chunk_id) LEFT JOIN (SELECT standard_id FROM fx_standards WHERE system = 'ccss') s USING (standard_id)
WHERE a.stale = 0 AND c.stale = 0 AND alignment_source = 'embedding' AND alignment_score BETWEEN 0.70e0 AND 0.78e0),
d AS (SELECT *, content_type = 'exercise_set' AND old < 0.75e0 weak FROM j), k AS (SELECT *, round(least(0.95e0, greatest(0.65e0, old + CASE WHEN std IS NULL THEN 0e0 WHEN abs(lvl - std) <= 1 THEN 0.02e0 WHEN abs(lvl - std) = 2 THEN -0.05e0 ELSE -0.10e0 END
+ CASE WHEN content_type IN ('worked_example', 'exposition', 'assessment') THEN 0.01e0 WHEN weak THEN -0.08e0 WHEN content_type = 'exercise_set' THEN -0.02e0 WHEN content_type = 'summary' THEN -0.01e0 ELSE 0e0 END + CASE WHEN unknown THEN -0.10e0 ELSE 0e0 END + CASE WHEN contains(lower(title), concept) THEN 0.03e0 ELSE 0e0 END)), 6) s FROM d)
SELECT chunk_id, standard_id, old old_score, s alignment_score, CASE WHEN NOT coalesce(abs(lvl - std) > 1, false) AND NOT weak AND NOT unknown THEN 'Consistent alignment' ELSE concat_ws(' + ', CASE WHEN abs(lvl - std) > 1 THEN 'Grade mismatch' END, CASE WHEN weak THEN 'Weak content type' END, CASE WHEN unknown THEN 'Unknown standard' END) END reason,
s >= 0.70e0 is_aligned, 'llm_verified' alignment_source FROM k""")
def v8_heuristic_verification(s: SparkSession, d: str) -> DataFrame:
    return review.heuristic_verification(view(s, d, "fx_alignments"), view(s, d, "fx_chunks"), view(s, d, "fx_standards"))


@query("""SELECT chunk_id, standard_id, CASE content_type WHEN 'worked_example' THEN concat('Worked example demonstrating ', w, '. Provides step-by-step solution approach for this standard.') WHEN 'exposition' THEN concat('Teaches ', CASE WHEN contains(t, ':') THEN w ELSE 'this standard' END, ' through explanation and examples. Grade level: ', coalesce(grade_band, 'K-12'), '.')
WHEN 'exercise_set' THEN concat('Provides exercises for ', w, '. Reinforces procedural fluency and conceptual understanding.') WHEN 'summary' THEN concat('Summary of ', w, '. Consolidates key ideas and procedures for this standard.') ELSE concat('Assessment item assessing ', w, '. Evaluates student mastery of this standard.') END note FROM (
SELECT a.chunk_id, a.standard_id, c.content_type, c.grade_band, t, CASE WHEN contains(t, ':') THEN trim(string_split(t, ':')[1]) ELSE string_split(a.standard_id, '.')[-1] END w FROM fx_alignments a JOIN fx_chunks c USING (chunk_id) JOIN (SELECT standard_id, CASE WHEN std_num % 2 = 0 THEN concat(standard_text, ' : more') ELSE standard_text END t FROM fx_standards) s USING (standard_id)
WHERE a.stale = 0 AND NOT coalesce(length(coverage_notes) > 30, false) AND (alignment_source IN ('human', 'publisher_guide') OR (alignment_source = 'llm_verified' AND alignment_score >= 0.75e0) OR (alignment_source = 'embedding' AND alignment_score >= 0.78e0)))""")
def v10_template_notes(s: SparkSession, d: str) -> DataFrame:
    st = view(s, d, "fx_standards").withColumn("standard_text", F.expr("if(std_num % 2 = 0, concat(standard_text, ' : more'), standard_text)"))
    return review.template_notes(view(s, d, "fx_alignments"), view(s, d, "fx_chunks"), st)


@query("SELECT part, count(*) FILTER (alignment_source = 'embedding' AND alignment_score >= 0.65e0 AND alignment_score < 0.78e0) \"left\" FROM fx_alignments JOIN fx_chunks USING (chunk_id) GROUP BY part")
def v12_flagged_left(s: SparkSession, d: str) -> DataFrame:
    a = view(s, d, "fx_alignments").withColumn("flagged_for_review", F.lit(0))
    return review.flagged_left(review.flag_band(a), view(s, d, "fx_chunks"))


@query("""SELECT standard_id, standard_text FROM fx_standards WHERE standard_id IN (SELECT standard_id FROM fx_alignments WHERE stale = 0) AND standard_id NOT IN (SELECT a.standard_id FROM fx_alignments a JOIN fx_chunks c USING (chunk_id) WHERE a.stale = 0 AND c.stale = 0 AND c.exam_series = 'AP Precalculus')""")
def v13_generation_candidates(s: SparkSession, d: str) -> DataFrame:
    return review.generation_candidates(view(s, d, "fx_alignments"), view(s, d, "fx_chunks"), view(s, d, "fx_standards"), "AP Precalculus")


# ---- parsing and evaluation ----


@query(r"SELECT doc_id, CASE WHEN trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) END::INTEGER word_count, sha256(text) content_hash FROM documents")
def p30_counts_and_hashes(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "documents").select("doc_id", C.words(F.col("text")).cast("int").alias("word_count"), C.content_hash(F.col("text")).alias("content_hash"))


@query(r"""SELECT conv_id, turn, CASE WHEN first IN ('A', 'B', 'TIE') THEN first WHEN regexp_matches(t, '\bTIE\b') THEN 'TIE' ELSE nullif(regexp_extract(t, '\b([AB])\b', 1), '') END pref FROM
(SELECT conv_id, turn, t, regexp_extract(t, '[A-Z]+') AS first FROM (SELECT conv_id, turn, upper(trim(coalesce(text, ''))) t FROM conversations))""")
def b3_preferences(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "conversations").select("conv_id", "turn", evals.parse_preference(F.col("text")).alias("pref"))


@query("""WITH c AS (SELECT 'content' AS "left", CASE WHEN doc_id % 2 = 0 THEN 'standards' ELSE 'nothing' END AS "right", CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN 'tie' WHEN quality = 1 THEN 'content' WHEN doc_id % 2 = 0 THEN 'standards' ELSE 'nothing' END winner FROM labels)
SELECT "left", "right", count(*) FILTER (winner = "left") wins, count(*) FILTER (winner = "right") losses, count(*) FILTER (winner = 'tie') ties, count(*) FILTER (winner IS NULL) unparsed, round(count(*) FILTER (winner = "left") / (count(*) FILTER (winner = "left") + count(*) FILTER (winner = "right"))::DOUBLE, 3) win_rate,
round(count(*) FILTER (winner = "left") / (count(*) FILTER (winner = "left") + count(*) FILTER (winner = "right"))::DOUBLE, 3) >= 0.6e0 target_met FROM c GROUP BY "left", "right" """)
def b5_win_rates(s: SparkSession, d: str) -> DataFrame:
    right = "if(doc_id % 2 = 0, 'standards', 'nothing')"
    c = view(s, d, "labels").selectExpr("'content' as left", f"{right} as right", f"case when doc_id % 11 = 0 then null when doc_id % 7 = 0 then 'tie' when quality = 1 then 'content' else {right} end winner")
    return evals.win_rates(c)


@query("SELECT count(*) n, count(*) FILTER (quality = 1 AND doc_id % 3 > 0) passed, count(*) FILTER (quality = 1 AND doc_id % 3 = 0) \"partial\", count(*) FILTER (quality = 0 AND doc_id % 2 = 0) failed, count(*) FILTER (quality = 0 AND doc_id % 2 = 1) errors, round(count(*) FILTER (quality = 1 AND doc_id % 3 > 0) / count(*)::DOUBLE, 3) pass_rate FROM labels")
def b7_tally(s: SparkSession, d: str) -> DataFrame:
    text = F.expr("case when quality = 1 and doc_id % 3 > 0 then 'Yes.' when quality = 1 then 'partial, mostly' when doc_id % 2 = 0 then ' no' else '?' end")
    return evals.tally(view(s, d, "labels").select(evals.parse_grade(text).alias("grade")))


@query("""SELECT coalesce(o.standard_id, n.standard_id) standard_id, coalesce(o.exam_series, n.exam_series) exam_series, CASE WHEN n.exam_series IS NOT NULL THEN n.skill_domain ELSE o.skill_domain END skill_domain, CASE WHEN n.exam_series IS NULL THEN 'kept' WHEN o.exam_series IS NULL THEN 'added' ELSE 'updated' END _change
FROM fx_crosswalk o FULL OUTER JOIN (SELECT standard_id, 'SAT' exam_series, lower(skill_domain) skill_domain FROM fx_crosswalk) n ON o.standard_id = n.standard_id AND o.exam_series = n.exam_series""")
def l8_crosswalk_upsert(s: SparkSession, d: str) -> DataFrame:
    w = view(s, d, "fx_crosswalk")
    return merge.upsert_crosswalk(w, w.selectExpr("standard_id", "'SAT' as exam_series", "lower(skill_domain) skill_domain"))


@query("""WITH i AS (SELECT standard_id, concat('Question on ', standard_text) question, CASE std_num % 3 WHEN 0 THEN 'SAT' WHEN 1 THEN 'NAEP Grade 8' ELSE 'Smarter Balanced 7' END exam_series FROM fx_standards),
c AS (SELECT *, concat(CASE exam_series WHEN 'SAT' THEN 'sat' WHEN 'NAEP Grade 8' THEN 'naep' ELSE 'smarter-balanced' END, '-', substr(sha256(concat('st:', standard_id, ':', substr(question, 1, 80))), 1, 12)) chunk_id FROM i)
SELECT chunk_id, standard_id, 0.95e0 alignment_score, 'publisher_guide' alignment_source FROM c""")
def l9_insert_items(s: SparkSession, d: str) -> DataFrame:
    items = view(s, d, "fx_standards").selectExpr("'st' as style", "standard_id", "case std_num % 3 when 0 then 'SAT' when 1 then 'NAEP Grade 8' else 'Smarter Balanced 7' end exam_series", "'mc' as item_type", "1 as dok_level", "0.5D as difficulty", "'6-8' as grade_band", "concat('Question on ', standard_text) question", "'A' as answer_key")
    return merge.insert_items(view(s, d, "fx_chunks"), items)[1]


@query("SELECT chunk_id, coalesce(CASE WHEN ord % 2 = 0 THEN grade_band END, CASE WHEN CAST(substr(book_id, 6) AS INTEGER) % 3 > 0 THEN '9-12' END) grade_band FROM fx_chunks")
def l3_inherited_grades(s: SparkSession, d: str) -> DataFrame:
    c = view(s, d, "fx_chunks").selectExpr("chunk_id", "book_id", "if(ord % 2 = 0, grade_band, null) grade_band")
    books = c.select("book_id").distinct().selectExpr("book_id as id", "if(int(substr(book_id, 6)) % 3 > 0, '9-12', null) grade_band")
    return merge.inherit_grades(c, books).select("chunk_id", "grade_band")


@query(f"""{_BM25.replace("stale = 0 GROUP", "stale = 0 AND chunk_id IN (SELECT chunk_id FROM fx_docs WHERE content_type = 'summary' AND grade_band = '6-8' AND book_lang = 'en') GROUP")} SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) rank FROM k WHERE rank <= 5""")
def q14_filtered_search(s: SparkSession, d: str) -> DataFrame:
    docs = view(s, d, "fx_docs")
    ok = search.filtered(docs, content_type="summary", grade_band="6-8", aligned_to=docs.where("book_lang = 'en'"))
    return search.keyword_hits(view(s, d, "fx_queries"), docs, ok, limit=5)


_TAGS = "concat(CAST(o_orderkey % 10 AS VARCHAR), '.', CASE o_orderkey % 3 WHEN 0 THEN 'NF' WHEN 1 THEN 'RP' ELSE 'G' END, CASE WHEN o_orderkey % 4 > 0 THEN '.A' ELSE '' END, '.', CAST(o_orderkey % 7 AS VARCHAR), CASE WHEN o_orderkey % 5 = 0 THEN '.b' ELSE '' END)"


@query(f"""WITH t AS (SELECT o_orderkey, {_TAGS} tag FROM orders), p AS (SELECT *, string_split(tag, '.') p FROM t), q AS (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN list_slice(p, 1, len(p) - 1) ELSE p END low, CASE WHEN o_orderkey % 4 > 0 THEN list_concat(list_slice(p, 1, 2), list_slice(p, 4, len(p))) ELSE p END cut FROM p)
SELECT o_orderkey, tag, CASE WHEN o_orderkey % 10 <= 5 THEN CASE WHEN len(low) >= 3 THEN concat('CCSS.MATH.', array_to_string(low, '.')) END
ELSE CASE WHEN len(CASE WHEN o_orderkey % 5 = 0 THEN list_slice(cut, 1, len(cut) - 1) ELSE cut END) >= 3 THEN concat('CCSS.MATH.', array_to_string(CASE WHEN o_orderkey % 5 = 0 THEN list_slice(cut, 1, len(cut) - 1) ELSE cut END, '.')) END END lesson_id,
CASE WHEN o_orderkey % 10 > 5 AND o_orderkey % 4 > 0 THEN concat('CCSS.MATH.', array_to_string(cut, '.')) ELSE concat('CCSS.MATH.', tag) END item_id FROM q""")
def p11_standard_ids(s: SparkSession, d: str) -> DataFrame:
    tags = view(s, d, "orders").selectExpr("o_orderkey", f"{_TAGS.replace('VARCHAR', 'STRING')} tag")
    return tags.select("o_orderkey", "tag", S.id_from_lesson_tag(F.col("tag")).alias("lesson_id"), S.id_from_item_tag(F.col("tag")).alias("item_id"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'K-5' WHEN 1 THEN CASE WHEN c_custkey % 12 <= 5 THEN 'K-5' WHEN c_custkey % 12 <= 8 THEN '6-8' ELSE '9-12' END WHEN 2 THEN '9-12' END band FROM customer""")
def p13_grade_bands(s: SparkSession, d: str) -> DataFrame:
    title = F.expr("case c_custkey % 4 when 0 then 'Kindergarten math' when 1 then concat(c_custkey % 12, 'th grade') when 2 then 'Pre-algebra' else 'Arithmetic' end")
    return view(s, d, "customer").select("c_custkey", C.grade_band(title).alias("band"))


@query("""SELECT align_id, chunk_id, standard_id, round(CASE align_id % 5 WHEN 0 THEN least(0.95e0, alignment_score + 0.05e0) WHEN 1 THEN least(0.65e0, alignment_score - 0.10e0) ELSE alignment_score END, 6) alignment_score, CASE WHEN align_id % 5 <= 1 THEN 'llm_verified' ELSE alignment_source END alignment_source,
CASE align_id % 5 WHEN 0 THEN 'aligned' WHEN 1 THEN 'not_aligned' WHEN 2 THEN 'error' ELSE 'unasked' END outcome FROM fx_alignments WHERE align_id IN (SELECT align_id FROM fx_alignments GROUP BY align_id HAVING count(*) = 1)""")
def v9_rescored(s: SparkSession, d: str) -> DataFrame:
    a = view(s, d, "fx_alignments")
    a = a.join(a.groupBy("align_id").count().where("count = 1").select("align_id"), "align_id")
    answers = a.where("align_id % 5 <= 2").selectExpr("align_id", """case align_id % 5 when 0 then '{"aligned": true, "reason": "x"}' when 1 then '{"aligned": false}' else 'sorry' end answer""")
    return review.rescore(a, answers).select("align_id", "chunk_id", "standard_id", "alignment_score", "alignment_source", "outcome")


@query("""SELECT d.chunk_id, concat('Does this content teach the standard? Answer YES or NO.', chr(10), 'Standard ', s.standard_id, ': ', s.standard_text, chr(10), 'Parts: (none)', chr(10), 'Title: ', d.title, chr(10), substr(d.content, 1, 1500)) prompt FROM fx_docs d JOIN fx_standards s ON s.std_num = 1 + d.ord % (SELECT count(*) FROM fx_standards)""")
def v5_prompts(s: SparkSession, d: str) -> DataFrame:
    st = view(s, d, "fx_standards")
    j = view(s, d, "fx_docs").crossJoin(st.agg(F.count("*").alias("n"))).join(st, F.expr("std_num = 1 + ord % n"))
    return j.select("chunk_id", review.verify_prompt(F.col("standard_id"), F.col("standard_text"), F.lit("(none)"), F.col("title"), F.col("content")).alias("prompt"))


@query("""SELECT new_part AS part, CAST(sum(b) AS BIGINT) AS before, CAST(sum(a) AS BIGINT) AS after FROM (SELECT part new_part, 1 b, 0 a FROM fx_chunks UNION ALL SELECT CASE WHEN part = 'core' AND CAST(substr(book_id, 6) AS INTEGER) % 2 = 0 THEN 'ncsa' ELSE part END, 0, 1 FROM fx_chunks) GROUP BY 1""")
def l11_split_counts(s: SparkSession, d: str) -> DataFrame:
    c = view(s, d, "fx_chunks")
    books = c.select("book_id").distinct().selectExpr("book_id as id", "if(int(substr(book_id, 6)) % 2 = 0, 'CC BY-NC 4.0', 'CC BY 4.0') license")
    return merge.split_counts(merge.split_by_licence(books, c))
