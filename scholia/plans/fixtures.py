"""Views over the given tables that stand for the corpus in queries and in the SQL that checks them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from scholia.operators.merge import merge_tiers

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Each may read the tables and the views before it; both engines read them alike.
VIEWS = {
    "fx_standards": """
SELECT concat('STD.', CAST(n.n_regionkey AS STRING), '.', CAST(s.s_nationkey AS STRING), '.', CAST(s.s_suppkey AS STRING)) AS standard_id,
       CASE WHEN s.s_suppkey % 5 = 4 THEN 'ap-bio' ELSE 'ccss' END AS system,
       n.n_name AS domain,
       concat('C', CAST(s.s_suppkey % 3 AS STRING)) AS cluster,
       CASE WHEN s.s_suppkey % 11 = 0 THEN 'K' WHEN s.s_suppkey % 11 = 9 THEN 'HS'
            WHEN s.s_suppkey % 11 = 10 THEN NULL ELSE CAST(s.s_suppkey % 11 AS STRING) END AS grade,
       s.s_name AS standard_text, s.s_suppkey AS std_num
FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey""",
    "fx_catalogue": """
SELECT standard_id, domain, grade FROM fx_standards
UNION ALL
SELECT concat('STD.', CAST(n_regionkey AS STRING), '.', CAST(n_nationkey AS STRING)), n_name, NULL FROM nation""",
    "fx_chunks": """
SELECT concat('chunk-', CAST(p_partkey AS STRING)) AS chunk_id,
       concat('book-', substr(p_brand, 7)) AS book_id,
       concat('src-', CAST(CAST(substr(p_brand, 7) AS INT) % 7 AS STRING)) AS source_id,
       CASE p_partkey % 4 WHEN 0 THEN 'core' WHEN 1 THEN 'ncsa' WHEN 2 THEN 'ap' ELSE 'state' END AS part,
       p_name AS title, concat(p_name, ' ', p_type) AS content,
       CASE p_size % 5 WHEN 0 THEN 'exposition' WHEN 1 THEN 'worked_example' WHEN 2 THEN 'exercise_set'
            WHEN 3 THEN 'summary' ELSE 'assessment' END AS content_type,
       CASE p_size % 6 WHEN 0 THEN 'K-5' WHEN 1 THEN '6-8' WHEN 2 THEN '9-12' WHEN 3 THEN 'college'
            WHEN 4 THEN 'K-8' ELSE NULL END AS grade_band,
       CASE WHEN p_size % 5 = 4 THEN CAST(1 + p_partkey % 4 AS INT) ELSE NULL END AS dok_level,
       CASE WHEN p_size % 5 = 4 AND p_partkey % 5 = 0 THEN 'SAT' WHEN p_size % 5 = 4 AND p_partkey % 5 = 1 THEN 'ACT'
            WHEN p_size % 5 = 4 AND p_partkey % 5 = 2 THEN 'NAEP Grade 8'
            WHEN p_size % 5 = 4 AND p_partkey % 500 = 3 THEN 'AP Precalculus' ELSE NULL END AS exam_series,
       CASE WHEN p_partkey % 13 = 0 THEN 1 ELSE 0 END AS stale,
       p_partkey AS ord
FROM part""",
    "fx_alignments_raw": """
SELECT concat('chunk-', CAST(l.l_partkey AS STRING)) AS chunk_id, s.standard_id, s.system AS standard_system,
       round(0.6e0 + CAST(3 * CAST(round(l.l_discount * 1e2) AS INT) + CAST(round(l.l_tax * 1e2) AS INT) AS DOUBLE) / 1e2
             + l.l_quantity / 1e4, 4) AS alignment_score,
       CASE WHEN l.l_linenumber = 1 AND l.l_returnflag = 'A' THEN 'human'
            WHEN l.l_linenumber = 1 THEN 'publisher_guide'
            WHEN l.l_returnflag = 'R' THEN 'llm_verified' ELSE 'embedding' END AS alignment_source,
       CASE WHEN l.l_linestatus = 'F' THEN concat('note ', CAST(l.l_orderkey AS STRING)) ELSE NULL END AS coverage_notes,
       CASE WHEN l.l_orderkey % 17 = 0 THEN 1 ELSE 0 END AS stale,
       l.l_orderkey * 10 + l.l_linenumber AS align_id, l.l_shipdate AS created_at
FROM lineitem l JOIN fx_standards s ON s.std_num = l.l_suppkey""",
    "fx_alignments": """
SELECT chunk_id, standard_id, standard_system, alignment_score, alignment_source, coverage_notes, stale, align_id FROM (
  SELECT *, row_number() OVER (PARTITION BY chunk_id, standard_id ORDER BY
     CASE alignment_source WHEN 'human' THEN 4 WHEN 'publisher_guide' THEN 3 WHEN 'llm_verified' THEN 2 ELSE 1 END DESC,
     align_id DESC, alignment_score DESC, coalesce(coverage_notes, '') DESC) AS rn
  FROM fx_alignments_raw) t WHERE rn = 1""",
    "fx_prereqs": """
SELECT DISTINCT a.standard_id AS source_id, b.standard_id AS target_id, 'prerequisite' AS relationship FROM (
  SELECT standard_id, std_num, CAST(floor(std_num / 2e0) AS BIGINT) AS need FROM fx_standards
  UNION ALL SELECT standard_id, std_num, CAST(floor(std_num / 3e0) AS BIGINT) AS need FROM fx_standards
  UNION ALL SELECT standard_id, std_num, CAST(7 AS BIGINT) AS need FROM fx_standards WHERE std_num = 1) a
JOIN fx_standards b ON b.std_num = a.need WHERE a.std_num <> b.std_num""",
    "fx_crosswalk": """
SELECT concat('STD.', CAST(n_regionkey AS STRING), '.', CAST(n_nationkey AS STRING)) AS standard_id,
       CASE n_nationkey % 2 WHEN 0 THEN 'SAT' ELSE 'ACT' END AS exam_series, concat('Domain ', n_name) AS skill_domain FROM nation
UNION ALL
SELECT concat('STD.', CAST(r_regionkey AS STRING)), 'NAEP Grade 8', concat('Region ', r_name) FROM region""",
    "fx_questions": """
SELECT std_num AS question_id, standard_id, system FROM fx_standards""",
    "fx_queries": """
SELECT item_id AS query_id, text AS query_text FROM benchmark""",
    "fx_verdicts": """
SELECT a.chunk_id, a.standard_id, CASE l.quality WHEN 1 THEN 'verified' ELSE 'reject' END AS verdict,
       concat('judged ', CAST(l.doc_id AS STRING)) AS note
FROM labels l JOIN fx_alignments a ON a.chunk_id = concat('chunk-', CAST(l.doc_id AS STRING)) WHERE a.align_id % 7 = 0
UNION ALL
SELECT concat('chunk-', CAST(doc_id AS STRING)), 'STD.none', 'verified', 'no such pair' FROM labels WHERE toxic = 1""",
    "fx_vec_standards": """
SELECT vec_id AS std_num, embedding FROM embeddings WHERE vec_id % 10 = 0""",
    "fx_vec_chunks": """
SELECT vec_id AS doc_id, embedding FROM embeddings WHERE vec_id % 10 <> 0""",
    "fx_docs": """
SELECT concat('doc-', CAST(doc_id AS STRING)) AS chunk_id, source AS source_id, lang AS book_lang,
       substr(text, 1, 40) AS title, text AS content,
       CASE doc_id % 5 WHEN 0 THEN 'exposition' WHEN 1 THEN 'worked_example' WHEN 2 THEN 'exercise_set' WHEN 3 THEN 'summary' ELSE 'assessment' END AS content_type,
       CASE doc_id % 4 WHEN 0 THEN 'K-5' WHEN 1 THEN '6-8' WHEN 2 THEN '9-12' ELSE NULL END AS grade_band,
       CASE WHEN doc_id % 19 = 0 THEN 1 ELSE 0 END AS stale, doc_id AS ord
FROM documents""",
    "fx_places": """
SELECT concat('doc-', CAST(doc_id AS STRING)) AS chunk_id,
       CASE doc_id % 4 WHEN 0 THEN 'core' WHEN 1 THEN 'ncsa' WHEN 2 THEN 'ap' ELSE 'state' END AS part
FROM documents""",
}
#: Views that Spark builds by the library's own aggregate; a query of its own checks that against the view's SQL.
_BUILT = {"fx_alignments": ("fx_alignments_raw", lambda raw: merge_tiers(raw.drop("created_at")))}


def needed(sql: str) -> list[str]:
    """The views that a statement reads, in order, with those that they read."""
    want = {v for v in VIEWS if re.search(rf"\b{v}\b", sql)}
    for v in reversed(VIEWS):
        if v in want:
            want |= {u for u in VIEWS if u != v and re.search(rf"\b{u}\b", VIEWS[v])}
    return [v for v in VIEWS if v in want]


def with_views(sql: str) -> str:
    """A statement (that may begin with WITH or WITH RECURSIVE) with the views that it reads as common table expressions."""
    views = ", ".join(f"{v} AS ({VIEWS[v]})" for v in needed(sql))
    body = sql.strip()
    m = re.match(r"WITH\s+(RECURSIVE\s+)?", body)
    if not views:
        return body
    return f"WITH {m[1] or ''}{views}, {body[m.end():]}" if m else f"WITH {views} {body}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or view over the Parquet tables in sf_dir."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in _BUILT:
        source, build = _BUILT[name]
        return build(view(spark, sf_dir, source))
    sql = VIEWS[name]
    inputs = [t for t in [*TABLES, *VIEWS] if t != name and re.search(rf"\b(?:FROM|JOIN)\s+{t}\b", sql)]
    for t in inputs:
        sql = re.sub(rf"\b(FROM|JOIN)\s+{t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **{t: view(spark, sf_dir, t) for t in inputs})
