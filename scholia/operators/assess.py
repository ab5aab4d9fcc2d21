"""Standards against exams: crosswalk, items and gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.functions.standards import ancestors, part_rank, tier_rank
from scholia.operators.retrieve import best_of_questions, best_of_standards


def exam_crosswalk(questions: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Crosswalk rows of every question's standard and of all that it stands under."""
    q = questions.select("question_id", F.explode(ancestors(F.col("standard_id"))).alias("standard_id"))
    return q.join(crosswalk, "standard_id").select("question_id", F.col("standard_id").alias("matched_id"), "exam_series", "skill_domain")


def exam_items(questions: DataFrame, alignments: DataFrame, chunks: DataFrame, *, items_per_exam: int = 2) -> DataFrame:
    """Up to n assessment chunks of each exam for exactly the question's standard: partition by partition, then tier and score."""
    items = chunks.where("stale = 0 and content_type = 'assessment' and exam_series is not null").select("chunk_id", "part", "exam_series", "dok_level")
    order = [part_rank(F.col("part")), tier_rank(F.col("alignment_source")).desc(), F.desc("alignment_score"), "chunk_id"]
    best = best_of_standards(alignments.select("standard_id", "chunk_id", "stale", "alignment_score", "alignment_source"), items, order, k=items_per_exam, by=("exam_series",))
    out = best_of_questions(questions.select("question_id", "standard_id"), best, order, k=items_per_exam, by=("exam_series",), rank="item_rank")
    return out.select("question_id", "exam_series", "item_rank", "chunk_id", "part", "alignment_source", F.round("alignment_score", 4).alias("alignment_score"), "dok_level")


def assessment_map(questions: DataFrame, crosswalk: DataFrame, alignments: DataFrame, chunks: DataFrame, *, items_per_exam: int = 2, catalogue: bool = True) -> DataFrame:
    """One row for each question: exams that test it, exams with items, and exams without any."""
    store = "exam_series" in chunks.columns
    walk = exam_crosswalk(questions, crosswalk).groupBy("question_id").agg(F.sort_array(F.collect_set("exam_series")).alias("exams"))
    out = questions.select("question_id").join(walk, "question_id", "left")
    empty = F.array().cast("array<string>")
    if store:
        have = exam_items(questions, alignments, chunks, items_per_exam=items_per_exam).groupBy("question_id").agg(F.sort_array(F.collect_set("exam_series")).alias("with_items"), F.count("*").alias("items"))
        out = out.join(have, "question_id", "left")
    else:
        out = out.withColumn("with_items", empty).withColumn("items", F.lit(0).cast("long"))
    exams, have = F.coalesce("exams", empty), F.coalesce("with_items", empty)
    return out.select(
        "question_id", F.array_join(exams, ",").alias("exams"), F.array_join(have, ",").alias("with_items"), F.coalesce("items", F.lit(0)).cast("long").alias("items"), F.array_join(F.sort_array(F.array_except(exams, have)), ",").alias("gaps"),
        F.lit("full" if catalogue else "unavailable").alias("crosswalk_coverage"), F.lit("ready" if store else "no_item_store").alias("items_status"),
    )
