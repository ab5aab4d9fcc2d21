"""Prerequisite walks and learning paths over the graph of standards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions.standards import coverage_band, tier_rank
from scholia.operators.coverage import best_alignments
from scholia.sources.corpus import stored


def prerequisites(questions: DataFrame, standards: DataFrame, edges: DataFrame, *, depth: int = 1) -> DataFrame:
    """(question_id, standard_id, distance): every question's standard and what leads up to it within `depth` steps, at its
    least distance. The edges have source_id (needs) and target_id (is needed).

    A step joins the pairs (question, standard) that are new with the edges of the catalogue, which are made once, and keeps
    those that no earlier step saw; it is stored, so each step reads the edges once and no step is computed again, and a
    cycle ends when nothing is new.
    """
    known = standards.select("system", "standard_id").distinct()
    pre = edges.where("relationship = 'prerequisite'").select(F.col("source_id").alias("standard_id"), "target_id").join(known.select("system", F.col("standard_id").alias("target_id")), "target_id")
    pre = stored(pre.select("system", "standard_id", "target_id").distinct())
    front = stored(questions.join(known, ["system", "standard_id"]).select("question_id", "system", "standard_id").distinct().withColumn("distance", F.lit(0)))
    seen = front
    for d in range(1, depth + 1):
        new = front.join(pre, ["system", "standard_id"]).select("question_id", "system", F.col("target_id").alias("standard_id")).distinct()
        front = stored(new.join(seen, ["question_id", "system", "standard_id"], "left_anti").withColumn("distance", F.lit(d)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.groupBy("question_id", "standard_id").agg(F.min("distance").alias("distance"))


def learning_paths(questions: DataFrame, standards: DataFrame, edges: DataFrame, alignments: DataFrame, chunks: DataFrame, *, depth: int = 1, k: int = 2) -> DataFrame:
    """One row for each standard on each question's path, farthest first: its band and its k best chunks by tier and score."""
    nodes = prerequisites(questions, standards, edges, depth=depth)
    best = best_alignments(alignments, chunks).select("standard_id", coverage_band(F.col("alignment_score"), F.col("alignment_source")).alias("coverage"))
    live = alignments.where("stale = 0").join(nodes.select("standard_id").distinct(), "standard_id", "left_semi").join(chunks.where("stale = 0").select("chunk_id"), "chunk_id")
    w = Window.partitionBy("standard_id").orderBy(tier_rank(F.col("alignment_source")).desc(), F.desc("alignment_score"), "chunk_id")
    top = live.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)
    content = top.groupBy("standard_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "chunk_id"))), lambda x: x["chunk_id"]), ",").alias("content"))
    out = nodes.join(best, "standard_id", "left").join(content, "standard_id", "left")
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("distance"), "standard_id"))
    coverage = F.coalesce("coverage", F.lit("none"))
    return out.select("question_id", place.alias("step"), "standard_id", "distance", coverage.alias("coverage"), F.coalesce("content", F.lit("")).alias("content"), (coverage == "none").alias("is_gap"))
