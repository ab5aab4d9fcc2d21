"""Content for tables of standards: ranked top-k, chunk details, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions.standards import ancestors, content_rank, part_rank, tier_rank


def best_of_standards(alignments: DataFrame, chunks: DataFrame, order: list[Column], *, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The first k of the live alignments of every standard (and value of `by`), joined with `chunks` on chunk_id.

    An order that doesn't look at a question ranks alike for every question of a standard, so what is not among the k best of
    its own standard is among the k best of no question. Whoever joins questions afterwards meets k rows for a standard, not
    all it has. Rows of a standard are cut in each task first (the plan's WindowGroupLimit), before they are shuffled.
    """
    hits = alignments.where("stale = 0").join(chunks, "chunk_id")
    place = F.row_number().over(Window.partitionBy("standard_id", *by).orderBy(*order))
    return hits.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def best_of_questions(questions: DataFrame, best: DataFrame, order: list[Column], *, k: int, by: tuple[str, ...] = (), rank: str = "rank") -> DataFrame:
    """The k first of each question (question_id, standard_id; and value of `by`), merged from the k best of its standards."""
    place = F.row_number().over(Window.partitionBy("question_id", *by).orderBy(*order))
    return questions.join(best, "standard_id").withColumn(rank, place).where(F.col(rank) <= k)


def above(questions: DataFrame) -> DataFrame:
    """(question_id, standard_id) of every question's standard and of all that it stands under."""
    return questions.select("question_id", F.explode(ancestors(F.col("standard_id"))).alias("standard_id"))


def content_for_standards(
    questions: DataFrame, alignments: DataFrame, chunks: DataFrame, *, k: int = 3, source: str | None = None, content_type: str | None = None, dok_level: int | None = None, include_content: bool = False, system: str | None = None
) -> DataFrame:
    """The k best chunks of every question (question_id, standard_id), by content rank, tier and score.

    In two levels: the k best of every standard, then of the k of each standard that a question stands under. Only ids and
    sort keys are ranked; texts join the rows that remain.
    """
    c = chunks.where("stale = 0")
    for name, value in (("source_id", source), ("content_type", "assessment" if dok_level is not None else content_type), ("dok_level", dok_level)):
        c = c.where(F.col(name) == value) if value is not None else c
    a = alignments.where(F.col("standard_system") == system) if system else alignments
    order = [content_rank(F.col("content_type")).desc(), tier_rank(F.col("alignment_source")).desc(), F.desc("alignment_score"), "chunk_id", "standard_id"]
    a = a.select("standard_id", "chunk_id", "stale", "alignment_score", "alignment_source", "coverage_notes")
    best = best_of_questions(above(questions), best_of_standards(a, c.select("chunk_id", "content_type"), order, k=k), order, k=k)
    best = best.select("question_id", "rank", "chunk_id", "standard_id", F.round("alignment_score", 4).alias("alignment_score"), "alignment_source", "coverage_notes")
    content = F.col("content") if include_content else F.lit(None).cast("string").alias("content")
    return best.join(chunks.select("chunk_id", "source_id", "part", "title", "content_type", "grade_band", "dok_level", "exam_series", content), "chunk_id")


def unanswered(questions: DataFrame, answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """Questions without a hit, with the reason and the sources that there are."""
    sources = chunks.where("stale = 0").agg(F.array_join(F.sort_array(F.collect_set("source_id")), ",").alias("available_sources"))
    none = questions.join(answers.select("question_id"), "question_id", "left_anti")
    return none.select("question_id", "standard_id", F.lit("no_aligned_content").alias("reason")).crossJoin(F.broadcast(sources))


def neighbours(chunks: DataFrame) -> DataFrame:
    """Every live chunk with the live ones before and after it in its book."""
    w = Window.partitionBy("part", "book_id").orderBy("ord", "chunk_id")
    return chunks.where("stale = 0").select("chunk_id", "part", "book_id", F.lag("chunk_id").over(w).alias("previous"), F.lead("chunk_id").over(w).alias("next"))


def chunk_details(ids: DataFrame, chunks: DataFrame, alignments: DataFrame, *, include_adjacent: bool = False) -> DataFrame:
    """One row for each of `ids` (chunk_id): its live chunk of the first partition, its live alignments by score, or not_found."""
    first = F.row_number().over(Window.partitionBy("chunk_id").orderBy(part_rank(F.col("part"))))
    wanted = ids.select("chunk_id").distinct()
    c = chunks.where("stale = 0").join(wanted, "chunk_id", "left_semi").withColumn("_n", first).where("_n = 1").drop("_n")
    item = F.struct((-F.col("alignment_score")).alias("s"), "standard_id", "alignment_source", "coverage_notes")
    a = alignments.where("stale = 0").join(wanted, "chunk_id", "left_semi").groupBy("chunk_id").agg(F.sort_array(F.collect_list(item)).alias("alignments"))
    out = wanted.join(c, "chunk_id", "left").join(a, "chunk_id", "left")
    if include_adjacent:
        out = out.join(neighbours(chunks).select("chunk_id", "part", "previous", "next"), ["chunk_id", "part"], "left")
    status = F.when(F.col("book_id").isNull() & F.col("title").isNull(), "not_found").otherwise("found")
    return out.withColumn("result", status)
