"""Verification and annotation of alignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pending_verification(alignments: DataFrame, chunks: DataFrame, *, shards: int | None = None, shard: int = 0, limit: int | None = None) -> DataFrame:
    """Flagged embedding alignments of live chunks; whether the alignment itself is stale doesn't count."""
    a = alignments.where("flagged_for_review = 1 and alignment_source = 'embedding'")
    a = a.where(F.col("align_id") % shards == shard) if shards else a
    out = a.join(chunks.where("stale = 0").select("chunk_id", "title", "content"), "chunk_id")
    return out.orderBy("align_id").limit(limit) if limit is not None else out


def pending_annotation(alignments: DataFrame, chunks: DataFrame) -> DataFrame:
    """Flagged alignments without a note of tier embedding or llm_verified; neither stale flag counts."""
    a = alignments.where("flagged_for_review = 1 and coverage_notes is null and alignment_source in ('embedding', 'llm_verified')")
    return a.join(chunks.select("chunk_id", "title", "content", "content_type"), "chunk_id")


def strict_annotation(alignments: DataFrame, chunks: DataFrame, *, score: float = 0.78) -> DataFrame:
    """Live alignments without a note: verified tiers, and embedding from `score`; those of stale chunks drop out."""
    a = alignments.where("stale = 0 and coalesce(coverage_notes, '') = ''").where(F.col("alignment_source").isin("publisher_guide", "human", "llm_verified") | ((F.col("alignment_source") == "embedding") & (F.col("alignment_score") >= score)))
    return a.join(chunks.where("stale = 0").select("chunk_id", "title", "content_type"), "chunk_id")


def standard_context(standards: DataFrame, sub_standards: DataFrame) -> DataFrame:
    """Every standard's text and its parts in order as 'letter: text; ...' or '(none)'."""
    parts = sub_standards.groupBy(F.col("parent_id").alias("standard_id")).agg(F.sort_array(F.collect_list(F.struct("position", "id", "text"))).alias("p"))
    letter = lambda x: F.concat(F.element_at(F.split(x["id"], r"\."), -1), F.lit(": "), x["text"])
    return standards.join(parts, "standard_id", "left").select("standard_id", "standard_text", F.coalesce(F.array_join(F.transform("p", letter), "; "), F.lit("(none)")).alias("sub_standards"))


def verify_prompt(standard_id: Column, text: Column, parts: Column, title: Column, content: Column, limit: int = 1500) -> Column:
    return F.concat(
        F.lit("Does this content teach the standard? Answer YES or NO.\nStandard "), standard_id, F.lit(": "), text, F.lit("\nParts: "), parts, F.lit("\nTitle: "), F.coalesce(title, F.lit("")), F.lit("\n"), F.substring(F.coalesce(content, F.lit("")), 1, limit)
    )


def parse_verdict(answer: Column) -> Column:
    """YES... is true, NO... is false, anything else null."""
    a = F.upper(F.trim(answer))
    return F.when(a.startswith("YES"), True).when(a.startswith("NO"), False)


def apply_answers(alignments: DataFrame, answers: DataFrame, *, score: float = 0.90) -> DataFrame:
    """Answers (align_id, answer): true makes llm_verified at `score`, false takes the flag off, null changes nothing."""
    j = alignments.join(answers.select("align_id", parse_verdict(F.col("answer")).alias("_v")), "align_id", "left")
    yes, no = F.coalesce(F.col("_v"), F.lit(False)), F.coalesce(~F.col("_v"), F.lit(False))
    return (
        j.withColumn("alignment_source", F.when(yes, "llm_verified").otherwise(F.col("alignment_source"))).withColumn("alignment_score", F.when(yes, score).otherwise(F.col("alignment_score")))
        .withColumn("flagged_for_review", F.when(no, 0).otherwise(F.col("flagged_for_review"))).withColumn("outcome", F.when(yes, "promoted").when(no, "rejected").otherwise("skipped")).drop("_v")
    )


def band_level(grade_band: Column) -> Column:
    """Level of a chunk's band in the heuristic check: the first number, 0 with K, 6 if there is none."""
    number = F.regexp_extract(grade_band, "([0-9]+)", 1)
    one = grade_band.contains("1") & ~grade_band.contains("9") & ~grade_band.contains("10")
    return F.when(F.coalesce(grade_band, F.lit("")) == "", 6).when(grade_band.contains("K"), 0).when(one, 1).when(number != "", number.try_cast("int")).otherwise(6)


def standard_level(standard_id: Column) -> Column:
    """Level named by the third of at least four components: K, HS or a number."""
    p = F.split(standard_id, r"\.")
    g = F.try_element_at(p, F.lit(3))
    return F.when(F.size(p) >= 4, F.when(g == "K", 0).when(g == "HS", 9).when(g.rlike("^[0-9]+$"), g.try_cast("int")))


def heuristic_verification(alignments: DataFrame, chunks: DataFrame, standards: DataFrame, *, system: str = "ccss", low: float = 0.70, high: float = 0.78) -> DataFrame:
    """Embedding alignments from `low` to `high` checked by grade, content type, the catalogue of `system` and title: the adjusted score
    within 0.65 and 0.95, whether it is aligned (0.70), and the reasons. All of them become llm_verified."""
    a = alignments.where("stale = 0 and alignment_source = 'embedding'").where(F.col("alignment_score").between(low, high))
    j = a.join(chunks.where("stale = 0").select("chunk_id", "title", "content_type", "grade_band"), "chunk_id").join(standards.where(F.col("system") == system).select("standard_id", F.lit(True).alias("_known")).distinct(), "standard_id", "left")
    level = standard_level(F.col("standard_id"))
    apart = F.abs(band_level(F.col("grade_band")) - level)
    weak = (F.col("content_type") == "exercise_set") & (F.col("alignment_score") < 0.75)
    by_grade = F.when(level.isNull(), 0.0).when(apart <= 1, 0.02).when(apart == 2, -0.05).otherwise(-0.10)
    by_type = F.when(F.col("content_type").isin("worked_example", "exposition", "assessment"), 0.01).when(weak, -0.08).when(F.col("content_type") == "exercise_set", -0.02).when(F.col("content_type") == "summary", -0.01).otherwise(0.0)
    concept = F.lower(F.try_element_at(F.split("standard_id", r"\."), F.lit(4)))
    by_title = F.when(F.coalesce(F.contains(F.lower("title"), concept), F.lit(False)), 0.03).otherwise(0.0)
    unknown = F.col("_known").isNull()
    score = F.round(F.least(F.lit(0.95), F.greatest(F.lit(0.65), F.col("alignment_score") + by_grade + by_type + F.when(unknown, -0.10).otherwise(0.0) + by_title)), 6)
    reasons = F.filter(F.array(F.when(F.coalesce(apart > 1, F.lit(False)), "Grade mismatch"), F.when(weak, "Weak content type"), F.when(unknown, "Unknown standard")), lambda x: x.isNotNull())
    out = j.select("chunk_id", "standard_id", F.col("alignment_score").alias("old_score"), score.alias("alignment_score"), F.when(F.size(reasons) > 0, F.array_join(reasons, " + ")).otherwise("Consistent alignment").alias("reason"))
    return out.withColumn("is_aligned", F.col("alignment_score") >= 0.70).withColumn("alignment_source", F.lit("llm_verified"))


def rescore(alignments: DataFrame, answers: DataFrame) -> DataFrame:
    """JSON answers (align_id, answer: {"aligned": bool, ...}): aligned adds 0.05 up to 0.95, not aligned takes 0.10 off, at most
    0.65; both become llm_verified; an answer that is no such JSON is an error and changes nothing."""
    v = F.from_json("answer", "aligned boolean, reason string")["aligned"]
    j = alignments.join(answers.select("align_id", v.alias("_v"), F.lit(True).alias("_asked")), "align_id", "left")
    score = F.when(F.col("_v"), F.least(F.lit(0.95), F.col("alignment_score") + 0.05)).when(~F.col("_v"), F.least(F.lit(0.65), F.col("alignment_score") - 0.10)).otherwise(F.col("alignment_score"))
    state = F.when(F.col("_asked").isNull(), "unasked").when(F.col("_v").isNull(), "error").when(F.col("_v"), "aligned").otherwise("not_aligned")
    return j.withColumn("outcome", state).withColumn("alignment_score", F.round(score, 6)).withColumn("alignment_source", F.when(F.col("_v").isNotNull(), "llm_verified").otherwise(F.col("alignment_source"))).drop("_v", "_asked")


def should_annotate(source: Column, score: Column, notes: Column) -> Column:
    have = F.coalesce(F.length(notes) > 30, F.lit(False))
    return ~have & (source.isin("publisher_guide", "human") | ((source == "llm_verified") & (score >= 0.75)) | ((source == "embedding") & (score >= 0.78)))


def template_note(title: Column, content_type: Column, grade_band: Column, standard_id: Column, text: Column) -> Column:
    """The coverage note of a content type. The sentences are fixed values."""
    named = text.contains(":")
    head = F.trim(F.split_part(text, F.lit(":"), F.lit(1)))
    last = F.element_at(F.split(standard_id, r"\."), -1)
    what = F.when(named, head).otherwise(last)
    low = F.lower(title)
    say = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in x])
    return (
        F.when(content_type == "worked_example", say("Worked example demonstrating ", what, ". Provides step-by-step solution approach for this standard."))
        .when(content_type == "exposition", say("Teaches ", F.when(named, head).otherwise("this standard"), " through explanation and examples. Grade level: ", F.coalesce(F.nullif(grade_band, F.lit("")), F.lit("K-12")), "."))
        .when(content_type == "exercise_set", say("Provides ", F.when(low.contains("practice"), "practice problems").otherwise("exercises"), " for ", what, ". Reinforces procedural fluency and conceptual understanding."))
        .when(content_type == "summary", say("Summary of ", what, ". Consolidates key ideas and procedures for this standard."))
        .when(content_type == "assessment", say(F.when(low.contains("multiple"), "Multiple choice question").otherwise("Assessment item"), " assessing ", what, ". Evaluates student mastery of this standard."))
        .otherwise(say("Content addressing ", last, ". Supports instruction for this standard."))
    )


def template_notes(alignments: DataFrame, chunks: DataFrame, standards: DataFrame) -> DataFrame:
    """(chunk_id, standard_id, note) of the live alignments that should be annotated."""
    a = alignments.where("stale = 0").where(should_annotate(F.col("alignment_source"), F.col("alignment_score"), F.col("coverage_notes")))
    j = a.join(chunks.select("chunk_id", "title", "content_type", "grade_band"), "chunk_id").join(standards.select("standard_id", "standard_text"), "standard_id")
    return j.select("chunk_id", "standard_id", template_note(F.col("title"), F.col("content_type"), F.col("grade_band"), F.col("standard_id"), F.col("standard_text")).alias("note"))


def flag_band(alignments: DataFrame, *, low: float = 0.65, high: float = 0.78) -> DataFrame:
    """Flags embedding alignments from `low` to below `high`."""
    hit = (F.col("alignment_source") == "embedding") & (F.col("alignment_score") >= low) & (F.col("alignment_score") < high)
    return alignments.withColumn("flagged_for_review", F.when(hit, 1).otherwise(F.coalesce("flagged_for_review", F.lit(0))))


def flagged_left(alignments: DataFrame, chunks: DataFrame) -> DataFrame:
    """Flagged embedding alignments by partition."""
    return alignments.join(chunks.select("chunk_id", "part"), "chunk_id").groupBy("part").agg(F.count_if((F.col("flagged_for_review") == 1) & (F.col("alignment_source") == "embedding")).alias("left"))


def generation_candidates(alignments: DataFrame, chunks: DataFrame, standards: DataFrame, series: str) -> DataFrame:
    """Catalogued standards with a live alignment but no live item of the series."""
    live = alignments.where("stale = 0")
    done = live.join(chunks.where((F.col("stale") == 0) & (F.col("exam_series") == series)).select("chunk_id"), "chunk_id").select("standard_id")
    return live.select("standard_id").distinct().join(done, "standard_id", "left_anti").join(standards.select("standard_id", "standard_text"), "standard_id")
