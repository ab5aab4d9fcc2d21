"""How well the corpus covers each standard and cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.functions.standards import band_name, band_rank, coverage_band, part_rank
from scholia.sources.corpus import stored


def best_alignments(alignments: DataFrame, chunks: DataFrame, *, source: str | None = None) -> DataFrame:
    """For every standard its live alignment with the highest score (ties: earlier partition, then chunk_id), by one aggregate."""
    c = chunks.where("stale = 0")
    c = c.where(F.col("source_id") == source) if source else c
    a = alignments.where("stale = 0").join(c.select("chunk_id", "part"), "chunk_id")
    best = F.min_by(F.struct("alignment_score", "alignment_source", "chunk_id", "part"), F.struct((-F.col("alignment_score")).alias("s"), part_rank(F.col("part")).alias("p"), "chunk_id"))
    return a.groupBy("standard_id").agg(best.alias("b")).select("standard_id", "b.alignment_score", "b.alignment_source", "b.chunk_id", "b.part")


def ids_with_prefix(prefixes: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of `prefixes` (prefix, ...) with all rows of `ids` (standard_id, ...) that begin with it.

    An interval join: ids are sorted into ranges, a prefix meets the ranges that overlap [prefix, next prefix), and the join
    is on the number of the range, so no key holds more ids than a range. The ends of the ranges, one pair for each
    partition of the sort, are one row that goes to every task.
    """
    laid = stored(ids.where("standard_id is not null").repartitionByRange("standard_id").withColumn("range", F.spark_partition_id()))
    ends = laid.groupBy("range").agg(F.min("standard_id").alias("low"), F.max("standard_id").alias("high"))
    ends = ends.agg(F.collect_list(F.struct("range", "low", "high")).alias("ends"))
    p = F.col("prefix")
    over = F.filter("ends", lambda e: (e["high"] >= p) & ((e["low"] <= p) | e["low"].startswith(p)))
    asked = prefixes.where("prefix is not null").crossJoin(F.broadcast(ends)).withColumn("range", F.explode(F.transform(over, lambda e: e["range"]))).drop("ends")
    return asked.join(laid, "range").where(F.col("standard_id").startswith(p)).drop("range")


def expand_clusters(questions: DataFrame, standards: DataFrame) -> DataFrame:
    """(question_id, standard_id, standard_text) of the cluster of every question; a question that no standard is equal to
    takes the standards that begin with it, without one capital letter at its end. Questions that match nothing have no row."""
    q = questions.select("question_id", F.col("standard_id").alias("asked"), "system")
    s = standards.select("system", F.col("standard_id"), "standard_text", "domain", "cluster")
    exact = q.join(s.select("system", F.col("standard_id").alias("asked"), "domain", "cluster"), ["system", "asked"])
    whole = exact.join(s, ["system", "domain", "cluster"]).select("question_id", "standard_id", "standard_text")
    other = q.join(exact.select("question_id"), "question_id", "left_anti").select("question_id", F.col("system").alias("of"), F.regexp_replace("asked", r"\.[A-Z]$", "").alias("prefix"))
    begin = ids_with_prefix(other, s.select("system", "standard_id", "standard_text")).where(F.col("of") == F.col("system"))
    return whole.unionByName(begin.select("question_id", "standard_id", "standard_text"))


def coverage_details(questions: DataFrame, standards: DataFrame, alignments: DataFrame, chunks: DataFrame, *, source: str | None = None) -> DataFrame:
    """Band and best chunk of every standard in every question's cluster."""
    best = best_alignments(alignments, chunks, source=source)
    out = expand_clusters(questions, standards).join(best, "standard_id", "left")
    return out.select("question_id", "standard_id", coverage_band(F.col("alignment_score"), F.col("alignment_source")).alias("coverage"), F.col("chunk_id").alias("best_chunk"), F.round("alignment_score", 4).alias("alignment_score"), "alignment_source")


def coverage_report(questions: DataFrame, standards: DataFrame, alignments: DataFrame, chunks: DataFrame, *, source: str | None = None) -> DataFrame:
    """One row for each question: standards checked, gaps and the worst band among what is covered (none if nothing is)."""
    d = coverage_details(questions, standards, alignments, chunks, source=source)
    rank = band_rank(F.col("coverage"))
    r = d.groupBy("question_id").agg(
        F.count("*").alias("standards_checked"), F.min(F.when(rank > 0, rank)).alias("worst"), F.array_join(F.sort_array(F.collect_list(F.when(rank == 0, F.col("standard_id")))), ",").alias("gaps")
    )
    r = r.select("question_id", "standards_checked", band_name(F.coalesce("worst", F.lit(0))).alias("overall_coverage"), "gaps", F.lit("full").alias("gap_detection"), F.lit("ok").alias("result"))
    unknown = questions.join(r, "question_id", "left_anti").select("question_id", F.lit(0).cast("long"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("unknown_standard"))
    return r.union(unknown)


def coverage_without_catalogue(prefixes: DataFrame, alignments: DataFrame) -> DataFrame:
    """(question_id, standard_id) of aligned standards that begin with a question's prefix, where there is no catalogue."""
    p = prefixes.select("question_id", F.regexp_replace("standard_id", r"\.+$", "").alias("prefix"))
    hit = ids_with_prefix(p, alignments.where("stale = 0").select("standard_id").distinct())
    return hit.select("question_id", "standard_id", F.lit("unavailable_without_catalogue").alias("gap_detection"))
