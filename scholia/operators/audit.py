"""Audits of alignment quality and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.operators.retrieve import best_of_questions, best_of_standards

STRONG = 0.8


def _r(c: Column, n: int = 4) -> Column:
    return F.round(c, n)


def mean_score(score: Column) -> Column:
    """The mean of scores to 6 places, from exact sums, so that it doesn't depend on the order of the rows."""
    return F.try_divide(F.sum(F.round(score * 1e6).cast("long")).cast("double"), F.count(score)) / 1e6


def _joined(chunks: DataFrame, alignments: DataFrame) -> DataFrame:
    a = alignments.where("stale = 0").select("chunk_id", "standard_id", "alignment_score", "alignment_source", "coverage_notes")
    return chunks.where("stale = 0").select("chunk_id", "grade_band", "source_id").join(a, "chunk_id", "left")


def by_group(chunks: DataFrame, alignments: DataFrame, column: str) -> DataFrame:
    """Distinct chunks and standards, alignments and scores by a chunk column; null is a group, unaligned chunks count."""
    score = F.col("alignment_score")
    return _joined(chunks, alignments).groupBy(column).agg(
        F.countDistinct("chunk_id").alias("chunks"), F.countDistinct("standard_id").alias("standards"), F.count("standard_id").alias("alignments"), mean_score(score).alias("avg_score"), F.min(score).alias("min_score"),
        F.max(score).alias("max_score"), _r(F.avg(F.when(score >= STRONG, 100.0).otherwise(0.0)), 2).alias("strong_percent"),
    )


def by_tier(alignments: DataFrame) -> DataFrame:
    s = F.col("alignment_score")
    return alignments.where("stale = 0").groupBy("alignment_source").agg(F.count("*").alias("n"), mean_score(s).alias("avg_score"), F.min(s).alias("min_score"), F.max(s).alias("max_score"), _r(100.0 * F.count_if(s >= STRONG) / F.count("*"), 2).alias("strong_percent"))


def top_standards(alignments: DataFrame, standards: DataFrame, n: int = 20) -> DataFrame:
    """The n standards with most distinct chunks."""
    g = alignments.where("stale = 0").groupBy("standard_id").agg(F.countDistinct("chunk_id").alias("chunks"), mean_score(F.col("alignment_score")).alias("avg_score"), F.array_join(F.sort_array(F.collect_set("alignment_source")), ",").alias("tiers"))
    return g.orderBy(F.desc("chunks"), "standard_id").limit(n).join(standards.select("standard_id", "standard_text"), "standard_id", "left")


def outliers(alignments: DataFrame, chunks: DataFrame, *, below: float = 0.7) -> DataFrame:
    """Trusted tiers with a low score."""
    a = alignments.where("stale = 0").where(F.col("alignment_source").isin("publisher_guide", "human") & (F.col("alignment_score") < below))
    return a.join(chunks.where("stale = 0").select("chunk_id", "title"), "chunk_id").select("chunk_id", "standard_id", "alignment_source", "alignment_score", "title")


def standard_coverage(standards: DataFrame, alignments: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every catalogued standard: chunks, mean and best score, level (strong from 3 chunks, weak from 1, none)."""
    live = alignments.where("stale = 0").join(chunks.where("stale = 0").select("chunk_id"), "chunk_id")
    g = live.groupBy("standard_id").agg(F.countDistinct("chunk_id").alias("n"), mean_score(F.col("alignment_score")).alias("avg_score"), F.max("alignment_score").alias("max_score"))
    n = F.coalesce("n", F.lit(0))
    return standards.join(g, "standard_id", "left").select("standard_id", "domain", "grade", n.alias("chunks"), "avg_score", "max_score", F.when(n >= 3, "strong").when(n >= 1, "weak").otherwise("none").alias("level"))


def weak_standards(coverage: DataFrame, *, below: float = 0.75) -> DataFrame:
    """Standards with no chunk, or with one whose mean score is low."""
    return coverage.where((F.col("chunks") == 0) | ((F.col("chunks") == 1) & (F.col("avg_score") < below)))


def level_totals(coverage: DataFrame) -> DataFrame:
    return coverage.groupBy("level").agg(F.count("*").alias("standards"))


def summary(alignments: DataFrame) -> DataFrame:
    tiers = [F.count_if(F.col("alignment_source") == t).alias(t) for t in ("human", "publisher_guide", "llm_verified", "embedding")]
    s = F.col("alignment_score")
    return alignments.where("stale = 0").agg(F.count("*").alias("alignments"), F.countDistinct("chunk_id").alias("chunks"), F.countDistinct("standard_id").alias("standards"), mean_score(s).alias("avg_score"), F.count_if(s >= STRONG).alias("strong"), *tiers)


def note_quality(alignments: DataFrame, *, length: int = 30) -> DataFrame:
    n = F.col("coverage_notes")
    a = alignments.where("stale = 0").agg(F.count("*").alias("total"), F.count(n).alias("with_note"), F.count_if(F.length(n) > length).alias("good"), _r(F.avg(F.length(n))).alias("avg_length"))
    return a.withColumn("note_percent", _r(F.try_divide(100.0 * F.col("with_note"), "total"), 2)).withColumn("good_percent", _r(F.try_divide(100.0 * F.col("good"), "total"), 2))


def grade_domain_matrix(standards: DataFrame, alignments: DataFrame, domains: list[str]) -> DataFrame:
    """Distinct covered standards by grade, a column for each domain."""
    covered = standards.join(alignments.where("stale = 0").select("standard_id").distinct(), "standard_id", "left_semi")
    m = covered.groupBy("grade").pivot("domain", domains).agg(F.countDistinct("standard_id"))
    return m.na.fill(0, subset=domains)


def source_quality(chunks: DataFrame, alignments: DataFrame) -> DataFrame:
    tiers = [F.count_if(F.col("alignment_source") == t).alias(t) for t in ("human", "publisher_guide", "llm_verified", "embedding")]
    s = F.col("alignment_score")
    return _joined(chunks, alignments).groupBy("source_id").agg(F.countDistinct("chunk_id").alias("chunks"), F.countDistinct("standard_id").alias("standards"), F.count("standard_id").alias("alignments"), mean_score(s).alias("avg_score"), *tiers, F.count_if(s >= STRONG).alias("strong"))


#: What the reports of `quality_reports` are by.
REPORTS = ("grade_band", "source_id", "alignment_source")


def quality_reports(chunks: DataFrame, alignments: DataFrame) -> DataFrame:
    """(report, value, ...): quality by grade band and by source of all live chunks, and by tier of all live alignments, from
    one scan of either table, one join and one aggregate over grouping sets.

    Unaligned chunks count for their band and source; alignments without a live chunk count for their tier alone. Distinct
    chunks and standards are counted in two phases, by group and id first, so no task holds the ids of a group.
    """
    a = alignments.where("stale = 0").select("chunk_id", "standard_id", "alignment_score", "alignment_source").withColumn("_a", F.lit(True))
    c = chunks.where("stale = 0").select("chunk_id", "grade_band", "source_id").withColumn("_c", F.lit(True))
    j = c.join(a, "chunk_id", "full_outer")
    sets = j.groupingSets([[F.col(x)] for x in REPORTS], *REPORTS)
    score, aligned = F.col("alignment_score"), F.col("_a").isNotNull()
    # a row that lacks what a set is by (a chunk, an alignment) is dropped with its group of null below
    has_c, has_a = F.count("_c"), F.count("_a")
    live = F.col("_c").isNotNull()
    tiers = ("human", "publisher_guide", "llm_verified", "embedding")

    def over(only: Column, n: str) -> list[Column]:
        s = F.when(only & aligned, score)
        return [
            F.countDistinct(F.when(only, F.col("chunk_id"))).alias(f"{n}chunks"), F.countDistinct(F.when(only & aligned, F.col("standard_id"))).alias(f"{n}standards"), F.count_if(only & aligned & F.col("standard_id").isNotNull()).alias(f"{n}alignments"),
            mean_score(s).alias(f"{n}avg_score"), F.min(s).alias(f"{n}min_score"), F.max(s).alias(f"{n}max_score"), F.count_if(s >= STRONG).alias(f"{n}strong"), F.count_if(only).alias(f"{n}rows"),
            *(F.count_if(only & aligned & (F.col("alignment_source") == t)).alias(f"{n}{t}") for t in tiers),
        ]

    g = sets.agg(F.grouping_id().alias("g"), has_c.alias("has_c"), has_a.alias("has_a"), *over(live, "c_"), *over(aligned, "a_"))
    by_tier_set = F.col("g") == 0b110
    report = F.when(F.col("g") == 0b011, REPORTS[0]).when(F.col("g") == 0b101, REPORTS[1]).otherwise(REPORTS[2])
    value = F.when(F.col("g") == 0b011, F.col(REPORTS[0])).when(F.col("g") == 0b101, F.col(REPORTS[1])).otherwise(F.col(REPORTS[2]))
    names = ("chunks", "standards", "alignments", "avg_score", "min_score", "max_score", "strong", "rows", *tiers)
    out = g.where(F.when(by_tier_set, F.col("has_a") > 0).otherwise(F.col("has_c") > 0))
    out = out.select(report.alias("report"), value.alias("value"), *(F.when(by_tier_set, F.col(f"a_{n}")).otherwise(F.col(f"c_{n}")).alias(n) for n in names))
    return out.withColumn("strong_percent", _r(F.try_divide(100.0 * F.col("strong"), "rows"), 2)).drop("rows")


def checkpoint_probe(probes: DataFrame, alignments: DataFrame, chunks: DataFrame, k: int = 3) -> DataFrame:
    """The k best live chunks by score for each probe standard (standard_id)."""
    order = [F.desc("alignment_score"), "chunk_id"]
    best = best_of_standards(alignments.select("standard_id", "chunk_id", "stale", "alignment_score"), chunks.where("stale = 0").select("chunk_id", "title"), order, k=k)
    named = probes.select("standard_id").distinct().withColumn("question_id", F.col("standard_id"))
    return best_of_questions(named, best, order, k=k).select("standard_id", "rank", "chunk_id", "alignment_score", "title")


def checkpoint_totals(alignments: DataFrame, *, score: float = 0.85) -> DataFrame:
    return alignments.where("stale = 0").agg(F.count("*").alias("alignments"), F.countDistinct("chunk_id").alias("chunks"), F.countDistinct("standard_id").alias("standards"), F.count_if(F.col("alignment_score") >= score).alias("high"))


def acceptance(chunks: DataFrame, embeddings: DataFrame, alignments: DataFrame, *, min_chunks: int = 5000, word: str = "fraction", min_hits: int = 10, min_standards: int = 200, spot: str = "", min_spot: int = 2) -> DataFrame:
    """(name, value, ok, hard) of the acceptance checks of a corpus; empty content, missing attribution and embeddings count
    stale rows too. The corpus passes if all hard checks do: see `passed`."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    text = F.concat_ws(" ", "title", "content")
    c = chunks.agg(
        F.count_if(F.col("stale") == 0).alias("live"), F.count("*").alias("all"), F.count_if(blank("content")).alias("empty"), F.count_if(blank("attribution")).alias("unattributed"),
        F.count_if((F.col("stale") == 0) & F.lower(text).rlike(rf"(?<![\p{{L}}\p{{N}}_]){word}(?![\p{{L}}\p{{N}}_])")).alias("hits"),
    )
    e = embeddings.agg(F.count("*").alias("embedded"))
    a = alignments.where("stale = 0").agg(F.countDistinct("standard_id").alias("standards"), F.count_if(F.col("standard_id") == spot).alias("spot"))
    row = lambda name, value, ok, hard: F.struct(F.lit(name).alias("name"), value.cast("long").alias("value"), ok.alias("ok"), F.lit(hard).alias("hard"))
    v = F.col
    checks = F.array(
        row("live chunks", v("live"), v("live") >= min_chunks, True), row("empty content", v("empty"), v("empty") == 0, True), row("missing attribution", v("unattributed"), v("unattributed") == 0, True),
        row("keyword hits", v("hits"), v("hits") >= min_hits, True), row("embedded", v("embedded"), v("embedded") >= v("all"), False), row("distinct standards", v("standards"), v("standards") >= min_standards, False),
        row("spot standard", v("spot"), v("spot") >= min_spot, False),
    )
    return c.crossJoin(e).crossJoin(a).select(F.inline(checks))


def passed(checks: DataFrame) -> DataFrame:
    return checks.agg(F.bool_and(F.col("ok") | ~F.col("hard")).alias("passed"))


def benchmark_counts(alignments: DataFrame) -> DataFrame:
    """Live alignments of each standard, of the benchmark's coverage query."""
    return alignments.where("stale = 0").groupBy("standard_id").agg(F.count("*").alias("n"))


def benchmark_top(questions: DataFrame, alignments: DataFrame, chunks: DataFrame, *, k: int = 5, source: str | None = None, grade_band: str | None = None) -> DataFrame:
    """The k best chunks for each question by score alone, with the filters of the benchmark's content queries."""
    c = chunks.where("stale = 0")
    c = c.where(F.col("source_id") == source) if source is not None else c
    c = c.where(F.col("grade_band") == grade_band) if grade_band is not None else c
    order = [F.desc("alignment_score"), "chunk_id"]
    best = best_of_standards(alignments.select("standard_id", "chunk_id", "stale", "alignment_score"), c.select("chunk_id", "title"), order, k=k)
    return best_of_questions(questions.select("question_id", "standard_id"), best, order, k=k).select("question_id", "rank", "chunk_id", "title", "alignment_score")


def benchmark_inventory(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """Live chunks of every source, also of those without any."""
    return sources.select("source_id").distinct().join(chunks.where("stale = 0").groupBy("source_id").agg(F.countDistinct("chunk_id").alias("n")), "source_id", "left").select("source_id", F.coalesce("n", F.lit(0)).alias("chunks"))


def validation_report(chunks: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """For each source (of `sources`, else those that chunks have): chunks by type, blank contents and attributions, how many
    have a grade, level, answer and standard (`standards`, a number), errors and warnings; `ok` without errors."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    have = lambda c: (F.count_if(~blank(c)) if c in chunks.columns else F.lit(0).cast("long"))
    types = [F.count_if(F.col("content_type") == t).alias(t) for t in ("exposition", "worked_example", "exercise_set", "summary", "assessment")]
    n = chunks.groupBy("source_id").agg(
        F.count("*").alias("chunks"), *types, F.count_if(blank("content")).alias("empty"), (F.count("*") - have("attribution")).alias("unattributed"), F.count("grade_band").alias("graded"),
        F.count("dok_level").alias("with_dok"), have("answer_key").alias("with_answer"), (F.count_if(F.col("standards") > 0) if "standards" in chunks.columns else F.lit(0).cast("long")).alias("with_standard"),
    )
    n = n if sources is None else sources.select("source_id").distinct().join(n, "source_id", "left").na.fill(0)
    some = lambda c, text: F.when(c, text)
    said = lambda *x: F.array_join(F.filter(F.array(*x), lambda e: e.isNotNull()), "; ")
    c = F.col
    errors = said(some(c("chunks") == 0, "no chunks produced"), some(c("empty") > 0, F.concat(c("empty").cast("string"), F.lit(" with empty content"))), some(c("unattributed") > 0, F.concat(c("unattributed").cast("string"), F.lit(" with empty attribution"))))
    warnings = said(some((c("chunks") > c("assessment")) & (c("exposition") == 0), "no exposition chunks"), some((c("assessment") > 0) & (c("chunks") > c("with_standard")), F.concat((c("chunks") - c("with_standard")).cast("string"), F.lit(" items without standard alignment"))))
    return n.withColumn("errors", errors).withColumn("warnings", warnings).withColumn("ok", F.col("errors") == "")
