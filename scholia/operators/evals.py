"""Preference evaluation: contexts, blind pairs, parsing, win rates, scenario checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAIRS = (("content", "standards"), ("content", "nothing"), ("standards", "nothing"))


def context(top: DataFrame, limit: int = 900) -> DataFrame:
    """One text for each question from its ranked content (question_id, rank, content, attribution)."""
    item = F.struct("rank", F.concat(F.substring(F.coalesce("content", F.lit("")), 1, limit), F.lit("\n["), F.coalesce("attribution", F.lit("")), F.lit("]")).alias("text"))
    return top.groupBy("question_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["text"]), "\n\n").alias("context"))


def judge_reference(standards: DataFrame) -> DataFrame:
    """What a judge is told of a standard, with a fallback where there is no text."""
    return standards.select("standard_id", F.coalesce(F.concat("standard_id", F.lit(": "), "standard_text"), F.concat(F.lit("Standard "), "standard_id")).alias("reference"))


def build_pairs(topics: DataFrame, *, seed: int = 7, pairs: tuple[tuple[str, str], ...] = PAIRS) -> DataFrame:
    """Every topic (topic) with each pair of conditions, in a blind order that a hash of seed, topic and pair sets."""
    names = F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right")) for a, b in pairs])
    t = topics.select("topic", F.explode(names).alias("p"))
    swap = F.pmod(F.xxhash64(F.lit(seed), "topic", "p.left", "p.right"), F.lit(2)) == 1
    return t.select("topic", "p.left", "p.right", F.when(swap, F.col("p.right")).otherwise(F.col("p.left")).alias("a"), F.when(swap, F.col("p.left")).otherwise(F.col("p.right")).alias("b"))


def parse_preference(text: Column) -> Column:
    """A, B or TIE: the first run of letters if it is one of them, else the word TIE anywhere, else the first lone A or B; else null."""
    t = F.upper(F.trim(F.coalesce(text, F.lit(""))))
    first, lone = F.regexp_extract(t, "[A-Z]+", 0), F.regexp_extract(t, r"\b([AB])\b", 1)
    return F.when(first.isin("A", "B", "TIE"), first).when(t.rlike(r"\bTIE\b"), "TIE").otherwise(F.nullif(lone, F.lit("")))


def winner(pref: Column, a: Column, b: Column) -> Column:
    """The condition that won, tie, or null."""
    return F.when(pref == "A", a).when(pref == "B", b).when(pref == "TIE", "tie")


def win_rates(comparisons: DataFrame, *, target: float = 0.60) -> DataFrame:
    """Wins of `left` over `right` (left, right, winner: one of both, tie or null): rate over decisive ones, null without any."""
    w = F.col("winner")
    g = comparisons.groupBy("left", "right").agg(F.count_if(w == F.col("left")).alias("wins"), F.count_if(w == F.col("right")).alias("losses"), F.count_if(w == "tie").alias("ties"), F.count_if(w.isNull()).alias("unparsed"))
    rate = F.round(F.try_divide(F.col("wins").cast("double"), F.col("wins") + F.col("losses")), 3)
    return g.withColumn("win_rate", rate).withColumn("target_met", F.coalesce(rate >= target, F.lit(False)))


def check_scenarios(results: DataFrame) -> DataFrame:
    """(scenario, ok, reason) of results (scenario, expected_tools, called_tools, min_calls, phrases, answer): first failure."""
    missing = F.array_except("expected_tools", "called_tools")
    absent = F.filter("phrases", lambda p: ~F.contains(F.lower(F.coalesce("answer", F.lit(""))), F.lower(p)))
    reason = F.when(F.size(missing) > 0, F.concat(F.lit("tools not called: "), F.array_join(F.sort_array(missing), ", "))).when(F.size("called_tools") < F.col("min_calls"), "too few calls").when(F.size(absent) > 0, F.concat(F.lit("phrase missing: "), absent[0]))
    return results.select("scenario", reason.isNull().alias("ok"), F.coalesce(reason, F.lit("ok")).alias("reason"))


def parse_grade(text: Column) -> Column:
    """YES, PARTIAL or NO at the start of an answer; else ERR."""
    t = F.upper(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(t.startswith("YES"), "YES").when(t.startswith("PARTIAL"), "PARTIAL").when(t.startswith("NO"), "NO").otherwise("ERR")


def tally(graded: DataFrame) -> DataFrame:
    """Passes of graded answers (grade)."""
    g = F.col("grade")
    n = graded.agg(F.count("*").alias("n"), F.count_if(g == "YES").alias("passed"), F.count_if(g == "PARTIAL").alias("partial"), F.count_if(g == "NO").alias("failed"), F.count_if(g == "ERR").alias("errors"))
    return n.withColumn("pass_rate", F.round(F.try_divide(F.col("passed").cast("double"), F.col("n")), 3))


def head_to_head(compared: DataFrame) -> DataFrame:
    """Tally of two systems over scenarios (a_ok, b_ok: passed without a judge; answer of a judge or null): wins of each, ties,
    and passes. An answer's first line decides by how it begins; one that begins otherwise is a tie; no answer, no match."""
    line = F.upper(F.get(F.filter(F.transform(F.split("answer", r"\R"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0)))
    won = F.when(F.col("answer").isNotNull(), F.when(line.startswith("B"), "B").when(line.startswith("A"), "A").otherwise("TIE"))
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return compared.select("a_ok", "b_ok", won.alias("w")).agg(count(F.col("w") == "A").alias("a_wins"), count(F.col("w") == "B").alias("b_wins"), count(F.col("w") == "TIE").alias("ties"), count(F.col("a_ok")).alias("a_passed"), count(F.col("b_ok")).alias("b_passed"), F.count("*").alias("n"))
