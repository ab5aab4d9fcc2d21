"""Idempotent merges: every job returns the merged table and touches nothing.

Conflicts are decided by aggregates or by one row_number over the key; texts never are sort keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions.standards import tier_rank
from scholia.sources.columns import item_id
from scholia.sources.corpus import stored


def merge_by_key(old: DataFrame, new: DataFrame, key: list[str], *, keep: tuple[str, ...] = ()) -> DataFrame:
    """Old and new rows by key: a new row replaces an old one, null values too, but for the columns in `keep`.

    Adds `_change`: added, updated or kept."""
    cols = [c for c in old.columns if c not in key]
    o = old.select(*key, F.struct(*cols).alias("o"))
    n = new.select(*key, F.struct(*cols).alias("n"))
    j = o.join(n, key, "full_outer")
    has = F.col("n").isNotNull()
    pick = [F.when(has & (F.col("o").isNull() | F.lit(c not in keep)), F.col("n")[c]).otherwise(F.col("o")[c]).alias(c) for c in cols]
    change = F.when(~has, "kept").when(F.col("o").isNull(), "added").otherwise("updated")
    return j.select(*key, *pick, change.alias("_change"))


def change_counts(merged: DataFrame) -> DataFrame:
    return merged.agg(F.count_if(F.col("_change") == "added").alias("added"), F.count_if(F.col("_change") == "updated").alias("updated"), F.count_if(F.col("_change") == "kept").alias("kept"))


def upsert_catalogue(old: DataFrame, new: DataFrame, *, fixed: tuple[str, ...] = ("source_id", "subject")) -> DataFrame:
    """Sources or books by id; a known book keeps its source and subject."""
    return merge_by_key(old, new, ["id"], keep=tuple(c for c in fixed if c in old.columns))


def upsert_chunks(old: DataFrame, new: DataFrame, *, now: str) -> DataFrame:
    """Chunks by chunk_id: new values win, also nulls; created_at stays; stale is 0 again; the hash and last_verified follow."""
    new = new.withColumn("content_hash", F.sha2(F.coalesce("content", F.lit("")), 256)).withColumn("last_verified", F.lit(now)).withColumn("created_at", F.lit(now)).withColumn("stale", F.lit(0))
    return merge_by_key(old, new, ["chunk_id"], keep=("created_at",))


def inherit_grades(chunks: DataFrame, books: DataFrame) -> DataFrame:
    """A chunk without a grade band takes its book's."""
    b = books.select(F.col("id").alias("book_id"), F.col("grade_band").alias("_band"))
    return chunks.join(b, "book_id", "left").withColumn("grade_band", F.coalesce("grade_band", "_band")).drop("_band")


def attach_snapshots(chunks: DataFrame, snapshots: DataFrame, pattern: str = r"^(.*?-[^-]+-[^-]+)-[^-]+$") -> DataFrame:
    """The snapshot path of every chunk, by an equi-join on the part of its id that names the raw record (prefix, path)."""
    keyed = chunks.withColumn("prefix", F.regexp_extract("chunk_id", pattern, 1))
    return keyed.join(snapshots, "prefix", "left").drop("prefix").withColumnRenamed("path", "snapshot_path")


def merge_alignments(arrivals: DataFrame) -> DataFrame:
    """One row for each (chunk_id, standard_id) of all arrivals (with `arrival` as their order): a pair whose first row was
    verified by a person keeps it; else the highest tier wins, and among those the last to arrive."""
    key = Window.partitionBy("chunk_id", "standard_id")
    first = F.row_number().over(key.orderBy("arrival"))
    ranked = arrivals.withColumn("_frozen", (first == 1) & F.coalesce(F.col("verified_by_human") == 1, F.lit(False)))
    best = F.row_number().over(key.orderBy(F.desc("_frozen"), tier_rank(F.col("alignment_source")).desc(), F.desc("arrival")))
    return ranked.withColumn("_n", best).where("_n = 1").drop("_n", "_frozen")


def merge_tiers(arrivals: DataFrame) -> DataFrame:
    """The highest tier of each pair, then the last arrival, by one aggregate without a sort (no frozen pairs)."""
    rank = F.struct(tier_rank(F.col("alignment_source")).alias("t"), "align_id", "alignment_score", F.coalesce("coverage_notes", F.lit("")).alias("n"))
    value = F.struct("standard_system", "alignment_score", "alignment_source", "coverage_notes", "stale", "align_id")
    return arrivals.groupBy("chunk_id", "standard_id").agg(F.max_by(value, rank).alias("v")).select("chunk_id", "standard_id", "v.*")


def realign(old: DataFrame, computed: DataFrame, *, flag: float = 0.78) -> DataFrame:
    """Computed cosine alignments merged into the table: pairs of tier human stay; others take score and flag and are live
    again but keep their tier and notes; new pairs come in as embedding."""
    o = old.select("chunk_id", "standard_id", F.struct("alignment_score", "alignment_source", "coverage_notes", "stale").alias("o"))
    n = computed.select("chunk_id", "standard_id", F.struct("alignment_score", "flagged").alias("n"))
    j = o.join(n, ["chunk_id", "standard_id"], "full_outer")
    human = F.coalesce(F.col("o.alignment_source") == "human", F.lit(False))
    take = F.col("n").isNotNull() & ~human
    return j.select(
        "chunk_id", "standard_id", F.when(take, F.col("n.alignment_score")).otherwise(F.col("o.alignment_score")).alias("alignment_score"),
        F.coalesce(F.col("o.alignment_source"), F.lit("embedding")).alias("alignment_source"), F.col("o.coverage_notes").alias("coverage_notes"),
        F.when(take, 0).otherwise(F.col("o.stale")).cast("int").alias("stale"), F.when(take, F.col("n.flagged")).alias("flagged"),
    )


def check_verdicts(verdicts: DataFrame) -> DataFrame:
    """The verdicts; one that is neither verified nor reject raises."""
    known = F.col("verdict").isin("verified", "reject")
    return verdicts.where(F.when(F.coalesce(known, F.lit(False)), True).otherwise(F.raise_error(F.concat(F.lit("unknown verdict: "), F.coalesce("verdict", F.lit("null")))).cast("boolean")))


def apply_verdicts(alignments: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Verified pairs become llm_verified with the note unless human or publisher; rejected ones of any tier go stale."""
    v = check_verdicts(verdicts).groupBy("chunk_id", "standard_id").agg(F.max_by(F.struct("verdict", "note"), F.struct("verdict", "note")).alias("v"))
    j = alignments.join(v, ["chunk_id", "standard_id"], "left")
    up = (F.col("v.verdict") == "verified") & ~F.col("alignment_source").isin("human", "publisher_guide")
    down = F.col("v.verdict") == "reject"
    return (
        j.withColumn("alignment_source", F.when(up, "llm_verified").otherwise(F.col("alignment_source")))
        .withColumn("coverage_notes", F.when(up | down, F.col("v.note")).otherwise(F.col("coverage_notes")))
        .withColumn("stale", F.when(down, 1).when(up, 0).otherwise(F.col("stale")).cast("int"))
        .drop("v")
    )


def verdict_counts(alignments: DataFrame, verdicts: DataFrame) -> DataFrame:
    keys = alignments.select("chunk_id", "standard_id").distinct().withColumn("_hit", F.lit(True))
    j = check_verdicts(verdicts).join(keys, ["chunk_id", "standard_id"], "left")
    hit = F.col("_hit").isNotNull()
    return j.agg(F.count_if(hit & (F.col("verdict") == "verified")).alias("verified"), F.count_if(hit & (F.col("verdict") == "reject")).alias("rejected"), F.count_if(~hit).alias("missing"))


def insert_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The new rows whose key the old table lacks."""
    return new.join(old.select(key), key, "left_anti")


def upsert_crosswalk(old: DataFrame, new: DataFrame) -> DataFrame:
    """Crosswalk rows by standard prefix and exam."""
    return merge_by_key(old, new, ["standard_id", "exam_series"])


def insert_items(chunks: DataFrame, items: DataFrame, *, score: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """Chunks and publisher alignments of the items (style, standard_id, exam_series, item_type, dok_level, difficulty,
    grade_band, question, answer_key) that the chunks don't have yet; an unknown exam series raises."""
    new = items.withColumn("family", series_family(F.col("exam_series"))).withColumn("chunk_id", F.concat_ws("-", "family", item_id(F.col("style"), F.col("standard_id"), F.col("question"))))
    new = insert_absent(chunks, new.dropDuplicates(["chunk_id"]), "chunk_id")
    rows = new.select("chunk_id", F.concat("family", F.lit("-items")).alias("book_id"), F.concat_ws(": ", "exam_series", "standard_id").alias("title"), F.col("question").alias("content"), F.lit("assessment").alias("content_type"), "item_type", "dok_level", "answer_key", "exam_series", "difficulty", "grade_band", F.lit("style_generated").alias("item_generation"), F.lit(0).alias("stale"))
    return rows, new.select("chunk_id", "standard_id", F.lit(score).alias("alignment_score"), F.lit("publisher_guide").alias("alignment_source"))


def series_family(series):
    """Slug of an exam series' family; unknown series raise."""
    return (
        F.when(series.isin("SAT", "ACT"), F.lower(series)).when(series.startswith("Smarter Balanced"), "smarter-balanced").when(series.startswith("NAEP"), "naep")
        .otherwise(F.raise_error(F.concat(F.lit("unknown exam series: "), F.coalesce(series, F.lit("null")))))
    )


def run_record(source_id: str, counts: DataFrame, warnings: DataFrame, *, run_date: str) -> DataFrame:
    """One row for the run log: counts, and the warnings (column warning) as a JSON array."""
    w = warnings.agg(F.to_json(F.sort_array(F.collect_list("warning"))).alias("warnings"))
    return counts.crossJoin(w).select(F.lit(run_date).alias("run_date"), F.lit(source_id).alias("source_id"), *counts.columns, "warnings", F.lit(1).alias("completed"))


def split_by_licence(books: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks with the partition that their book's licence asks for: core books with NC in the licence are ncsa."""
    b = books.select(F.col("id").alias("book_id"), F.col("license").like("%NC%").alias("_nc"))
    moved = (F.col("part") == "core") & F.coalesce(F.col("_nc"), F.lit(False))
    return chunks.join(b, "book_id", "left").withColumn("new_part", F.when(moved, "ncsa").otherwise(F.col("part"))).drop("_nc")


def split_counts(split: DataFrame) -> DataFrame:
    """Chunks before and after by partition."""
    s = split.select(F.explode(F.array(F.struct(F.col("part").alias("p"), F.lit(1).alias("b"), F.lit(0).alias("a")), F.struct(F.col("new_part").alias("p"), F.lit(0).alias("b"), F.lit(1).alias("a")))).alias("x"))
    return s.groupBy(F.col("x.p").alias("part")).agg(F.sum("x.b").alias("before"), F.sum("x.a").alias("after"))


def integrity(chunks: DataFrame, alignments: DataFrame, standards: DataFrame, types: tuple[str, ...], tiers: tuple[str, ...]) -> DataFrame:
    """(check, violations) of keys, references, vocabularies and ranges.

    Chunks and alignments are read once, into one narrow stored table of (chunk, part) and (chunk, standard) with what is
    wrong with their rows; the checks of keys and references are sums over that.
    """
    wrong = lambda ok: F.when(F.coalesce(ok, F.lit(False)), 0).otherwise(1)
    none = F.lit(0)
    c = chunks.select(F.lit(True).alias("is_chunk"), "chunk_id", F.col("part").alias("of"), wrong(F.col("content_type").isin(*types)).alias("bad_type"), none.alias("bad_tier"), none.alias("bad_score"))
    a = alignments.select(F.lit(False).alias("is_chunk"), "chunk_id", F.col("standard_id").alias("of"), none.alias("bad_type"), wrong(F.col("alignment_source").isin(*tiers)).alias("bad_tier"), wrong(F.col("alignment_score").between(0, 1)).alias("bad_score"))
    keys = stored(c.unionByName(a).groupBy("is_chunk", "chunk_id", "of").agg(F.count("*").alias("n"), *(F.sum(x).alias(x) for x in ("bad_type", "bad_tier", "bad_score"))))
    n, is_chunk = F.col("n"), F.col("is_chunk")
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    own = keys.agg(F.count_if(is_chunk & (n > 1)).alias("dup_c"), F.count_if(~is_chunk & (n > 1)).alias("dup_a"), *(total(x).alias(x) for x in ("bad_type", "bad_tier", "bad_score")))
    by_chunk = keys.groupBy("chunk_id").agg(F.max("is_chunk").alias("known"), F.sum(F.when(~is_chunk, n)).alias("n"))
    by_chunk = by_chunk.agg(total(F.when(~F.col("known") | F.col("chunk_id").isNull(), n)).alias("no_chunk"))
    by_standard = keys.where(~is_chunk).groupBy(F.col("of").alias("standard_id")).agg(F.sum("n").alias("n"))
    by_standard = by_standard.join(standards.select("standard_id"), "standard_id", "left_anti").agg(total("n").alias("no_standard"))
    named = {"duplicate chunk": "dup_c", "duplicate alignment": "dup_a", "alignment without chunk": "no_chunk", "alignment without standard": "no_standard", "content type": "bad_type", "tier": "bad_tier", "score": "bad_score"}
    # three rows of sums side by side
    out = own.crossJoin(by_chunk).crossJoin(by_standard)
    return out.select(F.inline(F.array(*[F.struct(F.lit(k).alias("check"), F.col(v).cast("long").alias("violations")) for k, v in named.items()])))


def changes_by_hash(old: DataFrame, new: DataFrame) -> DataFrame:
    """(chunk_id, change) of two versions of a corpus (chunk_id, content_hash): new, changed, same or gone."""
    j = old.select("chunk_id", F.col("content_hash").alias("o")).join(new.select("chunk_id", F.col("content_hash").alias("n")), "chunk_id", "full_outer")
    return j.select("chunk_id", F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "gone").when(F.col("o") == F.col("n"), "same").otherwise("changed").alias("change"))
