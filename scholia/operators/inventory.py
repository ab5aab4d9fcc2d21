"""What the corpus holds: inventory by source, capabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def source_inventory(chunks: DataFrame, alignments: DataFrame) -> DataFrame:
    """For each partition and source: books, live chunks, grade bands, aligned standards; children are aggregated before they join."""
    live = chunks.where("stale = 0")
    own = chunks.groupBy("part", "source_id").agg(F.countDistinct("book_id").alias("books"))
    held = live.groupBy("part", "source_id").agg(F.count("*").alias("chunks"), F.array_join(F.sort_array(F.collect_set("grade_band")), ",").alias("grade_bands"))
    std = alignments.where("stale = 0").join(live.select("chunk_id", "part", "source_id"), "chunk_id").groupBy("part", "source_id").agg(F.countDistinct("standard_id").alias("standards"), F.count("*").alias("alignments"))
    out = own.join(held, ["part", "source_id"], "left").join(std, ["part", "source_id"], "left")
    return out.select("part", "source_id", "books", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("grade_bands", F.lit("")).alias("grade_bands"), F.coalesce("standards", F.lit(0)).alias("standards"), F.coalesce("alignments", F.lit(0)).alias("alignments"))


def capabilities(chunks: DataFrame, alignments: DataFrame) -> DataFrame:
    """Totals overall (part 'all') and for each partition, by one rollup."""
    live = chunks.where("stale = 0")
    c = live.rollup("part").agg(F.count("*").alias("chunks"), F.countDistinct("source_id").alias("sources"), F.countDistinct("grade_band").alias("grade_bands"), F.countDistinct("exam_series").alias("exams"), F.count("exam_series").alias("exam_items"))
    a = alignments.where("stale = 0").join(live.select("chunk_id", "part"), "chunk_id").rollup("part").agg(
        F.count("*").alias("alignments"), F.countDistinct("standard_id").alias("standards"), F.countDistinct("standard_system").alias("systems"),
        *[F.count_if(F.col("alignment_source") == t).alias(t) for t in ("human", "publisher_guide", "llm_verified", "embedding")],
    )
    all_ = F.coalesce("part", F.lit("all")).alias("part")
    return c.select(all_, *c.columns[1:]).join(a.select(all_, *a.columns[1:]), "part", "left").na.fill(0)


def items_per_exam(chunks: DataFrame) -> DataFrame:
    return chunks.where("stale = 0 and exam_series is not null").groupBy("part", "exam_series").agg(F.count("*").alias("items"))
