"""The corpus pipeline: language, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the columns
of documents, whatever they are beside doc_id, text, lang and source; columns that a stage needs for itself get names that
are not taken. Defined results: an empty table stays empty through all stages; a null or empty text has no letter and goes
with the first stage; rows that share a doc_id are one document from the second stage on, the row with the smallest hash of all its
columns (so the same one in every run), rows without doc_id all stay;
a very long text is one document like any other, only the last stage cuts it. `run` writes each stage as Parquet in the shared folder and rereads it for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholia.llm.language import identify_languages, learn
from scholia.llm.mixing import mix_sources
from scholia.llm.near_dup import near_duplicates
from scholia.llm.packing import pack
from scholia.llm.pii import redact_pii
from scholia.llm.store import Stored


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that `docs` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose language can't be told: those without a letter."""
    predicted, score = _unused(docs, "_predicted"), _unused(docs, "_score")
    return identify_languages(docs, learn(docs), (predicted, score)).where(F.col(predicted) != "und").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8); rows without doc_id stay."""
    kept = near_duplicates(docs.select("doc_id", "text"), width=5, percent=80).where("kept and doc_id is not null").select("doc_id")
    n = _unused(docs, "_n")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64(*docs.columns), F.xxhash64(F.lit(1), *docs.columns)))
    one = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").withColumn(n, first).where(F.col(n) == 1).select(*docs.columns)
    return one.unionByName(docs.where("doc_id is null"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return redact_pii(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; those that it leaves out go."""
    row = [_unused(docs, "_row_a"), _unused(docs, "_row_b")]  # 128 bits: no two rows of a corpus are taken for one
    times, copy = _unused(docs, "_times"), _unused(docs, "_copy")
    keyed = docs.withColumn(row[0], F.xxhash64(*docs.columns)).withColumn(row[1], F.xxhash64(F.lit(1), *docs.columns))
    plan = mix_sources(keyed.select("doc_id", "text", "source", *row), carry=tuple(row))
    # equal rows are told apart by nothing: together they stand as often as all of them are taken
    wanted = plan.where("copies > 0").groupBy(*row).agg(F.sum("copies").alias(times))
    taken = keyed.join(wanted, row).dropDuplicates(row)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 1024 tokens."""
    return pack(docs, special=True)


STAGES = [("language", language), ("near_dedup", near_dedup), ("pii", personal_data), ("mixing", mixing), ("packing", packing)]

#: Cross-parsing, balanced sampling and packing are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed corpus of `documents` in sf_dir."""
    store = Stored(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = store.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
