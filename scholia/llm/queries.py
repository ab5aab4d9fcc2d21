"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm.embed_dup import near_duplicate_vectors
from scholia.llm.html_text import extract_text
from scholia.llm.language import language_id
from scholia.llm.licences import oracle as licence_sql
from scholia.llm.licences import scan_licences
from scholia.llm.mixing import mix_sources
from scholia.llm.near_dup import near_duplicates
from scholia.llm.packing import pack
from scholia.llm.pii import find_pii
from scholia.llm.prefix_trie import oracle as trie_sql
from scholia.llm.prefix_trie import prefix_trie
from scholia.llm.quality import quality
from scholia.llm.search import oracle as search_sql
from scholia.llm.search import top_k
from scholia.llm.toxicity import toxicity
from scholia.llm.whitening import whiten

#: Documents that are searched for in one pass over the corpus.
DOCUMENT_QUERIES = 8192


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences in all documents."""
    return scan_licences(_read(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents."""
    return language_id(_read(spark, sf_dir, "documents"))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents (itself among them) for every document whose id is divisible by 20."""
    docs = _read(spark, sf_dir, "documents")
    found = top_k(docs, docs.where("doc_id % 20 = 0").selectExpr("doc_id as query_id", "text"), 10, at_once=DOCUMENT_QUERIES, batched=True)
    return found.withColumn("score", F.round("score", 6))


def passage_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents for every benchmark passage."""
    found = top_k(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark").selectExpr("item_id as query_id", "text"), 10)
    return found.withColumn("score", F.round("score", 6))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixes all documents so that the sources weigh 1, 2, 3, repeating."""
    return mix_sources(_read(spark, sf_dir, "documents"))


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of all vectors of a label: cosine 0.93."""
    return near_duplicate_vectors(_read(spark, sf_dir, "embeddings"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of all documents: 2-word shingles, similarity 0.8."""
    return near_duplicates(_read(spark, sf_dir, "documents"), width=2, percent=80)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of 1024 tokens."""
    return pack(_read(spark, sf_dir, "documents"), special=True)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return find_pii(_read(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    return quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract_text(_read(spark, sf_dir, "pages"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations."""
    return prefix_trie(_read(spark, sf_dir, "conversations"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors on the 32 first whitened components."""
    return whiten(_read(spark, sf_dir, "embeddings"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    return toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_embedding_near_dedup, op2_minhash_near_dedup, op3_best_fit_packing, op4_license_scan, op5_language_id, op6_exact_topk, op7_mix_sources, op8_pii, op9_quality, op10_html_extraction, op11_prefix_trie, op12_embedding_whitening, op13_toxicity, passage_topk)}


def oracle_sql() -> dict[str, str]:
    return {"op4_license_scan": licence_sql(), "op6_exact_topk": search_sql(10, "documents", "doc_id", "doc_id % 20 = 0"), "op11_prefix_trie": trie_sql(), "passage_topk": search_sql(10)}
