"""Corpus pipeline: quality classifier, line dedup, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes every
stage to the shared folder and reads it again, so a lost executor costs one stage.

All stages but the last return the columns of documents; ``text`` is what remains and
``n_chars`` its length. A stage sees only what its predecessor kept. Null texts pass
as empty ones, rows with a null ``doc_id`` are kept by every filter, and repeated rows
stay repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from terrachron.llm import common, lines, packing, perplexity, queries, shingles, substring
from terrachron.session import work_path

#: Smaller blocks than the classifier alone takes: workers are used again by the later stages and keep their memory.
BLOCK_CHARS, MEMORY_WORDS = 12_000_000, 150_000
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the perplexity classifier does not reject."""
    verdicts = perplexity.classify(docs, queries.table(spark, sf_dir, "labels"), block_chars=BLOCK_CHARS, memory_words=MEMORY_WORDS)
    rejected = verdicts.where(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(common.small(rejected), "doc_id", "left_anti").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source."""
    return lines.deduplicate(docs.select(*COLUMNS), keep=["lang", "source"]).select(
        "doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars")
    )


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest ``doc_id``: five-word shingles, similarity 0.8 or more."""
    return shingles.keep_one(docs.select(*COLUMNS)).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand earlier in the corpus."""
    kept = substring.deduplicate(docs, layout=True, keep=["lang", "source"])
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in training sequences."""
    return packing.pack(docs, queries.vocabulary())


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", pack),
]

#: SQL cannot express the language model, the components or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
