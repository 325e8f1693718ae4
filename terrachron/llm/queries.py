"""One query per operator over the given tables, with checking SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from terrachron.llm import binary_search, bpe, common, language, lexical, lines, negatives, packing, perplexity, pieces, quality, simhash, substring, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(build):
        QUERIES[name] = build
        if sql:
            ORACLE[name] = sql
        return build

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary() -> str:
    """Where the public vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op3_bpe")
def op3_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(table(spark, folder, "documents"), vocabulary())


@query("op6_packing")
def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), vocabulary())


@query("op4_simhash")
def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query("op8_substring")
def op8_substring(spark: SparkSession, folder: str) -> DataFrame:
    kept = substring.deduplicate(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op1_quality_rules", quality.sql())
def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.measure(table(spark, folder, "documents")).drop("clean_text")


@query("op5_line_dedup", lines.sql())
def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = lines.deduplicate(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op2_language_id")
def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language.train(docs.where(~common.held_out("doc_id")))
    found = language.spans(docs, model)
    return found.select(
        "doc_id", common.held_out("doc_id").alias("held_out"), F.col("lang").alias("lang_pred"), "score", F.size("spans").alias("n_spans")
    )


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    parameters = toxicity.train(docs.where(~common.held_out("doc_id")), labels.where(~common.held_out("doc_id")))
    found = toxicity.score(docs, parameters)
    return found.select("doc_id", common.held_out("doc_id").alias("held_out"), "score", "predicted", "n_windows")


@query("op7_perplexity")
def op7_perplexity(spark: SparkSession, folder: str) -> DataFrame:
    return perplexity.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op10_top_k", binary_search.sql())
def op10_top_k(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return binary_search.top_k(rows, rows.where("vec_id % 20 = 0"))


@query("pipeline")
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


@query("op12_lexical", lexical.sql())
def op12_lexical(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.rank(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op13_hard_negatives", negatives.sql())
def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, folder, "embeddings"), lambda i: i % 100 == 0, label)


def piece_model() -> str:
    """Where the public SentencePiece model lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op11_sentencepiece")
def op11_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.digests(table(spark, folder, "documents"), piece_model())
