"""One thin query per operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableinsight.llm import (
    decontaminate,
    importance,
    language,
    licenses,
    line_runs,
    near_dup,
    secrets,
    source_mix,
    token_store,
    toxicity,
    url_filter,
    vector_index,
    whitening,
)
from tableinsight.llm.common import fold, read

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the environment keeps a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = language.learn(docs.filter(~held_out).filter("lang is not null"))
    return language.identify(docs, model).withColumn("held_out", fold(F.col("doc_id"), 4) == 2)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = line_runs.dedup_lines(read(spark, sf_dir, "documents"))
    digest = F.sha2(F.col("kept").cast("binary"), 256)
    return lines.select("doc_id", "n_lines", "n_dropped", digest.alias("kept_sha256"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return token_store.read_tokens(token_store.write_tokens(docs, tokenizer_path()))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = source_mix.mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.near_duplicates(read(spark, sf_dir, "documents"))
    kept = F.coalesce(F.col("doc_id") == F.col("class_id"), F.col("class_id").isNull())
    return found.select("doc_id", "class_id", "n_class", "n_links", kept.alias("kept"))


def op6_vector_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_index.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(read(spark, sf_dir, "documents")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = fold(F.col("doc_id"), 3) == 1
    model = toxicity.learn(docs.filter(~held_out), labels)
    predicted = (F.col("_score") >= toxicity.THRESHOLD).cast("int")
    return toxicity.scored(docs.select("doc_id", "text"), model, keep_text=False).select(
        "doc_id", held_out.alias("held_out"), F.col("_score").alias("score"),
        predicted.alias("predicted"), F.col("_sentences").alias("sentences"),
    )


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(
        read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    )
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated"
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(read(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return ranked.select("doc_id", "n_features", "weight", "score", "rank")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


QUERIES = (
    op1_language, op2_line_dedup, op3_token_store, op4_source_mix, op5_near_dup, op6_vector_index, op7_secrets, op8_toxicity, op9_decontaminate, op10_url_filter,
    op11_importance, op12_whitening, op13_licenses,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in QUERIES}
