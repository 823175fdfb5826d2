"""The corpus pipeline: five stages, each one of the operators, reading what its predecessor wrote.

Every stage but the last returns the columns of documents and works on all that came to it. A stage
takes (spark, docs, sf_dir); ``run`` writes each result to the shared folder before the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableinsight.llm import decontaminate, near_dup, source_mix, token_store, toxicity
from tableinsight.llm.catalog import tokenizer_path
from tableinsight.llm.common import fold, read, scratch, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; labels teach only from two folds of three."""
    train = docs.filter(fold(F.col("doc_id"), 3) != 1)
    return toxicity.reject(docs, toxicity.learn(train, read(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_dup.one_of_each(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages they share with the benchmark."""
    return decontaminate.cut_passages(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; where a pass ends in one, its leading words."""
    return source_mix.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in directly addressable codes; what is returned is read back from the files."""
    return token_store.read_tokens(token_store.write_tokens(docs, tokenizer_path()))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]

ORACLE_SQL = None  # a trained model and a tokenizer are not SQL; the tests hold it against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage wrote on its way is deleted once its result is stored."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as written:
            docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
            written.pop()  # the result itself
    return STAGES[-1][1](spark, docs, sf_dir)
