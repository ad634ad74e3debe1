"""A corpus pipeline out of the training-data operators: STAGES, and run() that applies them to documents.

Each stage takes the rows that its predecessor kept and returns rows with the columns of documents; the last one returns the
index of the shards that it wrote. Stages read and write whole rows and texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import decontaminate, langid, mixing, simhash_wide, training_order
from cairn.llm.common import Scratch, fresh, is_held_out

#: A document goes if its language is undetermined or less likely than this.
LEAST_LANGUAGE_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or without a likely language go."""
    model = langid.fit(langid.learnable(docs, is_held_out()))
    language, likely = fresh(docs, "__language", "__likely")
    seen = langid.predict(docs, model, out=(language, likely))
    return seen.filter((F.col(language) != "und") & (F.col(likely) >= LEAST_LANGUAGE_SCORE)).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays: texts that SimHash candidates of a five-word Jaccard similarity of 0.8 or more join."""
    return simhash_wide.deduplicate(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain an item of benchmark go."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix of sources takes it."""
    return mixing.apply(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in training order, written as binary shards; one index row a sequence."""
    return training_order.materialise(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mix", source_mix),
    ("token_output", token_output),
]

#: SQL can't express these stages; tests/llm hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written as Parquet and read again by the next."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        docs = scratch.cut(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return STAGES[-1][1](spark, docs, sf_dir)
