"""A training corpus from raw documents: stages that each read what the one before has written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gradus.llm import decontaminate, exact_dedup, minmax, mixing, quality
from gradus.llm.common import table
from gradus.session import remove, run_folder, scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from ``labels``."""
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five words, similarity 0.8) the document with the smallest id."""
    return minmax.deduplicate(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ``benchmark``."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources have their weights, in a global random order."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", classify),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("source_mix", mix_sources),
]

#: The classifier and the links of near copies can't be said in SQL; tests hold the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage has written; the outputs of the stages before it are removed once read."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"corpus-{name}")
        with run_folder(spark):  # what the stage writes for itself goes with it
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        if before is not None:
            remove(spark, before)
        docs, before = spark.read.schema(out.schema).parquet(path), path
    return docs
