"""The corpus pipeline: five stages from the llm operators, each over all that the one before kept.

Every stage takes and returns the columns of ``documents``, whatever they are besides doc_id, text, lang and source; the last returns
the mix. A stage's result is read from its input and from a small table of what goes or changes, so no stage keeps a copy of all texts of its own but the first, which is read from its scores.
``run`` writes each result but the last as Parquet to the shared folder and reads it back before the next stage; what the stage wrote on the way is deleted then, and its input when the next result is written. A stage's defined cases are
those of its operator: null and empty texts, null ids, repeated rows, empty tables and extra columns are handled there.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from epochlens.llm.common import discard, saved_alone
from epochlens.llm.decontamination import keep_clean
from epochlens.llm.jaccard import keep_one_of_each
from epochlens.llm.lines import drop_repeated_lines
from epochlens.llm.mixing import mix_sources
from epochlens.llm.quality import keep_good


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return saved_alone(spark, lambda: keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), "quality_classifier")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal and nearly equal lines the first stays."""
    return drop_repeated_lines(docs)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return keep_one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    return mix_sources(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard", jaccard_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("source_mixing", mixing_stage),
]
#: A trained classifier and near-duplicate classes are not expressible in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, saved_alone(spark, partial(stage, spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
