"""The corpus pipeline: from raw documents to a mix, one operator per stage.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; the result is written as
Parquet and read again as the next stage's docs. All stages but the last return the
columns of ``documents``; the last returns what the mix takes of each document.

Each stage takes rows with null or repeated ids, null, empty and very long texts, equal rows and empty tables; its docstring says what it
does with them. Rows are told apart by id and text, and columns that no stage reads pass through the first four as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import decontaminate, exact_dedup, ngram_join, quality, source_mix
from weftline.llm.base import keep, read

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality.stage),
    ("exact_dedup", exact_dedup.stage),
    ("ngram_join", ngram_join.stage),
    ("decontaminate", decontaminate.stage),
    ("source_mix", source_mix.stage),
]

#: The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
