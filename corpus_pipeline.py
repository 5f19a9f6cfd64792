"""The corpus pipeline: documents through five operators, each stage written and read again."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from hubtrace.llm import line_dedup as lines  # noqa: E402
from hubtrace.llm import packing, pii, quality_classifier, simhash  # noqa: E402
from hubtrace.llm.common import fresh_path, words_of  # noqa: E402

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _with_text(docs: DataFrame, text: str) -> DataFrame:
    """The columns of docs with another text; n_chars follows it where there is such a column."""
    new = {"text": F.col(text)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return docs.withColumns(new)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; judged row by row on the text, fitted on the labels table."""
    trees = quality_classifier.fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.accepted(docs, trees)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier one holds; those of which no word is left go."""
    return _with_text(lines.without_repeats(docs), "text")


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the smallest id; the first text if ids repeat."""
    return simhash.representatives(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with personal data replaced by <KIND>."""
    return _with_text(pii.mask_documents(docs, pii.fit_on(docs)), "text")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their bucket, batch and slot; lengths are words and one for the end."""
    return packing.pack(docs, F.size(words_of(F.col("text"))) + 1)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", simhash_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: No SQL: the stages use fitted models, alignment and dynamic programming.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = fresh_path(spark, "pipeline")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
