"""A corpus pipeline: each stage reads what the one before it wrote to the shared folder."""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

_ROOT = str(Path(__file__).resolve().parent)
if _ROOT not in sys.path:
    sys.path.insert(0, _ROOT)

from riskspark.llm import decontam, jaccard, linededup, packing, quality  # noqa: E402
from riskspark.llm.common import fresh, released, staged  # noqa: E402
from riskspark.sources.files import read_table  # noqa: E402


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier accepts."""
    return quality.good_documents(docs, read_table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document that lost lines and has no text left goes with them."""
    released(spark)
    lost = fresh(docs, "lost")
    out = linededup.dedup_lines(docs, counts=(fresh(docs, "had"), lost))
    return out.where(F.col("text").isNull() | (F.col(lost) == 0) | F.col("text").rlike("\\S")).select(docs.columns)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies."""
    released(spark)
    return jaccard.one_per_component(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    released(spark)
    return decontam.without_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of token ids, one row per piece."""
    released(spark)
    return packing.packed(docs)


STAGES = [("quality", quality_stage), ("lines", line_stage), ("near_copies", near_copy_stage),
          ("benchmark", benchmark_stage), ("packing", packing_stage)]

#: The classifier's model and the packing have no SQL form; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
