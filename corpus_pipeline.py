"""The corpus pipeline: quality, near-copies, benchmark leaks, mixture, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from routeloom.llm import decontamination, jaccard_join, mixing, quality_model, sharding
from routeloom.llm.common import materialise

#: (name, function of (spark, docs, sf_dir)); all but the last return the columns of documents.
STAGES = [
    ("quality_classifier", quality_model.stage),
    ("ngram_jaccard_join", jaccard_join.stage),
    ("benchmark_decontamination", decontamination.stage),
    ("source_mixing", mixing.stage),
    ("extendible_sharding", sharding.stage),
]

#: A fitted model and text hashing decide the first stages, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each one's rows are written, and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
