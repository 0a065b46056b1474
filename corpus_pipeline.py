"""A corpus pipeline: toxicity, near duplicates, benchmark leaks, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orbweave.llm import decontam, jaccard, packing, secrets, toxicity
from orbweave.llm.runtime import scratch, table

STAGES = [
    ("toxicity", toxicity.stage),
    ("ngram_jaccard_join", jaccard.stage),
    ("benchmark_decontamination", decontam.stage),
    ("secret_scans", secrets.stage),
    ("best_fit_packing", packing.stage),
]

#: Models and token ids aren't expressible in SQL; the stages are tested by themselves.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again by the next stage."""
    docs = table(spark, sf_dir, "documents")
    folder = scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
