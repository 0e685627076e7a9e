"""A training-corpus pipeline: five stages over ``documents``, each by one operator of annalist.llm.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; its result
is written as Parquet in the shared folder and read again.  All but the last return the columns of
documents; the last returns where each token piece of each document stands.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from annalist.llm import common, language_id, mixing, packing, secret_scan, simhash

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id.stage),
    ("simhash_dedup", simhash.stage),
    ("secret_scan", secret_scan.stage),
    ("mix_sources", mixing.stage),
    ("best_fit_packing", packing.stage),
]

#: SQL has neither the models nor the draws and searches of these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, from documents; what a stage leaves in the shared folder goes when the next one is written."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = common.scratch(spark, f"stage-{name}")
        with common.swept(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            common.remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
