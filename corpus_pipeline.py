"""A corpus pipeline of five of the operators: rules, exact and near copies, personal data, packing.

Each stage's output is written as Parquet in the shared folder and read again by the next; the output of the
stage before is deleted once the next one is written.

Cases: null and empty texts fail the quality rules and leave with that stage; of repeated rows and of equal
texts one row stays, under whatever doc_id, null included; documents without doc_id are told apart by their
texts; an empty table packs to nothing; further columns are carried up to packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from readlake.llm import exact_dedup, near_dedup, packing, pii, quality
from readlake.llm.common import discard, fresh_path, table

STAGES = [
    ("quality_rules", quality.stage),
    ("exact_dedup", exact_dedup.stage),
    ("minhash_near_dedup", near_dedup.stage),
    ("pii", pii.stage),
    ("best_fit_packing", packing.stage),
]

#: Quantile sketches, consistent sampling and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def applied(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` through all stages."""
    last = None
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            discard(spark, last)
        last = path
    return docs


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through all stages, each written as Parquet and read again."""
    return applied(spark, table(spark, sf_dir, "documents"), sf_dir)
