"""A document pipeline of the numbered operators: each stage's output is written and read as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scholia.llm import mixing, packing, quality_rules, secret_scan, simhash
from scholia.llm.common import read, staged

STAGES = [
    ("quality_rules", quality_rules.quality_stage),
    ("simhash", simhash.simhash_stage),
    ("secret_scan", secret_scan.secrets_stage),
    ("mixing", mixing.mixing_stage),
    ("packing", packing.packing_stage),
]

#: SimHash and packing have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
