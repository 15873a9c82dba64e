"""A corpus pipeline: toxicity, line dedup, near duplicates, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. ORACLE_SQL is None: SQL can't express the fitted toxicity
model that decides which documents the others see.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import common, line_dedup, mixing, ngram_join, packing, toxicity

STAGES = [
    ("toxicity", toxicity.toxicity_stage),
    ("line_dedup", line_dedup.line_dedup_stage),
    ("ngram_join", ngram_join.ngram_join_stage),
    ("mixing", mixing.mixing_stage),
    ("packing", packing.packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the rows of the last one."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.write_shared(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
