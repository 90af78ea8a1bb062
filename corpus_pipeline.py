"""The corpus pipeline: quality rules, near-dedup, substring dedup, decontamination, packing.

The rows of its last table carry the texts: the pieces of a bin, in the order of bin_start, are one training sequence, and the pieces of a
document, in their order, are its cleaned text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lotwise.llm import packing, positional_index, quality_rules, simhash_dedup, suffix_trees
from lotwise.llm.common import Scratch

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("simhash_dedup", simhash_dedup.stage),
    ("substring_dedup", suffix_trees.stage),
    ("decontamination", positional_index.stage),
    ("packing", packing.stage),
]

#: The stages learn, iterate and search, so SQL expresses none of them; tests/llm hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents; each one's result is written as Parquet and read again by the next."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
