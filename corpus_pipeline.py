"""The corpus pipeline: quality rules, quality classifier, SimHash near-duplicates, suffix-array duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs; all but the last return the columns of documents. Texts go to Python workers in batches of bounded bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recordloom.llm import packing, quality_rules, resampling, simhash, suffix_dedup
from recordloom.llm.common import small_batches, stored, table

STAGES = [
    ("quality_rules", small_batches(quality_rules.stage)),
    ("quality_classifier", small_batches(resampling.stage)),
    ("simhash_near_dedup", small_batches(simhash.stage)),
    ("suffix_array_dedup", small_batches(suffix_dedup.stage)),
    ("packing", small_batches(packing.stage)),
]

#: SQL has no simple form of the fitted classifier, XXH64 fingerprints or the tokenizer; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs, _ = stored(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
