"""The corpus pipeline: five stages over ``documents``, each on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dasyspark.llm import stages
from dasyspark.session import materialize

STAGES = [
    ("language_id", stages.language_id),
    ("toxicity", stages.toxicity),
    ("ngram_jaccard_join", stages.near_duplicates),
    ("suffix_array_dedup", stages.suffix_array),
    ("packing", stages.pack),
]

# The toxicity model and the tokenizer have no SQL form; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``, writing and rereading between them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
