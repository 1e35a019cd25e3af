"""The corpus pipeline: toxicity, quality, near-duplicates, mixing, pieces.

Each stage gets all that its predecessor kept, written as Parquet and read
again. SQL can express neither the trained models nor the sketches, so
ORACLE_SQL is None; tests compare stages with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import mixing, neardup, pieces, quality, toxicity
from millrace.llm.common import table, written

STAGES = [
    ("toxicity", toxicity.stage),
    ("quality", quality.stage),
    ("minhash_neardup", neardup.stage),
    ("mixing", mixing.stage),
    ("sentencepiece", pieces.stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
