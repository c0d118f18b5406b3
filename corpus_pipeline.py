"""From documents to training tokens: rules, near copies, benchmark passages, personal data, byte-level BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmere.llm import stages
from quillmere.sources.scratch import materialise

STAGES = [
    ("quality rules", stages.keep_quality),
    ("near-dedup", stages.drop_near_copies),
    ("decontamination", stages.decontaminated),
    ("personal data", stages.redact),
    ("byte-level BPE", stages.encode),
]
#: The quality model, the fingerprints and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's rows are written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
