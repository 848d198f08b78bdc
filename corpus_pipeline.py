"""The corpus pipeline: stages that each take (spark, docs, sf_dir) and return documents, written and reread in between."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kvarn.llm import queries
from kvarn.llm.common import materialise
from kvarn.session import ship

STAGES = [
    ("quality_rules", queries.stage_quality),
    ("ngram_jaccard_join", queries.stage_ngram_join),
    ("benchmark_decontamination", queries.stage_decontaminate),
    ("pii", queries.stage_pii),
    ("packing", queries.stage_packing),
]

#: None: hashes, tries and tokenizers have no SQL form; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again."""
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
