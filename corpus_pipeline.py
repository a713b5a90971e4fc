"""From raw documents to token ids: quality, near duplicates, benchmark passages, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet to the shared folder and reads again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rxweave.llm import stages
from rxweave.session import cut_lineage

STAGES = [
    ("quality", stages.good),
    ("near_duplicates", stages.distinct),
    ("decontamination", stages.clean),
    ("personal_data", stages.private),
    ("tokens", stages.tokens),
]

#: The similarity of texts, the random field and the merges of a vocabulary are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut_lineage(spark, stage(spark, docs, sf_dir), name)
    return docs
