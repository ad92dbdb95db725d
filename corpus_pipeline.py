"""The corpus pipeline: documents through five stages, each written as Parquet in the shared folder and read again.

run(spark, sf_dir) gives the mix of what is left of documents; ORACLE_SQL is None, as SQL has no hashed model, byte spans or
suffix order: tests hold each stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weft.llm import decontaminate, mixing, near_dup, quality, suffix_dedup
from weft.llm.common import materialize, read_table

STAGES = [
    ("quality rules", quality.stage),
    ("minhash near-dedup", near_dup.stage),
    ("suffix-array dedup", suffix_dedup.stage),
    ("benchmark decontamination", decontaminate.stage),
    ("source mixing", mixing.stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
