"""Writers: stage outputs, sparse long tables, completed partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_stage(df: DataFrame, path: str, partition_by: list[str] = (), fmt: str = "parquet") -> None:
    """One stage's output; Spark's commit makes it atomic, _SUCCESS marks it as done."""
    writer = df.write.mode("overwrite").format(fmt).option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def sparse(df: DataFrame, x: str, tolerance: float) -> DataFrame:
    """Rows above the tolerance; an absent row is 0."""
    return df.where(F.abs(F.col(x)) > tolerance)


def left_to_do(configs: DataFrame, spark: SparkSession, path: str, key: str) -> DataFrame:
    """Configurations that have no finished partition under ``path`` yet."""
    done = spark.read.parquet(path).select(F.col(key).cast(dict(configs.dtypes)[key]).alias(key)).distinct()
    return configs.join(done, key, "left_anti")
