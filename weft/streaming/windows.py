"""Streaming forms: watermarked windows, a recursive filter with state, and a run to the end of what is there."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, folder: str, pattern: str, schema, at: str = "ts") -> DataFrame:
    """A stream over the Parquet files of a folder whose names fit the pattern; a watermark needs TIMESTAMP, not TIMESTAMP_NTZ."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder).withColumn(at, F.col(at).cast("timestamp"))


def windowed(events: DataFrame, at: str, keys: list[str], size: str, slide: str | None, late: str, **aggregates) -> DataFrame:
    """Tumbling or sliding aggregates; rows later than ``late`` are dropped, windows leave once they are complete."""
    window = F.window(at, size, slide) if slide else F.window(at, size)
    grouped = events.withWatermark(at, late).groupBy(window, *keys)
    return grouped.agg(*[c.alias(n) for n, c in aggregates.items()]).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, *aggregates)


def sessions(events: DataFrame, at: str, keys: list[str], gap: str, late: str) -> DataFrame:
    grouped = events.withWatermark(at, late).groupBy(F.session_window(at, gap), *keys)
    return grouped.agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def lag_filter(events: DataFrame, key: str, at: str, x: str, alpha: float) -> DataFrame:
    """y += alpha * (x - y) per key in order of arrival (in order of time inside a batch); emits the state after each batch."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        y, n = state.get if state.exists else (None, 0)
        for x_ in pd.concat(list(frames)).sort_values([at, x])[x]:
            y = float(x_) if y is None else y + alpha * (float(x_) - y)
            n += 1
        state.update((y, n))
        yield pd.DataFrame({key: [k[0]], "y": [y], "n": [n]})

    kind = dict(events.dtypes)[key]
    return events.select(key, at, x).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, y double, n long", "y double, n long", "update", GroupStateTimeout.NoTimeout)


def run_available(df: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there, into Parquet at ``path`` (exactly once, by checkpoint and idempotent batches)."""
    if mode == "append":
        writer = df.writeStream.format("parquet").outputMode("append").option("path", path)
    else:
        writer = df.writeStream.outputMode(mode).foreachBatch(lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{path}/batch-{epoch:09d}"))
    writer.option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    spark = df.sparkSession
    if mode == "append":
        return spark.read.schema(df.schema).parquet(path)
    return spark.read.schema(df.schema).option("recursiveFileLookup", True).parquet(path)
