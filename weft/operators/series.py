"""Operators on ordered series: gaps, slopes, envelopes, folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def fill_by_shift(df: DataFrame, by: list[str], order: str, x: str, shift: int) -> DataFrame:
    """A missing value from ``shift`` rows before, else after. The series has to be on its full spine."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn(x, F.coalesce(x, F.lag(x, shift).over(w), F.lead(x, shift).over(w)))


def interpolate(df: DataFrame, by: list[str], order: str, x: str, limit: int) -> DataFrame:
    """Linear interpolation of missing values at most ``limit`` rows from a known one on either side; ends stay missing."""
    w = Window.partitionBy(*by).orderBy(order)
    at = df.withColumn("_i", F.row_number().over(w))
    known = F.when(F.col(x).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(x).cast("double").alias("x")))
    at = at.withColumn("_l", F.last(known, True).over(w)).withColumn("_h", F.first(known, True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    near = (F.col("_i") - F.col("_l.i") <= limit) | (F.col("_h.i") - F.col("_i") <= limit)
    line = F.col("_l.x") + (F.col("_h.x") - F.col("_l.x")) * (F.col("_i") - F.col("_l.i")) / F.nullif(F.col("_h.i") - F.col("_l.i"), F.lit(0))
    return at.withColumn(x, F.when(F.col(x).isNotNull(), F.col(x).cast("double")).when(near, line)).drop("_i", "_l", "_h")


def gradient(df: DataFrame, by: list[str], order: str, x: str) -> DataFrame:
    """Adds ``step`` (next minus this) and ``slope`` (central difference, one-sided at the ends)."""
    w = Window.partitionBy(*by).orderBy(order)
    before, after = F.lag(x).over(w), F.lead(x).over(w)
    slope = F.when(before.isNull(), after - F.col(x)).when(after.isNull(), F.col(x) - before).otherwise((after - before) / 2)
    return df.withColumn("step", after - F.col(x)).withColumn("slope", slope.cast("double"))


def pareto(df: DataFrame, by: list[str], x: str, y: str, ties: list[str]) -> DataFrame:
    """Rows whose y is below that of every row before them in order of x."""
    w = Window.partitionBy(*by).orderBy(x, y, *ties).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_m", F.min(y).over(w)).where(F.col("_m").isNull() | (F.col(y) < F.col("_m"))).drop("_m")


def running_max(df: DataFrame, by: list[str], order: list[str], x: str, name: str) -> DataFrame:
    return df.withColumn(name, F.max(x).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def windowed_slope(df: DataFrame, by: list[str], order: str, x: str, k: int) -> DataFrame:
    """Adds ``rate``: (x k rows later - x) / k; null where the window runs out."""
    return df.withColumn("rate", (F.lead(x, k).over(Window.partitionBy(*by).orderBy(order)) - F.col(x)) / k)


def largest_remainder(df: DataFrame, by: list[str], key: str, share: str, total: int) -> DataFrame:
    """Adds ``seats``: ``total`` units by share, rounded down, the rest to the largest remainders (ties by key)."""
    group = Window.partitionBy(*by)
    exact = F.col(share) * total / F.sum(share).over(group)
    rows = df.withColumn("_e", exact).withColumn("seats", F.floor("_e"))
    rows = rows.withColumn("_k", F.row_number().over(group.orderBy((F.col("_e") - F.col("seats")).desc(), key))).withColumn("_s", F.sum("seats").over(group))
    return rows.withColumn("seats", F.col("seats") + (F.col("_k") <= total - F.col("_s")).cast("long")).drop("_e", "_k", "_s")
