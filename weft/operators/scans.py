"""Recurrences y[k] = a[k] * y[k-1] + b[k] by an associative scan.

Affine maps compose: (a, b) after (c, d) is (a * c, a * d + b). Rows are numbered in order over the cluster and cut into chunks of equal size; within a chunk the maps
are composed by doubling (log2(size) lags over one sorted window); the chunks' own maps are rows again, a size-th as many, and are scanned the
same way. A map with a = 0 forgets what was before, so that a new series needs no partition of its own: one series of any length is spread
over all tasks, and many short ones share chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.functions.shared import materialize
from weft.operators.stats import numbered


def _chunks(rows: DataFrame, n: int, size: int) -> DataFrame:
    """rows(_i, _a, _b, ...) with ``_y``; _i counts from 0 to n - 1."""
    w = Window.partitionBy("_c").orderBy("_i")
    out, d = rows.withColumn("_c", F.expr(f"_i div {size}")), 1
    while d < size:
        a, b = F.coalesce(F.lag("_a", d).over(w), F.lit(1.0)), F.coalesce(F.lag("_b", d).over(w), F.lit(0.0))
        out, d = out.withColumns({"_p": a, "_q": b}).withColumns({"_a": F.col("_a") * F.col("_p"), "_b": F.col("_a") * F.col("_q") + F.col("_b")}).drop("_p", "_q"), d * 2
    if n <= size:
        return out.withColumn("_y", F.col("_b")).drop("_c")
    out = materialize(out, "scan")
    ends = out.where(F.col("_i") % size == size - 1).select(F.col("_c").alias("_i"), "_a", "_b")
    before = _chunks(ends, n // size, size).select((F.col("_i") + 1).alias("_c"), F.col("_y").alias("_s"))
    return out.join(before, "_c", "left").withColumn("_y", F.col("_a") * F.coalesce("_s", F.lit(0.0)) + F.col("_b")).drop("_c", "_s")


def affine_scan(df: DataFrame, by: list[str], order: list[Column], a: Column, b: Column, first: Column, into: str, size: int = 256) -> DataFrame:
    """df with ``into``: y = first at the first row of a series, else a * (the y before) + b. ``size`` is a power of two."""
    rows = materialize(numbered(df, [*[F.col(c) for c in by], *order], "_i"), "series")
    n = rows.count()
    starts = rows.groupBy(*by).agg(F.min("_i").alias("_i")).select("_i", F.lit(True).alias("_new"))
    begins = F.coalesce("_new", F.lit(False))
    maps = rows.join(starts, "_i", "left").withColumns({"_a": F.when(begins, 0.0).otherwise(a).cast("double"), "_b": F.when(begins, first).otherwise(b).cast("double")}).drop("_new")
    return _chunks(maps, n, size).withColumnRenamed("_y", into).drop("_i", "_a", "_b")


def exponential_lag(df: DataFrame, by: list[str], order: list[Column], x: str, alpha: Column | float, into: str, size: int = 256) -> DataFrame:
    """y moves towards x by the share alpha a row (which may depend on the row, as with uneven steps of time), from the first x. Rows without x are left out."""
    share = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    rows = df.where(F.col(x).isNotNull())
    return affine_scan(rows, by, order, 1 - share, share * F.col(x), F.col(x).cast("double"), into, size)
