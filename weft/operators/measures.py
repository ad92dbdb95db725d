"""Measures of labellings: contingency, agreement, rigidity, cut, balance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def contingency(df: DataFrame, b: str, a: str, w: str | None = None) -> DataFrame:
    extra = [F.sum(w).alias("weight")] if w else []
    return df.groupBy(F.col(b).alias("b"), F.col(a).alias("a")).agg(F.count("*").alias("n"), *extra)


def adjusted_rand(table: DataFrame) -> DataFrame:
    """One row ``ari`` from contingency rows (b, a, n)."""
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    cells = table.agg(pairs("n").alias("ij"), F.sum("n").alias("total"))
    rows = table.groupBy("b").agg(F.sum("n").alias("m")).agg(pairs("m").alias("i"))
    cols = table.groupBy("a").agg(F.sum("n").alias("m")).agg(pairs("m").alias("j"))
    one = cells.crossJoin(rows).crossJoin(cols)  # three single rows
    expected = F.col("i") * F.col("j") / (F.col("total") * (F.col("total") - 1) / 2)
    return one.select(((F.col("ij") - expected) / ((F.col("i") + F.col("j")) / 2 - expected)).alias("ari"))


def rigidity(df: DataFrame, b: str, a: str, w: str) -> DataFrame:
    """One row: capacity-weighted Mirkin distance sum g (nB + nA - 2 n) and its normaliser sum g (N - 1)."""
    cells = df.groupBy(F.col(b).alias("b"), F.col(a).alias("a")).agg(F.count("*").alias("n"), F.sum(w).alias("g"))
    cells = cells.withColumn("nb", F.sum("n").over(Window.partitionBy("b"))).withColumn("na", F.sum("n").over(Window.partitionBy("a")))
    return cells.agg(F.sum(F.col("g") * (F.col("nb") + F.col("na") - 2 * F.col("n"))).alias("rigidity"), (F.sum("g") * (F.sum("n") - 1)).alias("normaliser"))


def zone_balance(df: DataFrame, group: str, zone: str, x: str, floor: float) -> DataFrame:
    """Per group: effective number of zones 1 / sum s^2, and how many zones reach the floor."""
    zones = df.groupBy(group, zone).agg(F.sum(x).alias("_x"))
    shares = zones.withColumn("_s", F.col("_x") / F.sum("_x").over(Window.partitionBy(group)))
    return shares.groupBy(group).agg((1 / F.sum(F.col("_s") * F.col("_s"))).alias("effective"), F.count_if(F.col("_s") >= floor).alias("above"), F.count("*").alias("zones"))


def cut(edges: DataFrame, labels: DataFrame, a: str, b: str, node: str, zone: str, w: str) -> DataFrame:
    """One row: share of edges cut, share of positive weight cut."""
    from weft.operators.joins import both_ends

    e = both_ends(edges, labels, a, b, node, [zone])
    apart = F.col(f"{zone}_a") != F.col(f"{zone}_b")
    return e.agg(F.avg(apart.cast("int")).alias("cut_ratio"), (F.sum(F.when(apart & (F.col(w) > 0), F.col(w)).otherwise(0)) / F.sum(F.when(F.col(w) > 0, F.col(w)))).alias("weight_cut"))
