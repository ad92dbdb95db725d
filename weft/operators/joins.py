"""Joins on nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.operators.polygons import nearest_shape


def both_ends(edges: DataFrame, nodes: DataFrame, a: str, b: str, key: str, take: list[str]) -> DataFrame:
    """Left join of the node table on both ends; the columns get the suffixes _a and _b. Catalyst broadcasts a small node table."""
    for end, c in (("a", a), ("b", b)):
        side = nodes.select(F.col(key).alias(f"_{end}"), *[F.col(t).alias(f"{t}_{end}") for t in take])
        edges = edges.join(side, edges[c] == side[f"_{end}"], "left").drop(f"_{end}")
    return edges


def endpoint_series(edges: DataFrame, series: DataFrame, a: str, b: str, node: str, at: str, x: str) -> DataFrame:
    """Edge x time: the series' value at a and at b, for every time where both ends have one."""
    left = series.select(F.col(node).alias(a), F.col(at), F.col(x).alias(f"{x}_a"))
    right = series.select(F.col(node).alias(b), F.col(at), F.col(x).alias(f"{x}_b"))
    return edges.join(left, a).join(right, [b, at])


def to_spine(spine: DataFrame, data: DataFrame, on: list[str], fill: dict[str, object]) -> DataFrame:
    """Every row of the spine; missing values filled where a filling is given."""
    return spine.join(data, on, "left").fillna(fill) if fill else spine.join(data, on, "left")


def nearest(left: DataFrame, right: DataFrame, within: list[str], lid: str, rid: str, lx: str, ly: str, rx: str, ry: str, **options) -> DataFrame:
    """(lid, nearest, d2): the nearest right row in the same group, ties by id; left rows without one are left out. Points are shapes without extent."""
    shapes = right.select(*within, F.col(rid).alias("nearest"), F.col(rx).alias("x0"), F.col(ry).alias("y0"), F.col(rx).alias("x1"), F.col(ry).alias("y1"))
    return nearest_shape(left, shapes, within, lid, "nearest", lx, ly, **options)


def bracket(df: DataFrame, grid: DataFrame, by: list[str], at: str, x: str, y: str) -> DataFrame:
    """Linear interpolation of grid y(x) at ``at``, by the grid points on either side; outside the grid null. One ordered
    window over both tables instead of a range join."""
    marks = grid.select(*by, F.col(x).cast("double").alias("_t"), F.col(y).cast("double").alias("_y")).unionByName(df.select(*by, F.col(at).cast("double").alias("_t"), F.lit(None).cast("double").alias("_y")).distinct())
    marks = marks.groupBy(*by, "_t").agg(F.max("_y").alias("_y"))
    known = F.when(F.col("_y").isNotNull(), F.struct("_t", "_y"))
    low = F.last(known, True).over(Window.partitionBy(*by).orderBy("_t"))
    high = F.first(known, True).over(Window.partitionBy(*by).orderBy("_t").rowsBetween(0, Window.unboundedFollowing))
    marks = marks.withColumn("_l", low).withColumn("_h", high)
    gap = F.col("_h._t") - F.col("_l._t")
    value = F.when(gap == 0, F.col("_l._y")).otherwise(F.col("_l._y") + (F.col("_h._y") - F.col("_l._y")) * (F.col("_t") - F.col("_l._t")) / F.nullif(gap, F.lit(0.0)))
    return df.withColumn("_t", F.col(at).cast("double")).join(marks.select(*by, "_t", value.alias("value")), [*by, "_t"]).drop("_t")


def dense_ids(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Adds a dense id from 1 over the distinct keys, in their order. The ids are dealt over the distinct keys only."""
    ids = df.select(*keys).distinct().withColumn(name, F.dense_rank().over(Window.orderBy(*keys)).cast("long"))
    return df.join(ids, keys)


def cover_check(nodes: DataFrame, cover: DataFrame, key: str) -> DataFrame:
    """One row: nodes missing from the cover, keys of the cover that are no node, nodes covered more than once."""
    left = nodes.select(F.col(key).alias("_n")).distinct()
    right = cover.groupBy(F.col(key).alias("_c")).agg(F.count("*").alias("_k"))
    both = left.join(right, left["_n"] == right["_c"], "full_outer")
    return both.agg(
        F.count_if(F.col("_c").isNull()).alias("missing"), F.count_if(F.col("_n").isNull()).alias("unknown"), F.count_if(F.col("_k") > 1).alias("repeated")
    )
