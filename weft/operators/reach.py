"""Distances on graphs: the k nearest sources of every node, the largest connected patch, points as far from each other as possible.

Loops of DataFrame steps; each step is written to the shared folder and moves only labels that changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.functions.shared import materialize
from weft.operators.graph import both_directions, components


def _arcs(edges: DataFrame, length: str | None) -> DataFrame:
    """(a, b, w) in both directions, the shortest of parallel edges."""
    w = F.col(length).cast("double") if length else F.lit(1.0)
    both = both_directions(edges.where("a <> b").select("a", "b", w.alias("w")), ["w"])
    return materialize(both.groupBy("a", "b").agg(F.min("w").alias("w")), "arcs")


def k_nearest_sources(edges: DataFrame, sources: DataFrame, k: int, length: str | None = None) -> DataFrame:
    """(id, source, dist, rank): for every node that a source reaches, its k nearest sources(id), ties by source; a source is its own nearest.

    Labels spread from node to node; a node keeps its k best and passes on what changed. A source that is among a node's k nearest is among those of the
    next node on the way as well, so that nothing is lost, and a step never holds more than k labels a node.
    """
    arcs = _arcs(edges, length)
    best = Window.partitionBy("id").orderBy("dist", "source")
    top = lambda df: df.groupBy("id", "source").agg(F.min("dist").alias("dist")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    labels = materialize(sources.select("id", F.col("id").alias("source"), F.lit(0.0).alias("dist")).distinct().withColumn("rank", F.lit(1)), "labels")
    changed = labels
    while not changed.isEmpty():
        sent = changed.join(arcs, changed["id"] == arcs["a"]).select(F.col("b").alias("id"), "source", (F.col("dist") + F.col("w")).alias("dist"))
        known = labels.select("id", "source", F.col("dist").alias("_was"))
        step = top(labels.select("id", "source", "dist").unionByName(sent)).join(known, ["id", "source"], "left")
        step = materialize(step.withColumn("_new", F.col("_was").isNull() | (F.col("dist") < F.col("_was"))), "labels")
        labels, changed = step.select("id", "source", "dist", "rank"), step.where("_new").select("id", "source", "dist")
    return labels


def nearest_nodes(edges: DataFrame, centre: Column, nodes: DataFrame, k: int, length: str | None = None) -> DataFrame:
    """(id, dist): the k nodes nearest to the node for which ``centre`` holds, ties by id; one compact block."""
    found = k_nearest_sources(edges, nodes.where(centre).select("id"), 1, length)
    return found.select("id", "dist").orderBy("dist", "id").limit(k)


def largest_patch(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(comp, size): the largest set of members(id) that hang together without leaving them; of equal ones that with the smallest id."""
    m = members.select("id").distinct()
    inside = edges.join(m.withColumnRenamed("id", "a"), "a", "left_semi").join(m.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b")
    sizes = components(inside, m).groupBy("comp").agg(F.count("*").alias("size"))
    return sizes.orderBy(F.col("size").desc(), "comp").limit(1)


def farthest_points(edges: DataFrame, nodes: DataFrame, first: int, k: int, length: str | None = None) -> DataFrame:
    """(step, id, dist): from ``first`` on, again and again the node farthest from all chosen ones (ties: the smallest id; what cannot be reached is farthest).

    Every node keeps its distance to the nearest chosen one. A new choice spreads only where it is nearer than that: steps touch its own surroundings, not the
    whole graph. ``k`` choices are k rows for the driver.
    """
    arcs, spark = _arcs(edges, length), nodes.sparkSession
    far = materialize(nodes.select("id").distinct().withColumn("d", F.lit(float("inf"))), "distances")
    chosen, seed, d = [], first, None
    while seed is not None and len(chosen) < k:
        chosen.append((len(chosen), seed, d))
        going = far.where((F.col("id") == seed) & (F.col("d") > 0)).select("id", F.lit(0.0).alias("d"))
        near = materialize(going, "nearer")
        reached = near
        while not near.isEmpty():
            sent = near.join(arcs, near["id"] == arcs["a"]).groupBy(F.col("b").alias("id")).agg(F.min(F.col("d") + F.col("w")).alias("d"))
            have = far.select("id", F.col("d").alias("_d")).join(reached.groupBy("id").agg(F.min("d").alias("_r")), "id", "left")
            near = materialize(sent.join(have, "id").where(F.col("d") < F.least("_d", F.coalesce("_r", F.lit(float("inf"))))).select("id", "d"), "nearer")
            reached = reached.unionByName(near)
        better = reached.groupBy("id").agg(F.min("d").alias("_r"))
        far = materialize(far.join(better, "id", "left").select("id", F.least("d", F.coalesce("_r", F.lit(float("inf")))).alias("d")), "distances")
        next_ = far.where("d > 0").orderBy(F.col("d").desc(), "id").first()
        seed, d = (next_["id"], next_["d"]) if next_ else (None, None)
    return spark.createDataFrame(chosen, f"step int, id {dict(nodes.dtypes)['id']}, dist double")
