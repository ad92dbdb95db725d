"""Greedy cover, lazily: the next choice is the one that covers most of what is still open."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.shared import hint_if_small, materialize


def lazy_greedy_cover(cover: DataFrame, items: DataFrame, most: int, chosen: DataFrame | None = None, batch: int = 64) -> DataFrame:
    """(step, choice, gain): up to ``most`` choices of cover(choice, item), each the one that adds the largest weight of open items(item, w), ties to the
    smallest choice; ``chosen(choice)`` are taken beforehand. Ends where no choice adds anything.

    What a choice adds can only shrink, so that its last known gain bounds it. A round measures the ``batch`` choices of the largest bounds again, against
    open items only, and takes the best of them once no bound left is above it: most choices are never looked at twice. The driver sees a
    batch of gains a round.
    """
    spark, kind = cover.sparkSession, dict(cover.dtypes)["choice"]
    cover = materialize(cover.select("choice", "item").distinct(), "cover")
    open_ = items.where("w > 0").select("item", "w")
    if chosen is not None:
        open_ = open_.join(cover.join(chosen, "choice", "left_semi").select("item").distinct(), "item", "left_anti")
    open_ = materialize(open_, "open")
    bounds = materialize(cover.join(open_, "item").groupBy("choice").agg(F.sum("w").alias("bound")), "bounds")
    out: list[tuple] = []
    exact: dict = {}  # gains measured since the last choice: a batch or a few
    while len(out) < most:
        left = bounds.where(~F.col("choice").isin(list(exact))) if exact else bounds
        top = left.orderBy(F.col("bound").desc(), "choice").limit(batch + 1).collect()
        best = min(exact.items(), key=lambda g: (-g[1], g[0]), default=None)
        if best is not None and (not top or (-best[1], best[0]) < (-top[0]["bound"], top[0]["choice"])):
            if best[1] <= 0:
                break
            out.append((len(out) + 1, best[0], best[1]))
            gone = cover.where(F.col("choice") == F.lit(best[0])).select("item")
            open_ = materialize(open_.join(gone, "item", "left_anti"), "open")
            known = spark.createDataFrame(list(exact.items()), f"choice {kind}, _b {dict(bounds.dtypes)['bound']}")
            bounds = materialize(bounds.join(F.broadcast(known), "choice", "left").select("choice", F.coalesce("_b", "bound").alias("bound")).where((F.col("bound") > 0) & (F.col("choice") != F.lit(best[0]))), "bounds")
            exact = {}
            continue
        if not top:
            break
        names = [r["choice"] for r in top[:batch]]
        again = spark.createDataFrame([(c,) for c in names], f"choice {kind}")
        found = {r["choice"]: r["gain"] for r in cover.join(F.broadcast(again), "choice").join(hint_if_small(open_), "item").groupBy("choice").agg(F.sum("w").alias("gain")).collect()}
        exact |= {c: found.get(c, 0) for c in names}
    return spark.createDataFrame(out, f"step long, choice {kind}, gain {dict(bounds.dtypes)['bound']}")
