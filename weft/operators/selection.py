"""Exact order statistics and quantiles by radix selection.

The rows of a group are first counted by value. Groups of few values are one window each. In hot groups every wanted rank has an
interval of values; a round counts the values of all open intervals in bins, by one aggregate with partial sums, and each interval
narrows to the bin that holds its rank. Bins are even between the least and greatest value left, on a logarithmic scale
while those are further apart than a factor, so that heavy tails narrow as fast as even ones. What is left in the end is some thousand values a rank. No task ever holds a hot group.
Null and NaN values do not count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.functions.shared import hint_if_small, materialize


def steps(df: DataFrame, by: list[str], x: str, w: Column) -> DataFrame:
    """(_by, x, w): weight by group and value."""
    rows = df.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double")))
    return rows.groupBy(F.struct(*by).alias("_by") if by else F.struct(F.lit(0).alias("one")).alias("_by"), F.col(x).alias("x")).agg(F.sum(w).alias("w"))


def _scaled(x: Column) -> Column:
    """Monotone and logarithmic on either side of 0; every double lies within +-2000."""
    x = x.cast("double")
    return F.signum(x) * F.least(F.coalesce(F.log(F.abs(x)), F.lit(0.0)) + 750, F.lit(2000.0))


def _bin(bins: int) -> Column:
    """Even bins from lo to hi, on the logarithmic scale where they are further apart than a factor."""
    even = lambda f: F.try_divide(f(F.col("x")) - f(F.col("lo")), f(F.col("hi")) - f(F.col("lo")))
    wide = _scaled(F.col("hi")) - _scaled(F.col("lo")) > 1
    at = F.when(wide, even(_scaled)).otherwise(even(lambda c: c.cast("double")))
    return F.least(F.lit(bins - 1), F.coalesce(at * bins, F.lit(0.0)).cast("int"))


def _first_reaching(rows: DataFrame, order: str, w: str, keep: list[str]) -> DataFrame:
    """Of each (_by, target) the first row in ``order`` with which below and the weights so far reach the goal."""
    cum = F.sum(w).over(Window.partitionBy("_by", "target").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    reached = rows.withColumn("_cum", F.col("below") + cum).where(F.col("_cum") >= F.col("goal"))
    first = F.min_by(F.struct(*keep, (F.col("_cum") - F.col(w)).alias("below")), order)
    return reached.groupBy("_by", "target", "goal").agg(first.alias("_f")).select("_by", "target", "goal", "_f.*")


def order_statistics(counted: DataFrame, goals: DataFrame, few: int = 4096, bins: int = 1024, hot: int = 1_000_000) -> DataFrame:
    """(_by, target, x): the smallest x of the group up to which the weights add up to the goal. ``counted`` is a table of ``steps``; goals(_by, target, goal)
    do not exceed the group's weight. Groups of more than ``hot`` values are narrowed until ``few`` are left."""
    sizes = counted.groupBy("_by").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    large = sizes.where(F.col("n") > hot)
    goals = goals.withColumn("goal", F.col("goal").cast("long"))
    if large.isEmpty():
        rows = counted.join(hint_if_small(goals), "_by").withColumn("below", F.lit(0).cast("long"))
        return _first_reaching(rows, "x", "w", ["x"]).select("_by", "target", "x")
    large = materialize(large, "hot-groups")
    names = hint_if_small(large.select("_by"))
    cool = counted.join(names, "_by", "left_anti").join(hint_if_small(goals), "_by").withColumn("below", F.lit(0).cast("long"))
    rows = materialize(counted.join(names, "_by", "left_semi"), "hot-steps")
    state = materialize(large.join(goals, "_by").select("_by", "target", "goal", "lo", "hi", F.lit(0).cast("long").alias("below"), "n"), "intervals")
    wide = (F.col("n") > few) & (F.col("lo") < F.col("hi"))
    inside = lambda s: rows.join(hint_if_small(s), "_by").where("x between lo and hi")
    before = None
    while (left := state.where(wide).agg(F.sum("n")).first()[0]) and left != before:  # values that no double tells apart stay together
        before = left
        counts = inside(state.where(wide)).groupBy("_by", "target", "goal", "below", _bin(bins).alias("bin")).agg(
            F.sum("w").alias("w"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
        narrowed = _first_reaching(counts, "bin", "w", ["lo", "hi", "n"])
        state = materialize(state.where(~wide).unionByName(narrowed.select(*state.columns)), "intervals")
    last = _first_reaching(inside(state), "x", "w", ["x"])
    return _first_reaching(cool, "x", "w", ["x"]).select("_by", "target", "x").union(last.select("_by", "target", "x"))


def _named(found: DataFrame, by: list[str], *values: Column) -> DataFrame:
    return found.select(*[F.col(f"_by.{c}").alias(c) for c in by], *values)


def weighted_quantile(df: DataFrame, by: list[str], x: str, w: str, q_num: int, q_den: int, **options) -> DataFrame:
    """(by, quantile): the smallest x whose cumulative weight share reaches q_num / q_den, by whole weights; equal x are one step."""
    counted = materialize(steps(df, by, x, F.col(w)), "steps")
    goal = F.expr(f"(sum(w) * {q_num} + {q_den - 1}) div {q_den}")
    goals = counted.groupBy("_by").agg(goal.alias("goal")).withColumn("target", F.lit(0))
    return _named(order_statistics(counted, goals, **options), by, F.col("x").alias("quantile"))


def percentiles(df: DataFrame, by: list[str], x: str, qs: list[float], **options) -> DataFrame:
    """(by, q): array of quantiles, linear between the two ranks around q * (n - 1)."""
    counted = materialize(steps(df, by, x, F.lit(1)), "steps")
    at = [F.lit(q) * (F.sum("w") - 1) for q in qs]
    targets = [F.struct(F.lit(2 * k + j).alias("target"), F.least(F.floor(a) + 1 + j, F.sum("w")).alias("goal"), (a - F.floor(a)).alias("part")) for k, a in enumerate(at) for j in (0, 1)]
    goals = materialize(counted.groupBy("_by").agg(F.array(*targets).alias("t")).select("_by", F.inline("t")), "goals")
    found = order_statistics(counted, goals.select("_by", "target", "goal"), **options).join(goals.select("_by", "target", "part"), ["_by", "target"])
    rows = found.groupBy("_by").agg(F.array_sort(F.collect_list(F.struct("target", F.col("x").cast("double").alias("x"), "part"))).alias("v"))  # two values a quantile
    line = [F.col("v")[2 * k]["x"] + (F.col("v")[2 * k + 1]["x"] - F.col("v")[2 * k]["x"]) * F.col("v")[2 * k]["part"] for k in range(len(qs))]
    return _named(rows, by, F.array(*line).alias("q"))
