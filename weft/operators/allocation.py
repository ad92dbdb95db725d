"""Allocations and calibrations of all groups at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.functions.shared import hint_if_small, materialize


def water_fill(units: DataFrame, totals: DataFrame, by: list[str], cap: str, weight: str, total: str, into: str) -> DataFrame:
    """units with ``into``: their group's total shared by weight, none above its cap, what is left shared among the rest.

    A unit is pinned at its cap once the common level passes cap / weight. With units counted by that breakpoint, a level follows from the caps below and
    the weights from there on; the first that does not pass its own breakpoint is the group's. Units without weight get nothing; a total
    above all caps fills every unit, one of 0 or less none.
    """
    at = F.try_divide(F.col(cap).cast("double"), F.when(F.col(weight) > 0, F.col(weight)).cast("double"))
    rows = units.withColumn("_at", at)
    steps = rows.where("_at is not null").groupBy(*by, "_at").agg(F.sum(cap).alias("_cap"), F.sum(weight).alias("_w"))
    order = Window.partitionBy(*by).orderBy("_at")
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("_below", F.coalesce(F.sum("_cap").over(below), F.lit(0))).withColumn("_rest", F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    levels = steps.join(hint_if_small(totals.select(*by, F.col(total).alias("_total"))), by).withColumn("_level", (F.col("_total") - F.col("_below")) / F.col("_rest"))
    first = levels.where("_level <= _at").groupBy(*by).agg(F.min_by("_level", "_at").alias("_level"))
    state = totals.select(*by, F.col(total).alias("_total")).join(first, by, "left")
    state = state.select(*by, F.when(F.col("_total") <= 0, 0.0).otherwise(F.coalesce("_level", F.lit(float("inf")))).alias("_level"))
    share = F.when(F.col("_at").isNull(), 0.0).otherwise(F.least(F.col(cap).cast("double"), F.col("_level") * F.col(weight)))
    return rows.join(hint_if_small(state), by).withColumn(into, F.greatest(share, F.lit(0.0))).drop("_at", "_level")


def calibrate(df: DataFrame, goals: DataFrame, by: list[str], response: Callable[[Column], Column], weight: Column | float = 1.0, sections: int = 32, rounds: int = 8) -> DataFrame:
    """(by, scale, clipped) for goals(by, goal, low, high): the scale at which the group's weighted mean of response(scale), which grows with it, meets the goal.

    All groups are searched together: a round evaluates the points that cut each group's interval into ``sections`` by one aggregate, so that eight rounds are
    as exact as forty halvings. Where the goal is out of reach between low and high the nearer bound is given, ``clipped``.
    """
    w = F.lit(weight) if isinstance(weight, float) else weight
    mean = lambda k: F.try_divide(F.sum(w * response(k)), F.sum(w))
    state = hint_if_small(goals.select(*by, F.col("goal").alias("_goal"), F.col("low").cast("double").alias("_low"), F.col("high").cast("double").alias("_high")))
    ends = df.join(state, by).groupBy(*by, "_goal", "_low", "_high").agg(mean(F.col("_low")).alias("_a"), mean(F.col("_high")).alias("_b")).where("_a is not null")
    out = F.when(F.col("_a") >= F.col("_goal"), F.col("_low")).when(F.col("_b") <= F.col("_goal"), F.col("_high"))
    state = materialize(ends.select(*by, "_goal", "_low", "_high", out.alias("_out")), "scales")
    point = lambda j: F.col("_low") + (F.col("_high") - F.col("_low")) * (j / sections)
    for _ in range(rounds):
        met = df.join(hint_if_small(state.where("_out is null")), by).groupBy(*by, "_goal", "_low", "_high", "_out")
        at = met.agg(F.array(*[mean(point(j)) for j in range(1, sections)]).alias("_f"))
        k = F.size(F.filter("_f", lambda f: f < F.col("_goal")))
        at = at.select(*by, "_goal", *[(F.col("_low") + (F.col("_high") - F.col("_low")) * (e / sections)).alias(n) for n, e in (("_low", k), ("_high", k + 1))], "_out")
        state = materialize(state.where("_out is not null").unionByName(at), "scales")
    return state.select(*by, F.coalesce("_out", (F.col("_low") + F.col("_high")) / 2).alias("scale"), F.col("_out").isNotNull().alias("clipped"))


def dispatch(demand: DataFrame, renewables: DataFrame, fleet: DataFrame, by: list[str], at: str, snsp: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(cases, units) of systems ``by`` at times ``at``: least-cost cover of demand(by, at, load) by renewables(by, at, unit, mw) and fleet(by, unit, pmin, pmax, cost).

    The fleet runs at its minimum and rises in order of cost (ties by unit); what is too much is cut from renewables pro rata. Renewables above the share
    ``snsp`` of the load are cut pro rata as well, and the fleet rises instead. cases: load, potential, cut (surplus), capped (by the share), shortage, snsp (the share
    left). units: (by, at, unit, kind, mw). A system's fleet is ordered once; a case then needs its totals only, no loop over units.
    """
    w = Window.partitionBy(*by)
    head = F.greatest(F.col("pmax") - F.col("pmin"), F.lit(0.0))
    ranked = fleet.withColumn("_head", head).withColumn("_before", F.sum("_head").over(w.orderBy("cost", "unit").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_head"))
    of_fleet = ranked.groupBy(*by).agg(F.sum("pmin").alias("_min"), F.sum("_head").alias("_room"))
    of_wind = renewables.groupBy(*by, at).agg(F.sum("mw").alias("potential"))
    zero = F.lit(0.0)
    case = demand.join(of_wind, [*by, at], "left").join(hint_if_small(of_fleet), by, "left").fillna(0.0, ["potential", "_min", "_room"])
    case = case.withColumn("_lack", F.col("load") - F.col("potential") - F.col("_min"))
    case = case.withColumn("cut", F.least(F.greatest(zero - F.col("_lack"), zero), F.col("potential")))
    over = F.greatest(F.col("potential") - F.col("cut") - F.greatest(F.lit(snsp) * F.col("load"), zero), zero) if snsp is not None else zero
    case = case.withColumn("capped", over).withColumn("_need", F.greatest("_lack", zero) + F.col("capped"))
    case = case.withColumn("_rise", F.least("_need", "_room")).withColumn("shortage", F.col("_need") - F.col("_rise"))
    left = F.col("potential") - F.col("cut") - F.col("capped")
    cases = case.select(*by, at, "load", "potential", "cut", "capped", "shortage", F.try_divide(left, F.col("load")).alias("snsp"))
    keep = F.coalesce(F.try_divide(left, F.col("potential")), zero)
    wind = renewables.join(case.select(*by, at, keep.alias("_keep")), [*by, at]).select(*by, at, "unit", F.lit("renewable").alias("kind"), (F.col("mw") * F.col("_keep")).alias("mw"))
    fill = F.col("pmin") + F.least(F.col("_head"), F.greatest(F.col("_rise") - F.col("_before"), zero))
    firm = case.select(*by, at, "_rise").join(hint_if_small(ranked), by).select(*by, at, "unit", F.lit("fleet").alias("kind"), fill.alias("mw"))
    return cases, wind.unionByName(firm)
