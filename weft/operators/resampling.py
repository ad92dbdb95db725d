"""Bootstraps as rows: every draw is a hash of (seed, group, replicate, slot), so that any engine, task or retry draws the same.

A replicate of a group of n numbered units draws n of them: exactly multinomial, one row a draw, joined to the units by number and summed.
Draws of a group are spread over the cluster by replicate. An interval is given only where a group has enough units.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.functions.shared import hint_if_small, materialize
from weft.operators.stats import numbered


def hash_below(key: Column, n: Column) -> Column:
    """A number from 0 to n - 1 from the first 32 bits of the md5 of key."""
    return F.shiftright(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") * n, 32)


def draws(groups: DataFrame, by: list[str], n: str, replicates: int, seed: str) -> DataFrame:
    """(by, rep, unit, times) for groups(by, n): how often a replicate draws each unit; units it does not draw have no row."""
    rows = groups.where(F.col(n) > 0).select(*by, F.col(n).alias("_n"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
    rows = rows.repartition(max(replicates, 2 * groups.sparkSession.sparkContext.defaultParallelism), *by, "rep")  # by number: AQE would put these few rows into one task
    rows = rows.withColumn("_slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    unit = hash_below(F.concat_ws(":", F.lit(seed), *by, "rep", "_slot"), F.col("_n"))
    return rows.groupBy(*by, "rep", unit.alias("unit")).agg(F.count("*").alias("times"))


def numbered_units(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """df with ``unit``, from 0 in order within the group, and ``n``, the group's units; a row is a unit (a week, a snapshot). One sort over the cluster."""
    rows = materialize(numbered(df, [*[F.col(c) for c in by], *[F.col(c) for c in order]], "_at"), "units")
    groups = rows.groupBy(*by).agg(F.min("_at").alias("_from"), F.count("*").alias("n"))
    return rows.join(hint_if_small(groups), by).withColumn("unit", F.col("_at") - F.col("_from")).drop("_at", "_from")


def interval(stats: DataFrame, by: list[str], x: str, level: float = 0.95) -> DataFrame:
    """(by, low, high): percentile interval over a group's replicates."""
    q = F.percentile(x, F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    return stats.groupBy(*by).agg(q.alias("_q")).select(*by, F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"))


def ratio_bootstrap(blocks: DataFrame, by: list[str], order: list[str], num: str, den: str, replicates: int, seed: str, least: int = 2) -> DataFrame:
    """(by, ratio, low, high, n): the ratio of sums and its interval by resampling blocks; no interval below ``least`` blocks or where all draws are null."""
    units = numbered_units(blocks, by, order)
    whole = units.groupBy(*by).agg(F.try_divide(F.sum(num), F.sum(den)).alias("ratio"), F.count("*").alias("n"))
    drawn = draws(whole.where(F.col("n") >= least).select(*by, "n"), by, "n", replicates, seed).join(units.select(*by, "unit", num, den), [*by, "unit"])
    sums = drawn.groupBy(*by, "rep").agg(F.try_divide(F.sum(F.col("times") * F.col(num)), F.sum(F.col("times") * F.col(den))).alias("_r"))
    return whole.join(interval(sums, by, "_r"), by, "left").select(*by, "ratio", "low", "high", "n")


def panel_bootstrap(panel: DataFrame, by: list[str], at: str, member: list[str], x: str, w: str, replicates: int, seed: str, thin: float = 1.0) -> DataFrame:
    """Resamples the times of a group for all of its members (edges) together. (by, mean, low, high, spread, se, thin, n): the members' mean statistic (the
    weighted mean of x), its interval, the members' standard deviation, the median standard error of a member by that deviation, and whether the
    interval is wider than ``thin`` deviations (or there is none): too few times to tell members apart."""
    times = numbered_units(panel.select(*by, at).distinct(), by, [at])
    drawn = draws(times.select(*by, "n").distinct(), by, "n", replicates, seed).join(times.select(*by, at, "unit"), [*by, "unit"])
    mean = lambda k: F.try_divide(F.sum(k * F.col(w) * F.col(x)), F.sum(k * F.col(w)))
    point = panel.groupBy(*by, *member).agg(mean(F.lit(1)).alias("_m")).groupBy(*by).agg(F.avg("_m").alias("mean"), F.stddev_pop("_m").alias("spread"))
    each = panel.select(*by, at, *member, x, w).join(drawn.select(*by, at, "rep", "times"), [*by, at]).groupBy(*by, "rep", *member).agg(mean(F.col("times")).alias("_m"))
    middle = interval(each.groupBy(*by, "rep").agg(F.avg("_m").alias("_m")), by, "_m")
    errors = each.groupBy(*by, *member).agg(F.stddev_pop("_m").alias("_e")).groupBy(*by).agg(F.median("_e").alias("_e"))
    rows = point.join(middle, by).join(errors, by).join(times.select(*by, "n").distinct(), by)
    width = F.try_divide(F.col("high") - F.col("low"), F.col("spread"))
    return rows.select(*by, "mean", "low", "high", "spread", F.try_divide("_e", "spread").alias("se"), F.coalesce(width > thin, F.lit(True)).alias("thin"), "n")


def _rank_correlation(rows: DataFrame, keys: list[str], x: str, y: str, times: str) -> DataFrame:
    """(keys, rho, n) with rows counted ``times``; ranks are doubled whole numbers, the average of ties."""

    def ranked(df: DataFrame, c: str, into: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(c)
        upto, own = F.sum(times).over(w), F.sum(times).over(w.rangeBetween(Window.currentRow, Window.currentRow))  # one sort for both
        return df.withColumn(into, 2 * upto - own + 1)

    r = ranked(ranked(rows, x, "_x"), y, "_y")
    s = lambda c: F.sum(F.col(times) * c).cast("double")
    a, b, k = F.col("_x"), F.col("_y"), F.sum(times).cast("double")
    m = r.groupBy(*keys).agg(k.alias("n"), s(a).alias("a"), s(b).alias("b"), s(a * a).alias("aa"), s(b * b).alias("bb"), s(a * b).alias("ab"))
    both = (F.col("aa") - F.col("a") * F.col("a") / F.col("n")) * (F.col("bb") - F.col("b") * F.col("b") / F.col("n"))
    return m.select(*keys, F.try_divide(F.col("ab") - F.col("a") * F.col("b") / F.col("n"), F.sqrt(both)).alias("rho"), F.col("n").cast("long").alias("n"))


def spearman_bootstrap(df: DataFrame, by: list[str], order: list[str], x: str, y: str, replicates: int, seed: str, least: int = 30) -> DataFrame:
    """(by, rho, low, high, n): rank correlation with its interval by resampling pairs, ranks taken anew in each replicate; none below ``least`` pairs."""
    units = materialize(numbered_units(df, by, order).select(*by, "unit", x, y), "numbered-units")
    whole = _rank_correlation(units.withColumn("_t", F.lit(1)), by, x, y, "_t")
    drawn = draws(whole.where(F.col("n") >= least).select(*by, "n"), by, "n", replicates, seed).join(hint_if_small(units, 1_000_000), [*by, "unit"])
    found = _rank_correlation(drawn, [*by, "rep"], x, y, "times")
    return whole.join(interval(found, by, "rho"), by, "left").select(*by, "rho", "low", "high", "n")
