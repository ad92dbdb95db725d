"""Queries A26, A27, A55: bootstraps by hashed draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import resampling as R
from weft.plans.fixtures import ES, RD, edge_series, query, readings, t


def _draws(groups: str, key: str, replicates: int, seed: str) -> str:
    """SQL of resampling.draws for a table of (key, n)."""
    h = f"('0x' || substr(md5(concat_ws(':', '{seed}', {key}, rep, slot)), 1, 8))::BIGINT"
    return f"""dr AS MATERIALIZED (SELECT {key}, rep, unit, count(*) AS times FROM (SELECT {key}, rep, ({h} * n) >> 32 AS unit FROM (
  SELECT *, unnest(range(n)) AS slot FROM (SELECT {key}, n, unnest(range({replicates})) AS rep FROM {groups}))) GROUP BY ALL)"""


@query("a26_block_bootstrap", f"""WITH wk AS (SELECT o_orderpriority AS priority, isoyear(o_orderdate) * 100 + week(o_orderdate) AS week, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS x, count(*) AS k FROM orders GROUP BY 1, 2),
u AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY priority ORDER BY week) - 1 AS unit, count(*) OVER (PARTITION BY priority) AS n FROM wk), g AS (SELECT priority, sum(x) / sum(k)::DOUBLE AS ratio, count(*) AS n FROM u GROUP BY 1),
{_draws("(SELECT * FROM g WHERE n >= 30)", "priority", 400, "weeks")},
r AS (SELECT priority, rep, sum(times * x)::DOUBLE / sum(times * k) AS r FROM dr JOIN u USING (priority, unit) GROUP BY 1, 2),
i AS (SELECT priority, quantile_cont(r, 0.025) AS low, quantile_cont(r, 0.975) AS high FROM r GROUP BY 1)
SELECT priority, round(ratio, 2) AS ratio, round(low, 2) AS low, round(high, 2) AS high, n FROM g LEFT JOIN i USING (priority)""")  # fmt: skip
def a26(s, d):
    """Cents an order by priority, with an interval by weeks; none below 30 weeks."""
    week = F.expr("extract(YEAROFWEEK FROM o_orderdate) * 100 + weekofyear(o_orderdate)")
    weeks = t(s, d, "orders").groupBy(F.col("o_orderpriority").alias("priority"), week.alias("week")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("x"), F.count("*").alias("k"))
    rows = R.ratio_bootstrap(weeks, ["priority"], ["week"], "x", "k", 400, "weeks", least=30)
    return rows.select("priority", *[F.round(c, 2).alias(c) for c in ("ratio", "low", "high")], "n")


@query("a27_snapshot_bootstrap", f"""WITH {ES}, mo AS (SELECT region_a, month, row_number() OVER (PARTITION BY region_a ORDER BY month) - 1 AS unit, count(*) OVER (PARTITION BY region_a) AS n FROM (SELECT DISTINCT region_a, month FROM es)),
{_draws("(SELECT DISTINCT region_a, n FROM mo)", "region_a", 300, "snapshots")}, dm AS (SELECT region_a, month, rep, times FROM dr JOIN mo USING (region_a, unit)),
pe AS (SELECT region_a, a, b, sum(w * dp)::DOUBLE / sum(w) AS m FROM es GROUP BY 1, 2, 3), pt AS (SELECT region_a, avg(m) AS mean, stddev_pop(m) AS spread FROM pe GROUP BY 1),
ea AS MATERIALIZED (SELECT region_a, rep, a, b, sum(times * w * dp)::DOUBLE / sum(times * w) AS m FROM es JOIN dm USING (region_a, month) GROUP BY 1, 2, 3, 4),
ci AS (SELECT region_a, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM (SELECT region_a, rep, avg(m) AS m FROM ea GROUP BY 1, 2) GROUP BY 1),
se AS (SELECT region_a, median(e) AS e FROM (SELECT region_a, a, b, stddev_pop(m) AS e FROM ea GROUP BY 1, 2, 3) GROUP BY 1)
SELECT region_a AS region, round(mean, 4) AS mean, round(low, 4) AS low, round(high, 4) AS high, round(spread, 4) AS spread, round(CASE WHEN spread > 0 THEN e / spread END, 6) AS se,
  coalesce(CASE WHEN spread > 0 THEN (high - low) / spread > 1 END, true) AS thin, n FROM pt JOIN ci USING (region_a) JOIN se USING (region_a) JOIN (SELECT DISTINCT region_a, n FROM mo) USING (region_a)""")  # fmt: skip
def a27(s, d):
    """Mean price difference of a region's edges, with an interval by months, and whether there are too few of them."""
    rows = R.panel_bootstrap(edge_series(s, d), ["region_a"], "month", ["a", "b"], "dp", "w", 300, "snapshots")
    return rows.select(F.col("region_a").alias("region"), *[F.round(c, 4).alias(c) for c in ("mean", "low", "high", "spread")], F.round("se", 6).alias("se"), "thin", "n")


def _rho(rows: str, keys: str, times: str) -> str:
    """SQL of the rank correlation of x and bus; rows counted ``times``."""
    rank = lambda c: f"2 * sum({times}) OVER (PARTITION BY {keys} ORDER BY {c}) - sum({times}) OVER (PARTITION BY {keys}, {c}) + 1"
    s = lambda c: f"sum({times} * {c})::DOUBLE"
    m = f"SELECT {keys}, sum({times})::DOUBLE AS n, {s('p')} AS a, {s('q')} AS b, {s('p * p')} AS aa, {s('q * q')} AS bb, {s('p * q')} AS ab FROM (SELECT *, {rank('x')} AS p, {rank('bus')} AS q FROM {rows}) GROUP BY ALL"
    v = "(aa - a * a / n) * (bb - b * b / n)"
    return f"SELECT {keys}, CASE WHEN {v} > 0 THEN (ab - a * b / n) / sqrt({v}) END AS rho, n::BIGINT AS n FROM ({m})"


@query("a55_rank_bootstrap", f"""WITH {RD}, u AS MATERIALIZED (SELECT *, 1 AS one, row_number() OVER (PARTITION BY config ORDER BY event, bus) - 1 AS unit FROM rd), g AS ({_rho("u", "config", "one")}),
{_draws("(SELECT * FROM g WHERE n >= 30)", "config", 200, "ranks")}, f AS ({_rho("(SELECT config, rep, times, x, bus FROM dr JOIN u USING (config, unit))", "config, rep", "times")}),
i AS (SELECT config, quantile_cont(rho, 0.025) AS low, quantile_cont(rho, 0.975) AS high FROM f GROUP BY 1)
SELECT config, round(rho, 6) AS rho, round(low, 6) AS low, round(high, 6) AS high, n FROM g LEFT JOIN i USING (config)""")  # fmt: skip
def a55(s, d):
    rows = R.spearman_bootstrap(readings(s, d), ["config"], ["event", "bus"], "x", "bus", 200, "ranks")
    return rows.select("config", *[F.round(c, 6).alias(c) for c in ("rho", "low", "high")], "n")
