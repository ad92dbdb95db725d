"""Quantiles, recurrences and bootstraps that hold no group in one task, against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.operators import resampling as R
from weft.operators import scans as X
from weft.operators import selection as S


def table(seed=1, n=3000):
    """Even, heavy-tailed, infinite, tied, single and missing values by group."""
    rng = random.Random(seed)
    rows = [("even", rng.uniform(-5, 9), rng.randint(0, 9)) for _ in range(n)]
    rows += [("tail", rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300), rng.randint(1, 3)) for _ in range(n)]
    rows += [("tied", float(rng.randint(1, 4)), rng.randint(1, 3)) for _ in range(n)]
    rows += [("ends", rng.choice([math.inf, -math.inf, 0.0, 1.5]), 1) for _ in range(200)]
    return rows + [("one", 4.0, 2), ("none", None, 1), ("none", math.nan, 1), (None, 3.0, 1), (None, 8.0, 2)]


@pytest.mark.parametrize("options", [{}, {"hot": 50, "few": 4, "bins": 8}, {"hot": 0, "few": 1, "bins": 64}])
def test_weighted_quantiles_and_percentiles(spark, options):
    rows = table()
    df = spark.createDataFrame(rows, "g string, x double, w long").repartition(4)
    want_q, want_p = {}, {}
    for g in {g for g, *_ in rows}:
        mine = sorted((x, w) for h, x, w in rows if h == g and x is not None and not math.isnan(x))
        if mine:
            total, cum = sum(w for _, w in mine), 0
            for x, w in mine:
                cum += w
                if cum * 20 >= total * 19:
                    want_q[g] = x
                    break
            if g != "ends":
                want_p[g] = np.quantile([x for x, _ in mine], [0.0, 0.37, 1.0])
    got = {r["g"]: r["quantile"] for r in S.weighted_quantile(df, ["g"], "x", "w", 19, 20, **options).collect()}
    assert got == want_q
    got = {r["g"]: r["q"] for r in S.percentiles(df.where("g is null or g <> 'ends'"), ["g"], "x", [0.0, 0.37, 1.0], **options).collect()}
    assert got.keys() == want_p.keys() and all(np.allclose(got[g], want_p[g], rtol=1e-12) for g in got)


def test_quantile_without_groups_of_whole_numbers(spark):
    df = spark.range(10_000).select((F.col("id") * 7919 % 10_007 + (1 << 60)).alias("x"))
    got = S.percentiles(df, [], "x", [0.5], hot=100, few=10, bins=16).first()["q"]
    assert got[0] == pytest.approx(np.quantile(sorted((i * 7919 % 10_007) + (1 << 60) for i in range(10_000)), 0.5))
    assert S.weighted_quantile(df.limit(0).withColumn("w", F.lit(1)), [], "x", "w", 1, 2, hot=0).count() == 0


@pytest.mark.parametrize("size", [8, 256])
def test_exponential_lag_of_whole_series(spark, size):
    rng = random.Random(2)
    rows = [(g, k, rng.uniform(-9, 9) if rng.random() > 0.05 else None) for g, n in (("a", 900), ("b", 1), ("c", 33), (None, 70)) for k in range(n)] + [("d", 0, None)]
    want = {}
    for g in ("a", "b", "c", None):
        y = None
        for h, k, x in rows:
            if h == g and x is not None:
                y = x if y is None else y + 0.25 * (x - y)
                want[(g, k)] = y
    df = spark.createDataFrame(rows, "g string, k long, x double").repartition(5)
    got = {(r["g"], r["k"]): r["y"] for r in X.exponential_lag(df, ["g"], [F.col("k")], "x", 0.25, "y", size).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert X.exponential_lag(df.limit(0), ["g"], [F.col("k")], "x", 0.25, "y").count() == 0


def test_lag_of_uneven_steps(spark):
    df = spark.createDataFrame([(k, 0.5 * k, float(k % 3)) for k in range(40)], "k long, dt double, x double")
    got = [r["y"] for r in X.exponential_lag(df, [], [F.col("k")], "x", 1 - F.exp(-F.col("dt")), "y", 4).orderBy("k").collect()]
    y = 0.0
    for k in range(40):
        y = y + (1 - math.exp(-0.5 * k)) * (k % 3 - y) if k else 0.0
        assert got[k] == pytest.approx(y)


def pick(seed, g, rep, slot, n):
    return (int(hashlib.md5(f"{seed}:{g}:{rep}:{slot}".encode()).hexdigest()[:8], 16) * n) >> 32


def test_ratio_bootstrap_by_hand(spark):
    rng = random.Random(4)
    rows = [(g, k, rng.randint(-50, 90), rng.randint(1, 9)) for g, n in (("a", 40), ("b", 2), ("c", 1)) for k in range(n)] + [("z", 0, 5, 0), ("z", 1, 5, 0)]
    got = {r["g"]: r for r in R.ratio_bootstrap(spark.createDataFrame(rows, "g string, k long, x long, w long"), ["g"], ["k"], "x", "w", 60, "s").collect()}
    for g in "ab":
        mine = [(x, w) for h, _, x, w in rows if h == g]
        stats = []
        for rep in range(60):
            drawn = [mine[pick("s", g, rep, slot, len(mine))] for slot in range(len(mine))]
            stats.append(sum(x for x, _ in drawn) / sum(w for _, w in drawn))
        assert (got[g]["low"], got[g]["high"]) == pytest.approx(tuple(np.quantile(stats, [0.025, 0.975])))
        assert got[g]["low"] <= got[g]["ratio"] <= got[g]["high"]
    assert got["c"]["low"] is None and got["c"]["n"] == 1 and got["z"]["ratio"] is None


def test_a_constant_difference_has_no_interval_to_speak_of(spark):
    """Paired weeks that all differ by the same have an interval of width 0; a disturbed one has not."""
    rng = np.random.default_rng(1)
    weeks = [("flat", k, -10 * 168, 168) for k in range(6)] + [("rough", k, int(-10 * 168 + rng.normal(0, 3000)), 168) for k in range(6)]
    got = {r["g"]: r for r in R.ratio_bootstrap(spark.createDataFrame(weeks, "g string, k long, x long, w long"), ["g"], ["k"], "x", "w", 200, "w").collect()}
    assert got["flat"]["low"] == got["flat"]["high"] == got["flat"]["ratio"] == -10
    assert got["rough"]["low"] < got["rough"]["ratio"] < got["rough"]["high"]


def test_draws_are_multinomial(spark):
    groups = spark.createDataFrame([("a", 7), ("b", 0)], "g string, n long")
    rows = R.draws(groups, ["g"], "n", 2000, "t").collect()
    assert all(sum(r["times"] for r in rows if r["rep"] == k) == 7 for k in range(0, 2000, 99)) and {r["g"] for r in rows} == {"a"}
    share = [sum(r["times"] for r in rows if r["unit"] == u) / 14_000 for u in range(7)]
    assert max(abs(s - 1 / 7) for s in share) < 0.015
    twice = sum(r["times"] > 1 for r in rows) / len(rows)
    assert 0.2 < twice < 0.5


def test_rank_bootstrap_needs_thirty_pairs(spark):
    rng = random.Random(5)
    rows = [("a", k, k // 2, k + rng.randint(-9, 9)) for k in range(60)] + [("b", k, k, -k) for k in range(29)] + [("c", k, 1, k) for k in range(40)]
    got = {r["g"]: r for r in R.spearman_bootstrap(spark.createDataFrame(rows, "g string, k long, x long, y long"), ["g"], ["k"], "x", "y", 50, "r").collect()}

    def rho(pairs):
        ranks = [np.array([sum(v < u for v in c) + (sum(v == u for v in c) + 1) / 2 for u in c]) for c in zip(*pairs, strict=True)]
        return np.corrcoef(*ranks)[0, 1]

    mine = [(x, y) for g, _, x, y in rows if g == "a"]
    stats = [rho([mine[pick("r", "a", rep, slot, 60)] for slot in range(60)]) for rep in range(50)]
    assert got["a"]["rho"] == pytest.approx(rho(mine)) and (got["a"]["low"], got["a"]["high"]) == pytest.approx(tuple(np.quantile(stats, [0.025, 0.975])))
    assert got["b"]["rho"] == pytest.approx(-1) and got["b"]["low"] is None and got["c"]["rho"] is None


def test_panel_bootstrap_tells_thin_groups(spark):
    rng = random.Random(6)
    rows = [(g, k, e, 100.0 * e + (noise * rng.gauss(0, 1)), 1 + k % 3) for g, n, noise in (("long", 80, 5.0), ("thin", 3, 900.0)) for k in range(n) for e in range(4)]
    got = {r["g"]: r for r in R.panel_bootstrap(spark.createDataFrame(rows, "g string, k long, e long, x double, w long"), ["g"], "k", ["e"], "x", "w", 80, "p").collect()}
    assert not got["long"]["thin"] and got["thin"]["thin"] and got["long"]["low"] < got["long"]["mean"] < got["long"]["high"]
    assert got["long"]["spread"] == pytest.approx(112, rel=0.1) and got["long"]["se"] < 0.05


def test_draws_are_spread_over_tasks(spark):
    drawn = R.draws(spark.createDataFrame([("a", 50)], "g string, n long"), ["g"], "n", 40, "s")
    assert drawn.select(F.spark_partition_id().alias("p")).distinct().count() > 10
