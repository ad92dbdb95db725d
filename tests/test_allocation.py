"""Water filling and calibration against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.operators import allocation as A
from weft.operators.kernels import partition as P


def test_water_fill(spark):
    rng = random.Random(1)
    units = [(g, k, rng.choice([0, 5, 40, 900]), rng.choice([0, 1, 2, 7])) for g, n in (("a", 40), ("b", 3), ("c", 12), ("full", 5), ("dry", 4), ("zero", 3)) for k in range(n)]
    totals = {"a": 3000, "b": 1, "c": 700, "full": 10**6, "dry": -5, "zero": 0, "absent": 9}
    df = spark.createDataFrame(units, "g string, k long, cap long, w long")
    got = {(r["g"], r["k"]): r["mw"] for r in A.water_fill(df, spark.createDataFrame(list(totals.items()), "g string, total long"), ["g"], "cap", "w", "total", "mw").collect()}
    for g in {g for g, *_ in units}:
        mine = [(k, cap, w) for h, k, cap, w in units if h == g]
        cap, w = np.array([c for _, c, _ in mine], float), np.array([x for *_, x in mine], float)
        able = float(cap[w > 0].sum())
        want = P.water_fill(min(max(totals[g], 0), able), np.where(w > 0, cap, 0), w)
        assert [got[(g, k)] for k, *_ in mine] == pytest.approx(want.tolist()), g
        assert sum(got[(g, k)] for k, *_ in mine) == pytest.approx(min(max(totals[g], 0), able))


@pytest.mark.parametrize("sections, rounds", [(32, 8), (2, 40)])
def test_calibration(spark, sections, rounds):
    rng = random.Random(2)
    rows = [(g, rng.uniform(0, 9), rng.randint(1, 5)) for g, n in (("a", 300), ("b", 20), ("c", 1)) for _ in range(n)] + [("calm", 0.01, 1), ("storm", 90.0, 1), (None, 1.0, 1)]
    df = spark.createDataFrame(rows, "g string, v double, w long")
    goals = spark.createDataFrame([(g, 0.4, 0.5, 3.0) for g in ("a", "b", "c", "calm", "storm", "absent")], "g string, goal double, low double, high double")
    power = lambda k: F.least(F.pow(k * F.col("v") / 12, F.lit(3)), F.lit(1.0))
    got = {r["g"]: (r["scale"], r["clipped"]) for r in A.calibrate(df, goals, ["g"], power, F.col("w"), sections, rounds).collect()}
    for g in ("a", "b", "c", "calm", "storm"):
        v, w = (np.array(c, float) for c in zip(*[(x, y) for h, x, y in rows if h == g], strict=True))
        scale, clipped = P.bisect(lambda k: float((w * np.minimum((k * v / 12) ** 3, 1)).sum() / w.sum()), 0.4, 0.5, 3.0)  # noqa: B023
        assert got[g] == (pytest.approx(scale, abs=1e-9), clipped)
    assert got.keys() == {"a", "b", "c", "calm", "storm"} and got["calm"][1] and got["storm"][1]


@pytest.mark.parametrize("snsp", [None, 0.75, 0.1])
def test_dispatch(spark, snsp):
    """Unit by unit, as a loop over the fleet would."""
    rng = random.Random(3)
    fleet = [(g, k, float(rng.randint(0, 3)), float(rng.randint(3, 20)), rng.randint(0, 4)) for g in "ab" for k in range(6)]
    wind = [(g, t, 100 + k, float(rng.choice([0, 5, 40, 90]))) for g in "abc" for t in range(12) for k in range(3) if t or g != "a"]
    demand = [(g, t, float(rng.choice([0, 20, 60, 150, 900]))) for g in "abc" for t in range(12)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    cases, units = A.dispatch(frame(demand, "g string, t long, load double"), frame(wind, "g string, t long, unit long, mw double"), frame(fleet, "g string, unit long, pmin double, pmax double, cost long"), ["g"], "t", snsp)
    got_cases, got_units = {(r["g"], r["t"]): r for r in cases.collect()}, {(r["g"], r["t"], r["unit"]): r["mw"] for r in units.collect()}
    assert len(got_cases) == 36
    for g, t, load in demand:
        plant = sorted([u for u in fleet if u[0] == g], key=lambda u: (u[4], u[1]))
        out, pot = {u[1]: u[2] for u in plant}, [(k, mw) for h, s, k, mw in wind if (h, s) == (g, t)]

        def fill(need):
            for _, k, _, pmax, _ in plant:  # noqa: B023
                add = min(need, max(0.0, pmax - out[k]))  # noqa: B023
                out[k] += add  # noqa: B023
                need -= add
            return need

        total = sum(mw for _, mw in pot)
        lack, cut = load - total - sum(out.values()), 0.0
        short = fill(lack) if lack > 0 else 0.0
        cut = min(-lack, total) if lack < 0 else 0.0
        capped = max(0.0, total - cut - max(snsp * load, 0)) if snsp is not None else 0.0
        short += fill(capped)
        r = got_cases[g, t]
        assert (r["cut"], r["capped"], r["shortage"]) == pytest.approx((cut, capped, short))
        assert [got_units[g, t, k] for k in out] == pytest.approx(list(out.values()))
        assert [got_units[g, t, k] for k, _ in pot] == pytest.approx([mw * (total - cut - capped) / total if total else 0.0 for _, mw in pot])
        if snsp is not None and load > 0:
            assert r["snsp"] <= snsp + 1e-9
