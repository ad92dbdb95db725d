"""Kernels against plain versions."""

import itertools
import time

import numpy as np
import pandas as pd
import pytest

from weft.operators.kernels import dynamics as D
from weft.operators.kernels import lp
from weft.operators.kernels import partition as P
from weft.plans import catalog

RNG = np.random.default_rng(0)


def test_assignment_by_all_permutations():
    for _ in range(50):
        c = RNG.integers(0, 20, (5, 5)).astype(float)
        best = min(sum(c[i, p[i]] for i in range(5)) for p in itertools.permutations(range(5)))
        a = P.assignment(c)
        assert sorted(a) == list(range(5)) and c[np.arange(5), a].sum() == best
    assert P.transfer_distance(np.array([[5, 0], [1, 4], [0, 2]])) == 3


def test_linear_program_against_merit_order():
    gens = pd.DataFrame({"bus": [0, 0, 1], "cap": [50.0, 50.0, 100.0], "cost": [10.0, 30.0, 20.0]})
    lines = pd.DataFrame({"i": [0], "j": [1], "x": [1.0], "s": [200.0]})
    r = lp.dc_opf(lines, gens, np.array([60.0, 60.0]))
    assert r["ok"] and r["gen"] == pytest.approx([50, 0, 70], abs=1e-4) and r["price"] == pytest.approx([20, 20], abs=1e-3)
    tight = lp.dc_opf(lines.assign(s=5.0), gens, np.array([60.0, 60.0]))
    assert tight["ok"] and tight["price"] == pytest.approx([30, 20], abs=1e-3) and abs(tight["flow"][0]) == pytest.approx(5, abs=1e-4)
    short = lp.dc_opf(lines.assign(s=0.001), gens, np.array([150.0, 10.0]))
    assert short["shed"].sum() == pytest.approx(50, abs=0.01) and short["price"][0] == pytest.approx(lp.SHED, rel=1e-4)


def test_flows_follow_angles():
    """Three nodes in a ring: power splits by reactance."""
    lines = pd.DataFrame({"i": [0, 1, 0], "j": [1, 2, 2], "x": [1.0, 1.0, 1.0], "s": [100.0] * 3})
    r = lp.dc_opf(lines, pd.DataFrame({"bus": [0], "cap": [90.0], "cost": [1.0]}), np.array([0.0, 0.0, 30.0]))
    assert r["ok"] and r["flow"] == pytest.approx([10, 10, 20], abs=1e-3)


def test_market_and_redispatch():
    gens = pd.DataFrame({"bus": [0, 1], "cap": [100.0, 100.0], "cost": [10.0, 20.0]})
    m = lp.zonal_market(pd.DataFrame({"i": [0], "j": [1], "cap": [1e4]}), gens.rename(columns={"bus": "zone"}), np.array([20.0, 60.0]))
    assert m["gen"] == pytest.approx([80, 0], abs=1e-3) and m["net"] == pytest.approx([60, -60], abs=1e-3)
    r = lp.redispatch(pd.DataFrame({"i": [0], "j": [1], "x": [1.0], "s": [25.0]}), gens, np.array([20.0, 60.0]), np.array([80.0, 0.0]))
    assert r["ok"] and r["up"] == pytest.approx([0, 35], abs=1e-3) and r["down"] == pytest.approx([35, 0], abs=1e-3)


def test_annealer_finds_planted_zones_and_keeps_them_whole():
    truth = np.repeat([0, 1], 6)
    w = np.where(truth[:, None] == truth[None, :], 1.0, -0.5) * (RNG.random((12, 12)) < 2)
    np.fill_diagonal(w, 0)
    labels, e, frames = P.anneal(w, RNG.integers(2, size=12), np.ones(12), 2, seed=1, sweeps=30, frames=True)
    assert e == pytest.approx(P.energy(w, labels, np.ones(12), 2, 1e-9, 0.0)) and e == pytest.approx(-30)
    assert len(frames) == 40
    chain = np.diag(np.ones(5), 1) + np.diag(np.ones(5), -1)
    near = [np.flatnonzero(chain[i]) for i in range(6)]
    assert P.connected_without(np.zeros(6, int), 0, near) and not P.connected_without(np.zeros(6, int), 2, near)


def test_rigid_annealer_stays_with_its_anchor():
    w = RNG.normal(size=(10, 10))
    w = (w + w.T) / 2
    anchor = np.repeat([0, 1], 5)
    labels, _, _ = P.anneal(w, anchor, np.ones(10), 2, seed=3, sweeps=10, anchor=anchor, rigid=1e4)
    assert (labels == anchor).all()


def test_membership_annealer_resumes_exactly():
    h = lambda m: float(((m.sum(axis=0) - 3) ** 2).sum())
    start = np.zeros((8, 3), int)
    whole = P.anneal_membership(h, start, 5, 300, 5.0, 0.01)
    _, _, state = P.anneal_membership(h, start, 5, 120, 5.0, 0.01 ** (119 / 299) * 5.0 ** (1 - 119 / 299))
    again = P.anneal_membership(h, start, 5, 300, 5.0, 0.01, start=120, state=state)
    assert whole[1] == again[1] == 0.0


def test_relief_clears_or_stops():
    r = P.relieve(np.array([10.0, -3.0]), np.array([5.0, 5.0]), np.array([[1.0, 0.5], [0.0, 0.0]]), np.eye(2), np.array([3.0, 20.0]))
    assert r["worst"] <= 1e-6 and r["by_node"][0] == pytest.approx(3.0)
    assert P.relieve(np.array([10.0]), np.array([5.0]), np.array([[-1.0]]), np.ones((1, 1)), np.array([9.0]))["cut"] == 0


def test_water_fill_and_bisect():
    x = P.water_fill(10, np.array([1.0, 4.0, 20.0]), np.array([1.0, 1.0, 2.0]))
    assert x.sum() == pytest.approx(10) and x == pytest.approx([1, 3, 6])
    assert P.water_fill(99, np.array([1.0, 2.0]), np.ones(2)) == pytest.approx([1, 2])
    assert P.bisect(lambda v: v * v, 2, 0, 2)[0] == pytest.approx(2**0.5) and P.bisect(lambda v: v, 5, 0, 2) == (2, True)


def test_bootstraps():
    x = RNG.random(60)
    r, low, high = P.block_bootstrap(x, np.ones(60), 500, 1)
    assert r == pytest.approx(x.mean()) and low < r < high
    assert np.isnan(P.spearman_bootstrap(np.arange(10.0), np.arange(10.0), 20, 1)[1])
    assert P.spearman_bootstrap(np.arange(40.0), np.arange(40.0) ** 3, 20, 1)[:2] == pytest.approx((1, 1))


def test_polygons():
    square = np.array([[0, 0], [2, 0], [2, 2], [0, 2]], float)
    assert P.area(P.clip_polygon(square + 1, square)) == pytest.approx(1)
    assert len(P.clip_polygon(square + 5, square)) == 0


def test_dynamics():
    a = RNG.normal(size=(6, 6))
    w, v = np.linalg.eig(a)
    assert np.allclose(D.expm(a), (v * np.exp(w)) @ np.linalg.inv(v))
    k = RNG.random((5, 5)) + 0.5
    k = (k + k.T) / 2
    np.fill_diagonal(k, 0)
    p = np.array([0.3, -0.1, 0.2, -0.3, -0.1])
    theta = D.load_flow(k, p)
    assert (k * np.sin(theta[:, None] - theta[None, :])).sum(axis=1) == pytest.approx(p)
    h, damping, times = np.full(5, 0.8), np.full(5, 0.3), np.arange(0, 3, 0.01)
    push = np.array([-0.01, 0, 0, 0, 0])
    lin = D.step_response(D.system(k, theta, h, damping), push / h, times)
    full = D.nonlinear_response(k, p + push, h, damping, theta, times)
    assert np.abs(lin - full).max() < 2e-4
    assert D.readings(lin, times)["rocof"][0] < 0 and (D.readings(lin, times)["nadir"] <= 0).all()


def test_stationary_covariance_solves_its_equation():
    a = RNG.normal(size=(5, 5)) - 4 * np.eye(5)
    q = np.eye(5)
    x = D.lyapunov(a, q)
    assert np.allclose(a @ x + x @ a.T + q, 0)
    k = np.ones((4, 4)) - np.eye(4)
    assert (np.diag(D.stationary(k, np.ones(4), np.full(4, 0.5), np.ones(4))) > 0).all()


def test_edge_screen_equals_a_second_inverse():
    k = np.ones((6, 6)) - np.eye(6)
    lap = np.diag(k.sum(axis=1)) - k
    g = D.green(lap, np.ones(6), np.full(6, 0.2), 1.3)
    e = np.zeros(6)
    e[1], e[4] = 1, -1
    after = D.green(lap + 0.7 * np.outer(e, e), np.ones(6), np.full(6, 0.2), 1.3)
    assert D.edge_screen(g, np.array([1]), np.array([4]), 0.7)[0] == pytest.approx(np.linalg.norm(after - g))


def test_ridge():
    x = RNG.normal(size=(200, 3))
    y = x @ np.array([1.0, -2.0, 0.0]) + 5
    p = D.cross_validated(np.c_[x, np.ones(200)], y, np.arange(200) % 5, 1e-6)
    assert np.abs(p - y).max() < 1e-4


def test_ridge_by_moments():
    x = np.c_[RNG.normal(size=(203, 2)) + 50, np.full(203, 3.0)]
    y, fold = x[:, 0] * 2 + RNG.normal(size=203) + 1000, np.arange(203) % 5
    rows = [np.c_[x, y][fold == f] for f in range(5)]
    n, mean, cov = np.array([float(len(r)) for r in rows]), np.stack([r.mean(axis=0) for r in rows]), np.stack([np.cov(r.T, bias=True) for r in rows])
    for alpha in (1.0, 100.0):
        p = D.cross_validated(x, y, fold, alpha)
        assert D.cross_validated_r2(n, mean, cov, alpha) == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())


def test_ridge_query_takes_every_part(spark, tmp_path):
    key = np.arange(1500, 2600)
    part = pd.DataFrame({"p_partkey": key, "p_name": ["n" * int(k) for k in RNG.integers(3, 30, len(key))], "p_size": RNG.integers(1, 50, len(key)).astype("int32"), "p_brand": [f"b{k % 5}" for k in key]})
    part["p_retailprice"] = 900.0 + 7 * part["p_size"] * np.where(key > 2000, -1, 1) + RNG.normal(size=len(key))
    spark.createDataFrame(part).write.parquet(str(tmp_path / "part.parquet"))
    x, y = np.c_[part["p_name"].str.len(), part["p_size"], key % 7].astype(float), part["p_retailprice"].to_numpy()
    want = {a: 1 - ((y - D.cross_validated(x, y, key % 5, a)) ** 2).sum() / ((y - y.mean()) ** 2).sum() for a in (1.0, 10.0, 100.0)}
    got = {r["alpha"]: r["r2"] for r in catalog.QUERIES["o18_ridge"](spark, str(tmp_path)).where("family = 'without x4' and alpha in (1, 10, 100)").collect()}
    assert got == pytest.approx(want, abs=2e-6)


def test_linear_programs_solve_every_month(spark):
    d = "/root/testdata/sf0.001"
    months = {r["month"] for r in spark.read.parquet(f"{d}/orders.parquet").selectExpr("date_format(o_orderdate, 'yyyy-MM') AS month").distinct().collect()}
    assert min(months) < "1998-01"
    for name in ("o01_dc_opf", "o02_zonal_market", "o03_redispatch"):
        rows = catalog.QUERIES[name](spark, d).collect()
        assert {r["hour"] for r in rows} == months and len(rows) == len(months) * (1 if name == "o03_redispatch" else 25), name


def test_moves_cost_what_the_whole_energy_says():
    rng = np.random.default_rng(11)
    n, k = 40, 4
    w = np.triu(rng.normal(size=(n, n)) * (rng.random((n, n)) < 0.2), 1)
    w, load, labels, anchor = w + w.T, rng.random(n) + 0.1, rng.integers(k, size=n), rng.integers(3, size=n)
    for own, rigid in ((None, 0.0), (anchor, 7.0)):
        state = P.Labelling(w, labels, load, k, 0.3, 2.0, own, rigid)
        now = P.energy(w, labels, load, k, 0.3, 2.0, own, rigid)
        for _ in range(200):
            now += state.move(int(rng.integers(n)), int(rng.integers(k)))
            assert abs(now - P.energy(w, state.labels, load, k, 0.3, 2.0, own, rigid)) < 1e-9


def test_annealer_of_400_nodes_keeps_zones_whole_and_is_quick():
    side = 20
    at = np.arange(side * side).reshape(side, side)
    w = np.zeros((side * side, side * side))
    truth = (at // side // 10 * 2 + at % side // 10).reshape(-1)
    for a, b in [*zip(at[:, :-1].reshape(-1), at[:, 1:].reshape(-1), strict=True), *zip(at[:-1].reshape(-1), at[1:].reshape(-1), strict=True)]:
        w[a, b] = w[b, a] = 1.0 if truth[a] == truth[b] else -1.0
    start = (at % side // 5).reshape(-1)
    began = time.time()
    labels, e, _ = P.anneal(w, start, np.ones(400), 4, seed=2, sweeps=60)
    assert time.time() - began < 60
    assert e == pytest.approx(P.energy(w, labels, np.ones(400), 4, 1e-9, 0.0)) and e < P.energy(w, start, np.ones(400), 4, 1e-9, 0.0)
    state = P.Labelling(w, labels, np.ones(400), 4, 0.0, 0.0, None, 0.0)
    assert all(state.whole(z) for z in np.unique(labels))


def test_redispatch_keeps_net_positions():
    lines = pd.DataFrame({"i": [0, 1, 2, 3], "j": [1, 2, 3, 0], "x": [1.0, 1.0, 1.0, 1.0], "s": [60.0, 20.0, 60.0, 20.0]})
    gens = pd.DataFrame({"bus": [0, 1, 2, 3], "cap": [100.0, 100.0, 100.0, 100.0], "cost": [10.0, 20.0, 30.0, 40.0]})
    load, market, zone = np.array([20.0, 20.0, 50.0, 50.0]), np.array([100.0, 40.0, 0.0, 0.0]), np.array([0, 0, 1, 1])
    free = lp.redispatch(lines, gens, load, market)
    bound = lp.redispatch(lines, gens, load, market, zone=zone, net=np.array([10.0, -10.0]))
    carried = lambda r: r["flow"][1] - r["flow"][3]
    assert free["ok"] and bound["ok"] and carried(free) > 15
    assert carried(bound) == pytest.approx(10, abs=1e-3) and np.abs(bound["slack"]).max() < 1e-3
    far = lp.redispatch(lines, gens, load, market, zone=zone, net=np.array([100.0, -100.0]))  # the lines carry 40 at most
    assert far["ok"] and carried(far) + far["slack"][0] * -1 == pytest.approx(100, abs=1e-2)
