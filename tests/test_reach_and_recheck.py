"""Nearest sources, patches, farthest points, block products, rechecks and greedy covers against brute force."""

import random

import numpy as np
import pytest

from weft.operators import cover as C
from weft.operators import graph as G
from weft.operators import reach as R
from weft.operators import recheck as K


def graph(seed=1, n=40, m=60):
    rng = random.Random(seed)
    edges = [(a, b, rng.choice([1, 2, 5])) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m))]
    return [*edges, (3, 3, 1), (0, 1, 2), (0, 1, 9), (100, 101, 1)], [*range(n), 100, 101, 200]


def distances(edges, nodes):
    """All shortest lengths (Floyd and Warshall)."""
    inf = float("inf")
    d = {(a, b): 0 if a == b else inf for a in nodes for b in nodes}
    for a, b, w in edges:
        if a != b:
            d[a, b] = d[b, a] = min(d[a, b], w)
    for k in nodes:
        for a in nodes:
            for b in nodes:
                d[a, b] = min(d[a, b], d[a, k] + d[k, b])
    return d


@pytest.mark.parametrize("length, k", [("w", 3), (None, 2), ("w", 1)])
def test_k_nearest_sources(spark, length, k):
    edges, nodes = graph()
    d = distances([(a, b, w if length else 1) for a, b, w in edges], nodes)
    sources = [0, 5, 6, 17, 30, 100, 200]
    got = R.k_nearest_sources(spark.createDataFrame(edges, "a long, b long, w long"), spark.createDataFrame([(s,) for s in [*sources, 5]], "id long"), k, length).collect()
    want = {(v, s, d[s, v], r + 1) for v in nodes for r, s in enumerate(sorted((s for s in sources if d[s, v] < float("inf")), key=lambda s: (d[s, v], s))[:k])}
    assert {(r["id"], r["source"], r["dist"], r["rank"]) for r in got} == want and len(got) == len(want)


def test_block_and_patch(spark):
    edges, nodes = graph()
    d = distances(edges, nodes)
    e, v = spark.createDataFrame(edges, "a long, b long, w long"), spark.createDataFrame([(n,) for n in nodes], "id long")
    got = [(r["id"], r["dist"]) for r in R.nearest_nodes(e, v["id"] == 7, v, 9, "w").collect()]
    assert sorted(got) == sorted(sorted(((n, d[7, n]) for n in nodes if d[7, n] < float("inf")), key=lambda x: (x[1], x[0]))[:9])
    members = [n for n in nodes if n % 3]
    inside = distances([x for x in edges if x[0] in members and x[1] in members], members)
    sets = {min(b for b in members if inside[a, b] < float("inf")): sum(inside[a, b] < float("inf") for b in members) for a in members}
    best = min(sets, key=lambda c: (-sets[c], c))
    assert tuple(R.largest_patch(e, v.where(v["id"].isin(members))).first()) == (best, sets[best])


def test_farthest_points(spark):
    edges, nodes = graph(2, 14, 22)
    d = distances(edges, nodes)
    want = [0]
    while len(want) < 5:
        want.append(max((b for b in nodes if b not in want), key=lambda b: (min(d[c, b] for c in want), -b)))
    got = R.farthest_points(spark.createDataFrame(edges, "a long, b long, w long"), spark.createDataFrame([(n,) for n in nodes], "id long"), 0, 5, "w").orderBy("step").collect()
    assert [r["id"] for r in got] == want and [r["dist"] for r in got][1:] == [min(d[c, b] for c in want[:k]) for k, b in enumerate(want) if k]


@pytest.mark.parametrize("size", [4, 64])
def test_block_product(spark, size):
    rng = random.Random(3)
    a = [(rng.randrange(30), rng.choice([0, 0, 0, rng.randrange(40)]), rng.randint(-5, 5)) for _ in range(300)]  # one hot inner index
    b = [(rng.choice([0, rng.randrange(40)]), rng.randrange(20), rng.randint(-5, 5)) for _ in range(300)]
    x, y = np.zeros((30, 40)), np.zeros((40, 20))
    for i, k, v in a:
        x[i, k] += v
    for k, j, v in b:
        y[k, j] += v
    got = np.zeros((30, 20))
    for r in K.block_product(spark.createDataFrame(a, "i long, k long, v long"), spark.createDataFrame(b, "k long, j long, v long"), size).collect():
        assert r["v"] != 0 and got[r["i"], r["j"]] == 0
        got[r["i"], r["j"]] = r["v"]
    assert (got == x @ y).all()
    assert K.block_product(spark.createDataFrame(a, "i long, k long, v long").limit(0), spark.createDataFrame(b, "k long, j long, v long")).count() == 0


def test_recheck(spark):
    rng = np.random.default_rng(4)
    f, cap, w = rng.normal(0, 100, (9, 12)), rng.uniform(60, 150, 12), rng.integers(1, 5, 9)
    c = np.where(rng.random((12, 12)) < 0.4, rng.normal(0, 0.5, (12, 12)), 0.0)
    rows = lambda m: [(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)]
    got = K.recheck(spark.createDataFrame(rows(f), "t long, branch long, f double"), spark.createDataFrame([(k, float(v)) for k, v in enumerate(cap)], "branch long, cap double"),
                    spark.createDataFrame(rows(c), "monitor long, outage long, c double"), spark.createDataFrame([(k, int(v)) for k, v in enumerate(w)], "t long, w long")).collect()
    want = {}
    for k in range(-1, 12):
        post = f if k < 0 else f + f[:, [k]] * c[:, k][None, :]
        load = np.abs(post) / cap
        for m in range(12):
            if (k < 0 or (c[m, k] != 0 and m != k)) and (load[:, m] > 1 + 1e-6).any():
                want[(m, k)] = (pytest.approx(load[:, m].max()), int(w[load[:, m] > 1 + 1e-6].sum()))
    assert {(r["monitor"], r["outage"]): (r["worst"], r["weight"]) for r in got} == want and len(want) > 20


@pytest.mark.parametrize("batch", [2, 64])
def test_lazy_greedy_cover(spark, batch):
    rng = random.Random(5)
    pairs = [(c, i) for c in range(20) for i in rng.sample(range(60), rng.randint(1, 25))] + [(50, 999)]
    w = {i: rng.choice([1, 1, 2, 7]) for i in range(58)} | {58: 0}
    open_, want = {i for i in w if w[i] > 0} - {i for c, i in pairs if c == 4}, []
    while len(want) < 7:
        gains = {c: sum(w[i] for d, i in pairs if d == c and i in open_) for c in {c for c, _ in pairs}}
        best = min(gains, key=lambda c: (-gains[c], c))
        if not gains[best]:
            break
        want.append((len(want) + 1, best, gains[best]))
        open_ -= {i for c, i in pairs if c == best}
    cover = spark.createDataFrame([*pairs, pairs[0]], "choice long, item long")
    got = C.lazy_greedy_cover(cover, spark.createDataFrame(list(w.items()), "item long, w long"), 7, spark.createDataFrame([(4,)], "choice long"), batch)
    assert [tuple(r) for r in got.orderBy("step").collect()] == want and len(want) > 4
    assert C.lazy_greedy_cover(cover.limit(0), spark.createDataFrame(list(w.items()), "item long, w long"), 3).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_islands_and_stubs(spark, seed):
    rng = random.Random(seed)
    edges = [(a, b) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(62)) if a != b] + [(70, 71), (80, 81), (81, 82), (82, 83), (83, 84), (84, 80), (84, 85), (85, 86), (90, 90)]
    country = {n: ("x" if n % 2 else "y") if n < 60 else "z" for n in range(100)}
    fixed = {3, 86} if seed else set()
    keep, comp = set(), {n: n for n in country}
    for _ in country:
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    keep = {n for n in country if sum(comp[m] == comp[n] for m in country) >= 4}
    left, nodes = [e for e in edges if e[0] in keep], set(keep)
    while True:
        near = {n: {b for a, b in left if a == n and b != n} | {a for a, b in left if b == n and a != n} for n in nodes}
        stubs = {n: min(v) for n, v in near.items() if len(v) == 1 and n not in fixed and country[n] == country[min(v)]}
        gone = {n for n, o in stubs.items() if not (o in stubs and n > o)}
        if not gone:
            break
        nodes -= gone
        left = [e for e in left if e[0] not in gone and e[1] not in gone]
    lines, main = G.drop_islands(spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame(list(country.items()), "id long, country string"), 4)
    got, rest = G.absorb_stubs(lines, main, "country", spark.createDataFrame([(n,) for n in fixed], "id long") if fixed else None)
    assert sorted(tuple(r) for r in got.collect()) == sorted(left) and {r["id"] for r in rest.collect()} == nodes and nodes < keep


def test_anchors(spark):
    """Two regions: a zone in two parts, a node attached to a host of another zone, a zone of attached nodes only."""
    labels = spark.createDataFrame([(1, "x", 10), (2, "x", 10), (3, "x", 10), (4, "x", 11), (5, "x", 12), (6, "y", 20), (7, "y", 20), (8, "y", 20)], "id long, country string, zone long")
    edges = spark.createDataFrame([(1, 2), (3, 4), (6, 7)], "a long, b long")
    cap = spark.createDataFrame([(i, i) for i in range(1, 8)], "id long, cap long")
    hosts = spark.createDataFrame([(5, 4), (8, 6)], "id long, host long")
    got = {r["zone"]: (r["anchor"], r["capacity"], r["n"], r["attached"], r["wrong_host"], r["parts"], r["contiguous"]) for r in G.anchors(labels, edges, cap, hosts).collect()}
    assert got == {10: (0, 6, 3, 0, 0, 2, False), 11: (1, 9, 1, 0, 0, 1, True), 12: (None, 0, 0, 1, 1, 0, False), 20: (0, 13, 2, 1, 0, 1, True)}
