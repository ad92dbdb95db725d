"""Queries O01-O20, A21, S13: kernels as grouped maps, and the native parts of the scenario layer."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.operators import allocation as A
from weft.operators import measures as M
from weft.operators import recheck as K
from weft.operators import stats as S
from weft.operators.cover import lazy_greedy_cover
from weft.operators.regression import leave_one_out, moments
from weft.operators.kernels import dynamics as D
from weft.operators.kernels import lp
from weft.operators.kernels import partition as P
from weft.plans.fixtures import ES, HR, NE, NP, SN, edge_series, hourly, nation_edge, node_price, query, readings, snapshots, t


def r6(c):
    return F.round(c, 6)


def network(s, d):
    """Lines and generators of the 25 nations (a node table, of fixed size) as pandas."""
    e = nation_edge(s, d).where("J > 5000").orderBy("a", "b").toPandas()
    lines = pd.DataFrame({"i": e["a"], "j": e["b"], "x": 1000.0 / e["J"], "s": e["n_lines"] / 10.0})
    g = t(s, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n")).orderBy("s_nationkey").toPandas()
    gens = pd.DataFrame({"bus": g["s_nationkey"], "cap": 40.0 * g["n"], "cost": 20.0 + (g["s_nationkey"] * 7 % 25)})
    return lines, gens


def loads(s, d):
    """(hour, load) of every hour, dealt over the cluster: a fixed number of partitions is not coalesced, as these few bytes would be."""
    np_ = node_price(s, d)
    full = np_.select("month").distinct().join(F.broadcast(t(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("nation"))))
    rows = full.join(np_.select("month", "nation", "weight"), ["month", "nation"], "left").fillna(0)
    return rows.groupBy(F.col("month").alias("hour")).agg(F.transform(F.array_sort(F.collect_list(F.struct("nation", "weight"))), lambda x: x["weight"].cast("double")).alias("load")).repartition(4 * s.sparkContext.defaultParallelism, "hour")


@query("o01_dc_opf", None)
def o01(s, d):
    return lp.solve_hours(loads(s, d), *network(s, d)).select("hour", "node", F.round("price", 4).alias("price"), F.round("shed", 4).alias("shed"), "ok")


@query("o02_zonal_market", None)
def o02(s, d):
    lines, gens = network(s, d)
    links = lines.rename(columns={"s": "cap"})[["i", "j", "cap"]]
    return lp.solve_hours(loads(s, d), links, gens.rename(columns={"bus": "zone"}), "market").select("hour", "node", F.round("price", 4).alias("price"), F.round("shed", 4).alias("shed"), "ok")


@query("o03_redispatch", None)
def o03(s, d):
    lines, gens = network(s, d)
    links = lines.rename(columns={"s": "cap"})[["i", "j", "cap"]].assign(cap=1e4)
    zone = np.array([r["n_regionkey"] for r in t(s, d, "nation").orderBy("n_nationkey").collect()])  # 25 nations

    def run(batches):
        for pdf in batches:
            out = []
            for hour, load in zip(pdf["hour"], pdf["load"], strict=True):
                x = np.asarray(load, float)
                market = lp.zonal_market(links, gens.rename(columns={"bus": "zone"}), x)
                net = np.bincount(zone, weights=market["net"])
                r = lp.redispatch(lines, gens, x, np.clip(market["gen"], 0, gens["cap"]), zone=zone, net=net)
                out.append((hour, float(r["up"].sum()), float(r["down"].sum()), float(r["shed"].sum()), float(np.abs(r["slack"]).sum()), bool(r["ok"])))
            yield pd.DataFrame(out, columns=["hour", "up", "down", "shed", "slack", "ok"])

    return loads(s, d).mapInPandas(run, "hour string, up double, down double, shed double, slack double, ok boolean").select("hour", *[F.round(c, 3).alias(c) for c in ("up", "down", "shed", "slack")], "ok")


@query("o04_relief", None)
def o04(s, d):
    rows = readings(s, d)

    def run(key, pdf):
        pdf = pdf.sort_values("bus")
        x, bus = pdf["x"].to_numpy(float), pdf["bus"].to_numpy()
        states = 6
        sens = np.cos(np.outer(np.arange(1, states + 1), bus)) / 4 + 0.3
        member = (bus[:, None] % 4 == np.arange(4)[None, :]).astype(float)
        r = P.relieve(sens @ np.abs(x) / 40, np.full(states, 60.0), sens / 40, member, np.abs(x))
        return pd.DataFrame({"config": [key[0]], "event": [key[1]], "cut": [r["cut"]], "worst": [r["worst"]]})

    return rows.groupBy("config", "event").applyInPandas(run, "config string, event string, cut double, worst double").select("config", "event", r6("cut").alias("cut"), r6("worst").alias("worst"))


@query("o05_merit_fill", f"""WITH {NP}, g AS (SELECT n_nationkey::BIGINT AS g, 20 + n_nationkey * 7 % 25 AS cost, 6 AS cap FROM nation), c AS (SELECT g, cap, sum(cap) OVER (ORDER BY cost, g) - cap AS before FROM g), l AS (SELECT month, sum(weight) // 2 AS need FROM np GROUP BY 1)
SELECT month, g, greatest(0, least(cap, need - before))::BIGINT AS mw FROM l, c WHERE need > before""")
def o05(s, d):
    cost = 20 + F.col("n_nationkey") * 7 % 25
    w = Window.orderBy(cost, "n_nationkey").rowsBetween(Window.unboundedPreceding, 0)  # 25 units
    g = t(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("g"), F.lit(6).alias("cap"), (F.sum(F.lit(6)).over(w) - 6).alias("before"))
    need = node_price(s, d).groupBy("month").agg(F.expr("sum(weight) div 2").alias("need"))
    return need.join(F.broadcast(g), F.col("need") > F.col("before")).select("month", "g", F.greatest(F.lit(0), F.least("cap", F.col("need") - F.col("before"))).cast("long").alias("mw"))


O05 = f"""{NP}, u AS (SELECT month, n_regionkey::BIGINT AS g, nation, weight FROM np JOIN nation ON n_nationkey = nation), de AS (SELECT g, month, sum(weight)::BIGINT * 3 AS load FROM u GROUP BY 1, 2),
re AS (SELECT g, month, nation AS unit, weight * (5 + nation % 3) AS mw FROM u WHERE nation % 2 = 0), fl AS (SELECT n_regionkey::BIGINT AS g, n_nationkey::BIGINT AS unit, 2 AS pmin, 6 + n_nationkey * 3 AS pmax, n_nationkey * 7 % 25 AS cost FROM nation WHERE n_nationkey % 2 = 1),
ra AS (SELECT *, pmax - pmin AS head, sum(pmax - pmin) OVER (PARTITION BY g ORDER BY cost, unit) - (pmax - pmin) AS before FROM fl), ft AS (SELECT g, sum(pmin) AS lo, sum(head) AS room FROM ra GROUP BY 1), wt AS (SELECT g, month, sum(mw) AS pot FROM re GROUP BY 1, 2),
c1 AS (SELECT de.*, coalesce(pot, 0) AS pot, lo, room, load - coalesce(pot, 0) - lo AS lack FROM de LEFT JOIN wt USING (g, month) JOIN ft USING (g)), c2 AS (SELECT *, least(greatest(-lack, 0), pot) AS cut FROM c1),
c3 AS (SELECT *, greatest(pot - cut - 0.75::DOUBLE * load, 0) AS capped FROM c2), c4 AS (SELECT *, greatest(lack, 0) + capped AS need, least(greatest(lack, 0) + capped, room) AS rise FROM c3)"""


def _cases(s, d):
    u = node_price(s, d).join(t(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("nation"), F.col("n_regionkey").cast("long").alias("g")), "nation")
    demand = u.groupBy("g", "month").agg((F.sum("weight") * 3).cast("double").alias("load"))
    wind = u.where("nation % 2 = 0").select("g", "month", F.col("nation").alias("unit"), (F.col("weight") * (5 + F.col("nation") % 3)).cast("double").alias("mw"))
    n = F.col("n_nationkey").cast("long")
    fleet = t(s, d, "nation").where("n_nationkey % 2 = 1").select(F.col("n_regionkey").cast("long").alias("g"), n.alias("unit"), F.lit(2.0).alias("pmin"), (6 + n * 3).cast("double").alias("pmax"), (n * 7 % 25).alias("cost"))
    return A.dispatch(demand, wind, fleet, ["g"], "month", 0.75)


@query("o05_cases", f"WITH {O05} SELECT g, month, load::DOUBLE AS load, pot::DOUBLE AS potential, cut::DOUBLE AS cut, round(capped, 6) AS capped, round(need - rise, 6) AS shortage, round((pot - cut - capped) / load, 6) AS snsp FROM c4")
def o05_cases(s, d):
    """Regions as systems: surplus, what the cap on the non-synchronous share takes, shortage."""
    return _cases(s, d)[0].select("g", "month", "load", "potential", "cut", *[F.round(c, 6).alias(c) for c in ("capped", "shortage", "snsp")])


@query("o05_dispatch", f"""WITH {O05} SELECT g, month, unit, 'renewable' AS kind, round(mw * CASE WHEN pot > 0 THEN (pot - cut - capped) / pot ELSE 0 END, 6) AS mw FROM re JOIN c4 USING (g, month)
UNION ALL SELECT g, month, unit, 'fleet', round(pmin + least(head, greatest(rise - before, 0)), 6) FROM c4 JOIN ra USING (g)""")
def o05_dispatch(s, d):
    return _cases(s, d)[1].withColumn("mw", F.round("mw", 6))


@query("o06_water_fill", """WITH u AS (SELECT s_nationkey::BIGINT AS nation, s_suppkey, greatest(round(s_acctbal * 100)::BIGINT, 0) AS cap, 1 + s_suppkey % 5 AS w FROM supplier), tt AS (SELECT nation, sum(cap)::BIGINT * 6 // 10 AS total FROM u GROUP BY 1),
st AS (SELECT nation, cap / w::DOUBLE AS brk, sum(cap) AS cap, sum(w) AS w FROM u GROUP BY 1, 2), c AS (SELECT *, coalesce(sum(cap) OVER (PARTITION BY nation ORDER BY brk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(w) OVER (PARTITION BY nation ORDER BY brk DESC) AS rest FROM st),
l1 AS (SELECT nation, arg_min(level, brk) AS level FROM (SELECT nation, brk, (total - below)::DOUBLE / rest AS level FROM c JOIN tt USING (nation)) WHERE level <= brk GROUP BY 1)
SELECT nation, s_suppkey, round(CASE WHEN total <= 0 THEN 0 ELSE least(cap, coalesce(level, 1e300) * w) END, 4) AS mw FROM u JOIN tt USING (nation) LEFT JOIN l1 USING (nation)""")
def o06(s, d):
    u = t(s, d, "supplier").select(F.col("s_nationkey").cast("long").alias("nation"), "s_suppkey", F.greatest(F.round(F.col("s_acctbal") * 100).cast("long"), F.lit(0)).alias("cap"), (1 + F.col("s_suppkey") % 5).alias("w"))
    totals = u.groupBy("nation").agg(F.expr("sum(cap) * 6 div 10").alias("total"))
    return A.water_fill(u, totals, ["nation"], "cap", "w", "total", "mw").select("nation", "s_suppkey", F.round("mw", 4).alias("mw"))


def _narrowed(rounds: int, sections: int) -> str:
    """SQL that narrows (kind, low, high) round by round, as calibrate does."""
    steps = []
    for k in range(rounds):
        at = f"low + (high - low) * (j / {sections}.0::DOUBLE)"
        steps.append(f"""r{k + 1} AS MATERIALIZED (SELECT kind, low + (high - low) * (n / {sections}.0::DOUBLE) AS low, low + (high - low) * ((n + 1) / {sections}.0::DOUBLE) AS high FROM (
  SELECT kind, low, high, count(*) FILTER (f < 0.5) AS n FROM (SELECT kind, low, high, j, avg(least(greatest((pow(({at}) * speed, 3) - 27) / 1701, 0), 1)) AS f FROM h JOIN r{k} USING (kind), range(1, {sections}) x(j) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3))""")
    return ", ".join(steps)


@query("o07_calibration", f"""WITH {HR}, h AS MATERIALIZED (SELECT kind, v / n / 4000 AS speed FROM hr), e AS MATERIALIZED (SELECT kind, avg(least(greatest((pow(0.5 * speed, 3) - 27) / 1701, 0), 1)) AS a, avg(least(greatest((pow(3.0 * speed, 3) - 27) / 1701, 0), 1)) AS b FROM h GROUP BY 1),
r0 AS (SELECT kind, 0.5::DOUBLE AS low, 3.0::DOUBLE AS high FROM e WHERE a < 0.5 AND b > 0.5), {_narrowed(8, 32)}
SELECT kind, round(CASE WHEN a >= 0.5 THEN 0.5 WHEN b <= 0.5 THEN 3.0 ELSE (low + high) / 2 END, 6) AS scale, low IS NULL AS clipped FROM e LEFT JOIN r8 USING (kind)""")
def o07(s, d):
    h = hourly(s, d).select("kind", (F.col("v") / F.col("n") / 4000).alias("speed"))
    goals = h.select("kind").distinct().select("kind", F.lit(0.5).alias("goal"), F.lit(0.5).alias("low"), F.lit(3.0).alias("high"))
    power = lambda k: F.least(F.greatest((F.pow(k * F.col("speed"), F.lit(3)) - 27) / 1701, F.lit(0.0)), F.lit(1.0))
    return A.calibrate(h, goals, ["kind"], power).withColumn("scale", F.round("scale", 6))


@query("o08_fleet_to_targets", """WITH f AS (SELECT s_nationkey::BIGINT AS nation, s_suppkey, greatest(round(s_acctbal), 0)::BIGINT AS mw FROM supplier), x AS (SELECT *, sum(mw) OVER (PARTITION BY nation) AS tot FROM f)
SELECT nation, s_suppkey, CASE WHEN tot = 0 THEN 'none' WHEN tot > 20000 THEN 'down' ELSE 'up' END AS action, round(CASE WHEN tot = 0 THEN 0 ELSE mw * 20000.0::DOUBLE / tot END, 6) AS mw FROM x""")
def o08(s, d):
    f = t(s, d, "supplier").select(F.col("s_nationkey").cast("long").alias("nation"), "s_suppkey", F.greatest(F.round("s_acctbal"), F.lit(0)).cast("long").alias("mw"))
    x = f.withColumn("tot", F.sum("mw").over(Window.partitionBy("nation")))
    none = F.col("tot") == 0
    return x.select("nation", "s_suppkey", F.when(none, "none").when(F.col("tot") > 20000, "down").otherwise("up").alias("action"), r6(F.when(none, 0.0).otherwise(F.col("mw") * 20000.0 / F.col("tot"))).alias("mw"))


def _restarts(s, d, anchor: bool, frames: bool):
    e = nation_edge(s, d).toPandas()  # a node-size graph: it goes with each restart's task
    w = np.zeros((25, 25))
    w[e["a"], e["b"]] = w[e["b"], e["a"]] = (e["J"] - e["J"].mean()) / e["J"].std()
    zone = np.zeros(25, int)
    zone[e["a"]], zone[e["b"]] = e["region_a"], e["region_b"]
    load = np.bincount(e["a"], weights=e["J"], minlength=25) + np.bincount(e["b"], weights=e["J"], minlength=25)

    def run(key, pdf):
        seed = zlib.crc32(f"restart {key[0]}".encode())
        start = zone if anchor else np.random.default_rng(seed).integers(5, size=25)
        start = np.unique(start, return_inverse=True)[1]
        labels, e0, shots = P.anneal(w, start, load, 5, seed, sweeps=8, floor=0.1, balance=2.0, anchor=zone if anchor else None, rigid=5.0 if anchor else 0.0, frames=frames)
        return pd.DataFrame({"restart": [key[0]], "energy": [round(e0, 6)], "labels": [labels.tolist()], "frames": [len(shots)]})

    return s.range(4).withColumnRenamed("id", "restart").groupBy("restart").applyInPandas(run, "restart long, energy double, labels array<long>, frames long")


@query("o09_potts_annealer", None)
def o09(s, d):
    return _restarts(s, d, anchor=False, frames=False)


@query("o10_rigid_annealer", None)
def o10(s, d):
    return _restarts(s, d, anchor=True, frames=False)


@query("o11_frames_annealer", None)
def o11(s, d):
    return _restarts(s, d, anchor=True, frames=True)


@query("o12_membership_annealer", None)
def o12(s, d):
    size = t(s, d, "nation").join(t(s, d, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left").groupBy("n_nationkey").agg(F.count("s_suppkey").alias("n")).orderBy("n_nationkey").toPandas()["n"].to_numpy(float)

    def run(key, pdf):
        h = lambda m: float(((size @ m - size.sum() / m.shape[1]) ** 2).sum() + (m.sum(axis=1) == 0).sum() * 50.0)
        seed = zlib.crc32(f"config {key[0]}".encode())
        _, _, half = P.anneal_membership(h, np.zeros((len(size), 3), int), seed, 200, 50.0, 0.1)
        m, e, _ = P.anneal_membership(h, np.zeros((len(size), 3), int), seed, 400, 50.0, 0.1, start=200, state=half)
        return pd.DataFrame({"config": [key[0]], "energy": [round(e, 6)], "members": [int(m.sum())]})

    return s.range(4).withColumnRenamed("id", "config").groupBy("config").applyInPandas(run, "config long, energy double, members long")


@query("o13_anchor_selection", f"WITH {ES}, g AS (SELECT a, b, avg((dp > 30000)::INT) AS p, sum(dp) AS s FROM es GROUP BY 1, 2), k AS (SELECT *, sum(s) OVER (ORDER BY s DESC, a, b) AS cum, sum(s) OVER () AS tot FROM g) SELECT a, b, (p >= 0.3) AS guard FROM k WHERE (cum - s) * 10 < tot * 3 OR p >= 0.5")
def o13(s, d):
    g = edge_series(s, d).groupBy("a", "b").agg(F.avg((F.col("dp") > 30000).cast("int")).alias("p"), F.sum("dp").alias("s"))
    k = S.cumulative(g, [], [F.col("s").desc(), "a", "b"], "s")  # one row per edge
    return k.where("(cum - s) * 10 < total * 3 or p >= 0.5").select("a", "b", (F.col("p") >= 0.3).alias("guard"))


def _greedy(steps: int) -> str:
    """SQL of a greedy cover, step by step."""
    out = []
    for k in range(1, steps + 1):
        before = " UNION ALL ".join(f"SELECT choice FROM g{j}" for j in range(1, k)) or "SELECT choice FROM c WHERE false"
        out.append(f"""g{k} AS MATERIALIZED (SELECT {k}::BIGINT AS step, choice, sum(w)::BIGINT AS gain FROM c JOIN it USING (item) WHERE item NOT IN (SELECT item FROM c WHERE choice IN ({before})) GROUP BY choice ORDER BY gain DESC, choice LIMIT 1)""")
    return ", ".join(out) + " " + " UNION ALL ".join(f"SELECT * FROM g{k}" for k in range(1, steps + 1))


@query("o13_greedy_repair", f"""WITH {ES}, e AS (SELECT *, 25 * a + b AS choice FROM es WHERE dp > 30000), it AS (SELECT a * 1000 + substr(month, 1, 4)::BIGINT * 12 + substr(month, 6, 2)::BIGINT - 23800 AS item, sum(w)::BIGINT AS w FROM e GROUP BY 1),
c AS (SELECT DISTINCT choice, x * 1000 + substr(month, 1, 4)::BIGINT * 12 + substr(month, 6, 2)::BIGINT - 23800 AS item FROM (SELECT choice, month, unnest([a, b]) AS x FROM e)), {_greedy(6)}""")
def o13_repair(s, d):
    """Anchors added one by one: the edge that covers most of the failing (nation, month) pairs that are still open."""
    at = F.expr("cast(substr(month, 1, 4) as bigint) * 12 + cast(substr(month, 6, 2) as bigint) - 23800")
    e = edge_series(s, d).where("dp > 30000").select("a", "b", "w", (F.col("a") * 25 + F.col("b")).alias("choice"), at.alias("at"))
    items = e.groupBy((F.col("a") * 1000 + F.col("at")).alias("item")).agg(F.sum("w").alias("w"))
    cover = e.select("choice", F.explode(F.array("a", "b")).alias("x"), "at").select("choice", (F.col("x") * 1000 + F.col("at")).alias("item"))
    return lazy_greedy_cover(cover, items, 6)


@query("o14_network_recheck", f"""WITH {NE}, {NP}, {SN}, tot AS (SELECT n, sum(J)::BIGINT AS tot FROM (SELECT a AS n, J FROM ne UNION ALL SELECT b, J FROM ne) GROUP BY 1),
se AS (SELECT a * 25 + b AS e, a AS n, J * 1000 // tot AS v FROM ne JOIN tot ON n = a UNION ALL SELECT a * 25 + b, b, -(J * 1000 // tot) FROM ne JOIN tot ON n = b),
f AS (SELECT e, month, sum(v * (weight - weight * (nation % 4) // 10))::BIGINT AS f FROM se JOIN np ON nation = n GROUP BY 1, 2 HAVING f <> 0), cap AS (SELECT a * 25 + b AS e, 200 + n_lines % 100 AS cap FROM ne),
en AS (SELECT a * 25 + b AS e, J, unnest([a, b]) AS n FROM ne), lo AS (SELECT x.e AS m, y.e AS k, (x.J * 1000 // (tot - y.J))::DOUBLE / 1000 AS c FROM en x JOIN en y USING (n) JOIN tot USING (n) WHERE x.e <> y.e),
r AS (SELECT e AS monitor, -1 AS outage, w, abs(f)::DOUBLE / cap AS load FROM f JOIN cap USING (e) JOIN sn USING (month)
  UNION ALL SELECT m, k, w, abs(x.f + y.f * c) / cap FROM lo JOIN f x ON x.e = m JOIN f y ON y.e = k AND y.month = x.month JOIN cap ON cap.e = m JOIN sn ON sn.month = x.month WHERE c <> 0)
SELECT monitor, outage::BIGINT AS outage, round(max(load), 6) AS worst, sum(w)::BIGINT AS weight FROM r WHERE load > 1.000001 GROUP BY 1, 2""")
def o14(s, d):
    """Flows after relief (sensitivities x injections, as a product of blocks) against their limits, intact and with any neighbouring branch out."""
    e = nation_edge(s, d).withColumn("e", F.col("a") * 25 + F.col("b"))
    ends = e.select("e", "J", "n_lines", F.posexplode(F.array("a", "b")).alias("side", "n"))
    ends = ends.join(ends.groupBy("n").agg(F.sum("J").alias("tot")), "n")
    share = F.expr("J * 1000 div tot")
    sens = ends.select(F.col("e").alias("i"), F.col("n").alias("k"), F.when(F.col("side") == 0, share).otherwise(-share).alias("v"))
    np_ = node_price(s, d).select(F.expr("cast(substr(month, 1, 4) as bigint) * 12 + cast(substr(month, 6, 2) as bigint)").alias("j"), F.col("nation").alias("k"), F.expr("weight - weight * (nation % 4) div 10").alias("v"))
    flows = K.block_product(sens, np_).select(F.col("j").alias("t"), F.col("i").alias("branch"), F.col("v").alias("f"))
    x, y = ends.select("n", F.col("e").alias("monitor"), F.col("J").alias("Jm"), "tot"), ends.select("n", F.col("e").alias("outage"), F.col("J").alias("Jk"))
    lodf = x.join(y, "n").where("monitor <> outage").select("monitor", "outage", (F.expr("Jm * 1000 div (tot - Jk)") / 1000).alias("c"))
    times = snapshots(s, d).select(F.expr("cast(substr(month, 1, 4) as bigint) * 12 + cast(substr(month, 6, 2) as bigint)").alias("t"), "w")
    return K.recheck(flows, e.select(F.col("e").alias("branch"), (200 + F.col("n_lines") % 100).alias("cap")), lodf, times).withColumn("worst", F.round("worst", 6))


def _grid(s, d):
    e = nation_edge(s, d).toPandas()
    k = np.zeros((25, 25))
    k[e["a"], e["b"]] = k[e["b"], e["a"]] = e["J"] / 1000.0
    return k


@query("o15_swing_response", None)
def o15(s, d):
    k = _grid(s, d)

    def run(key, pdf):
        n, h = len(k), 0.2 + (np.arange(len(k)) % (key[0] + 2)) / 4
        p = np.where(np.arange(n) % 2 == 0, 0.5, -0.5)
        p -= p.mean()
        theta = D.load_flow(k, p)
        times = np.arange(0, 2, 0.02)
        push = np.zeros(n)
        push[0] = -1.0
        lin = D.readings(D.step_response(D.system(k, theta, h, np.full(n, 0.3)), push / h, times), times)
        full = D.readings(D.nonlinear_response(k, p + push, h, np.full(n, 0.3), theta, times), times)
        return pd.DataFrame({"config": key[0], "bus": np.arange(n), "rocof": np.round(lin["rocof"], 6), "nadir": np.round(lin["nadir"], 6), "nonlinear_nadir": np.round(full["nadir"], 6)})

    return s.range(4).withColumnRenamed("id", "config").groupBy("config").applyInPandas(run, "config long, bus long, rocof double, nadir double, nonlinear_nadir double")


@query("o16_stationary_covariance", None)
def o16(s, d):
    k = _grid(s, d)

    def run(key, pdf):
        n = len(k)
        c = D.stationary(k, np.full(n, 0.5) + key[0] / 4, np.full(n, 0.3), np.where(np.arange(n) < 5, 1.0, 0.1))
        return pd.DataFrame({"config": key[0], "bus": np.arange(n), "sd": np.round(np.sqrt(np.diag(c)), 6)})

    return s.range(3).withColumnRenamed("id", "config").groupBy("config").applyInPandas(run, "config long, bus long, sd double")


@query("o17_edge_screen", None)
def o17(s, d):
    k = _grid(s, d)
    lap = np.diag(k.sum(axis=1)) - k
    a, b = np.triu_indices(len(k), 1)

    def run(batches):
        for pdf in batches:
            out = []
            for i in pdf["id"]:
                omega = 0.5 * 1.3**i
                norms = D.edge_screen(D.green(lap, np.full(len(k), 0.5), np.full(len(k), 0.3), omega), a, b, 1.0)
                out.append(pd.DataFrame({"omega": omega, "a": a, "b": b, "sigma": norms}))
            yield pd.concat(out) if out else pd.DataFrame({"omega": [], "a": [], "b": [], "sigma": []})

    rows = s.range(12).mapInPandas(run, "omega double, a long, b long, sigma double")
    return rows.groupBy("a", "b").agg(r6(F.max("sigma")).alias("peak"), F.round(F.max_by("omega", "sigma"), 6).alias("at"))


def _parts(s, d):
    """(event, x1, x2, x3, x4, y): brands as events."""
    p = t(s, d, "part")
    return p.select(F.col("p_brand").alias("event"), F.length("p_name").alias("x1"), F.col("p_size").alias("x2"), (F.col("p_partkey") % 7).alias("x3"), (F.col("p_partkey") % 200).alias("x4"), F.col("p_retailprice").alias("y"))


O18 = ["x1", "x2", "x3", "x4"]


@query("o18_ridge", None)
def o18(s, d):
    """Leave-one-brand-out r2 of all features, of all but one (ablation) and of one that should tell nothing (control), by penalty."""
    families = {"all": O18, "control": ["x3"]} | {f"without {c}": [x for x in O18 if x != c] for c in O18}
    rows = leave_one_out(_parts(s, d), "event", O18, "y", families, [0.0, 0.1, 1.0, 10.0, 100.0, 1000.0])
    return rows.select("family", "alpha", F.round("r2", 6).alias("r2"), "events", "best")


@query("o18_moments", """WITH x AS (SELECT p_brand AS event, length(p_name)::DOUBLE AS x1, p_size::DOUBLE AS x2, (p_partkey % 7)::DOUBLE AS x3, (p_partkey % 200)::DOUBLE AS x4, p_retailprice AS y FROM part),
m AS (SELECT avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, avg(x4) AS m4, avg(y) AS m5 FROM x), z AS (SELECT event, [x1 - m1, x2 - m2, x3 - m3, x4 - m4, y - m5] AS z FROM x, m), p AS (SELECT event, z, unnest(range(1, 6)) AS i FROM z), q AS (SELECT event, i, z, unnest(range(i, 6)) AS j FROM p)
SELECT event, i::BIGINT AS i, j::BIGINT AS j, count(*)::BIGINT AS n, round(sum(z[i] * z[j]) + 0.0000123, 3) + 0 AS p FROM q GROUP BY 1, 2, 3""")
def o18_moments(s, d):
    """Sums of products by brand, one row an entry."""
    at = [(i + 1, j + 1) for i in range(5) for j in range(i, 5)]
    names = F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for i, j in at])
    rows = moments(_parts(s, d), "event", [*O18, "y"]).select("event", "n", F.inline(F.arrays_zip(names.alias("at"), F.col("p"))))
    return rows.select("event", "at.i", "at.j", "n", (F.round(F.col("p") + 0.0000123, 3) + 0).alias("p"))  # off the ties of rounding


@query("o19_scenario_selection", f"""WITH {NP}, st AS (SELECT unnest([20, 10, 5]) AS den), c AS (SELECT *, sum(weight) OVER (PARTITION BY nation ORDER BY price DESC, month) AS cum, sum(weight) OVER (PARTITION BY nation) AS tot FROM np),
k AS (SELECT nation, den, sum(weight) AS w FROM c, st WHERE (cum - weight) * den < tot GROUP BY 1, 2), m AS (SELECT nation, max(den) FILTER (w >= 40) AS den FROM k GROUP BY 1)
SELECT nation, month, den::BIGINT AS den FROM c JOIN m USING (nation) WHERE (cum - weight) * den < tot""")
def o19(s, d):
    rows = S.cumulative(node_price(s, d), ["nation"], [F.col("price").desc(), "month"], "weight")
    steps = s.range(1).select(F.explode(F.array(*[F.lit(x).cast("long") for x in (20, 10, 5)])).alias("den"))
    inside = (F.col("cum") - F.col("weight")) * F.col("den") < F.col("total")
    k = rows.crossJoin(F.broadcast(steps)).where(inside).groupBy("nation", "den").agg(F.sum("weight").alias("w"))  # three steps of widening
    m = k.where("w >= 40").groupBy("nation").agg(F.max("den").alias("den"))
    return rows.join(m, "nation").where(inside).select("nation", "month", "den")


@query("o20_scenario_statistics", f"""WITH {ES}, c AS (SELECT nation AS r, month FROM (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY price DESC, month) AS k FROM np) WHERE k <= 8), g AS (SELECT a, b, round(sum(w * dp)::DOUBLE / sum(w), 6) AS dp FROM es JOIN c ON c.r = a AND c.month = es.month GROUP BY 1, 2) SELECT ne.a, ne.b, ne.J, g.dp FROM ne JOIN g USING (a, b)""")
def o20(s, d):
    hours = node_price(s, d).withColumn("k", F.row_number().over(Window.partitionBy("nation").orderBy(F.col("price").desc(), "month"))).where("k <= 8").select(F.col("nation").alias("a"), "month")
    g = edge_series(s, d).join(hours, ["a", "month"], "left_semi").groupBy("a", "b").agg(r6(S.weighted_mean("dp", "w")).alias("dp"))
    return nation_edge(s, d).select("a", "b", "J").join(g, ["a", "b"])


@query("a21_transfer_distance", None)
def a21(s, d):
    cells = M.contingency(t(s, d, "part"), "p_brand", "p_type")

    def run(pdf):
        return pd.DataFrame({"distance": [P.transfer_distance(pdf.pivot_table(index="b", columns="a", values="n", fill_value=0).to_numpy())]})

    return cells.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(lambda pdf: run(pdf), "distance long")  # a table of label pairs


@query("s13_planted_partition", None)
def s13(s, d):
    def run(key, pdf):
        rng, n = np.random.default_rng(int(key[0])), 60
        truth = np.arange(n) % 3
        a, b = np.triu_indices(n, 1)
        keep = rng.random(len(a)) < np.where(truth[a] == truth[b], 0.3, 0.05)
        return pd.DataFrame({"case": key[0], "a": a[keep], "b": b[keep], "cross": truth[a[keep]] != truth[b[keep]]})

    return s.range(3).withColumnRenamed("id", "case").groupBy("case").applyInPandas(run, "case long, a long, b long, cross boolean")
