"""Queries J01-J21: joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import joins as J
from weft.plans.fixtures import ES, NE, NP, SN, edge_series, nation_edge, node_price, query, snapshots, t


def regions(s, d):
    return t(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("n"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("region"))


def places(s, d):
    """Suppliers as points: group nation, coordinates from the key."""
    return t(s, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("nation"), (F.col("s_suppkey") * 37 % 101).alias("x"), (F.col("s_suppkey") * 53 % 89).alias("y"))


PL = "pl AS (SELECT s_suppkey, s_nationkey::BIGINT AS nation, (s_suppkey * 37 % 101)::BIGINT AS x, (s_suppkey * 53 % 89)::BIGINT AS y FROM supplier)"
CU = "cu AS (SELECT c_custkey, c_nationkey::BIGINT AS nation, (c_custkey * 29 % 101)::BIGINT AS cx, (c_custkey * 61 % 89)::BIGINT AS cy FROM customer)"


def clients(s, d):
    return t(s, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("nation"), (F.col("c_custkey") * 29 % 101).alias("cx"), (F.col("c_custkey") * 61 % 89).alias("cy"))


@query("j01_both_ends", f"WITH {NE} SELECT a, b, x.n_name AS name_a, y.n_name AS name_b FROM ne LEFT JOIN nation x ON x.n_nationkey = a LEFT JOIN nation y ON y.n_nationkey = b")
def j01(s, d):
    return J.both_ends(nation_edge(s, d), regions(s, d), "a", "b", "n", ["name"]).select("a", "b", "name_a", "name_b")


@query("j02_anti_join", f"WITH {NE}, dc AS (SELECT a, b FROM ne WHERE n_lines % 3 = 0), ac AS (SELECT a, b FROM ne WHERE n_lines % 2 = 0) SELECT a, b FROM dc WHERE NOT EXISTS (SELECT 1 FROM ac WHERE ac.a = dc.a AND ac.b = dc.b)")
def j02(s, d):
    ne = nation_edge(s, d)
    return ne.where("n_lines % 3 = 0").select("a", "b").join(ne.where("n_lines % 2 = 0").select("a", "b"), ["a", "b"], "left_anti")


@query("j03_endpoint_difference", f"WITH {ES} SELECT a, b, count(*)::BIGINT AS hours, sum(dp)::BIGINT AS total FROM es GROUP BY 1, 2")
def j03(s, d):
    return edge_series(s, d).groupBy("a", "b").agg(F.count("*").alias("hours"), F.sum("dp").alias("total"))


@query("j04_enrich", """SELECT n_nationkey::BIGINT AS n, coalesce(c, 0)::BIGINT AS customers, coalesce(q, 0)::BIGINT AS suppliers FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) ON n_nationkey = c_nationkey
LEFT JOIN (SELECT s_nationkey, count(*) AS q FROM supplier GROUP BY 1) ON n_nationkey = s_nationkey""")
def j04(s, d):
    base = t(s, d, "nation").select("n_nationkey")
    people = t(s, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    firms = t(s, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    return base.join(people, "n_nationkey", "left").join(firms, "n_nationkey", "left").fillna(0).select(F.col("n_nationkey").cast("long").alias("n"), "customers", "suppliers")


@query("j05_composite_merge", f"WITH {NE}, z AS (SELECT a, b, J * 2 AS J FROM ne WHERE a % 2 = 0) SELECT ne.a, ne.b, ne.J AS J_x, coalesce(z.J, -1)::BIGINT AS J_y FROM ne LEFT JOIN z ON ne.a = z.a AND ne.b = z.b")
def j05(s, d):
    ne = nation_edge(s, d)
    z = ne.where("a % 2 = 0").select("a", "b", (F.col("J") * 2).alias("J_y"))
    return ne.select("a", "b", F.col("J").alias("J_x")).join(z, ["a", "b"], "left").fillna(-1)


@query("j06_reproduction_check", f"WITH {NP}, z AS (SELECT month, nation, price + (nation % 3) AS price FROM np) SELECT max(abs(np.price - z.price))::BIGINT AS worst, count(*)::BIGINT AS n FROM np JOIN z USING (month, nation)")
def j06(s, d):
    np = node_price(s, d)
    z = np.select("month", "nation", (F.col("price") + F.col("nation") % 3).alias("other"))
    return np.join(z, ["month", "nation"]).agg(F.max(F.abs(F.col("price") - F.col("other"))).alias("worst"), F.count("*").alias("n"))


@query("j07_paired_runs", """WITH m AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, l_returnflag AS f, sum(l_quantity::BIGINT)::BIGINT AS q FROM lineitem GROUP BY 1, 2)
SELECT x.month, x.q AS qa, y.q AS qr, (x.q - y.q)::BIGINT AS diff FROM m x JOIN m y USING (month) WHERE x.f = 'A' AND y.f = 'R' AND x.q > 100 AND y.q > 100""")
def j07(s, d):
    m = t(s, d, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month"), F.col("l_returnflag").alias("f")).agg(F.sum(F.col("l_quantity").cast("long")).alias("q"))
    both = m.where("f = 'A' and q > 100").select("month", F.col("q").alias("qa")).join(m.where("f = 'R' and q > 100").select("month", F.col("q").alias("qr")), "month")
    return both.withColumn("diff", F.col("qa") - F.col("qr"))


@query("j08_spine", f"WITH {NP}, {SN}, sp AS (SELECT month, n_nationkey::BIGINT AS nation FROM sn, nation) SELECT month, nation, coalesce(weight, 0)::BIGINT AS weight FROM sp LEFT JOIN np USING (month, nation)")
def j08(s, d):
    spine = snapshots(s, d).select("month").crossJoin(F.broadcast(regions(s, d).select(F.col("n").alias("nation"))))
    return J.to_spine(spine, node_price(s, d).select("month", "nation", "weight"), ["month", "nation"], {"weight": 0})


@query("j09_nearest", f"WITH {PL}, {CU} SELECT c_custkey, arg_min(s_suppkey, ((cx - x) * (cx - x) + (cy - y) * (cy - y), s_suppkey)) AS nearest, min((cx - x) * (cx - x) + (cy - y) * (cy - y))::BIGINT AS d2 FROM cu JOIN pl USING (nation) GROUP BY 1")
def j09(s, d):
    return J.nearest(clients(s, d), places(s, d), ["nation"], "c_custkey", "s_suppkey", "cx", "cy", "x", "y").select("c_custkey", "nearest", F.col("d2").cast("long").alias("d2"))


@query("j12_semi_join", f"WITH {NP} SELECT month, nation, price FROM np WHERE month IN (SELECT month FROM np GROUP BY 1 HAVING sum(weight) > 190) AND nation IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def j12(s, d):
    np = node_price(s, d)
    hours = np.groupBy("month").agg(F.sum("weight").alias("w")).where("w > 190").select("month")
    return np.join(hours, "month", "left_semi").join(regions(s, d).where("region = 1").select(F.col("n").alias("nation")), "nation", "left_semi").select("month", "nation", "price")


@query("j13_new_overloads", """WITH o AS (SELECT l_returnflag AS f, l_linestatus AS st, l_suppkey AS m, (l_partkey % 50)::BIGINT AS k FROM lineitem WHERE l_quantity > 45 GROUP BY 1, 2, 3, 4)
SELECT st, m, k FROM o x WHERE f = 'A' AND NOT EXISTS (SELECT 1 FROM o y WHERE y.f = 'N' AND y.st = 'O' AND y.m = x.m AND y.k = x.k)""")
def j13(s, d):
    o = t(s, d, "lineitem").where("l_quantity > 45").select(F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("st"), F.col("l_suppkey").alias("m"), (F.col("l_partkey") % 50).alias("k")).distinct()
    return o.where("f = 'A'").join(o.where("f = 'N' and st = 'O'").select("m", "k"), ["m", "k"], "left_anti").select("st", "m", "k")


@query("j14_parameter_grid", """SELECT DISTINCT r_name || '-' || a::VARCHAR || '-' || k::VARCHAR AS config FROM region, (SELECT unnest([1, 2, 5]) AS a), (SELECT unnest([0, 1]) AS k)""")
def j14(s, d):
    a, k = s.range(1).select(F.explode(F.array(*map(F.lit, (1, 2, 5)))).alias("a")), s.range(2).select(F.col("id").alias("k"))
    return t(s, d, "region").select("r_name").crossJoin(a).crossJoin(k).select(F.concat_ws("-", "r_name", "a", "k").alias("config")).distinct()


@query("j15_candidate_pairs", f"""WITH {NE}, p AS (SELECT n_nationkey::BIGINT AS n, (n_nationkey * 7 % 25)::DOUBLE AS x, (n_nationkey * 11 % 25)::DOUBLE AS y FROM nation)
SELECT u.n AS a, v.n AS b, (ne.a IS NOT NULL) AS exists_, round(sqrt((u.x - v.x) * (u.x - v.x) + (u.y - v.y) * (u.y - v.y)), 6) AS length FROM p u JOIN p v ON u.n < v.n LEFT JOIN ne ON ne.a = u.n AND ne.b = v.n""")
def j15(s, d):
    p = regions(s, d).select("n", (F.col("n") * 7 % 25).alias("x"), (F.col("n") * 11 % 25).alias("y"))
    u, v = p.toDF("a", "xa", "ya"), p.toDF("b", "xb", "yb")
    pairs = u.join(F.broadcast(v), F.col("a") < F.col("b"))  # a node table, by design of the screen
    edges = nation_edge(s, d).select("a", "b", F.lit(True).alias("e"))
    return pairs.join(edges, ["a", "b"], "left").select("a", "b", F.coalesce("e", F.lit(False)).alias("exists_"), F.round(F.hypot((F.col("xa") - F.col("xb")).cast("double"), (F.col("ya") - F.col("yb")).cast("double")), 6).alias("length"))


@query("j16_neighbourhood_sum", f"WITH {NE} SELECT n, round(sum(1 / (1 + abs(n - m)::DOUBLE)), 6) AS near FROM (SELECT a AS n, b AS m FROM ne UNION ALL SELECT b, a FROM ne) GROUP BY 1")
def j16(s, d):
    ne = nation_edge(s, d)
    both = ne.select(F.col("a").alias("n"), F.col("b").alias("m")).union(ne.select("b", "a"))
    return both.groupBy("n").agg(F.round(F.sum(1 / (1 + F.abs(F.col("n") - F.col("m")))), 6).alias("near"))


@query("j17_dense_relabel", """SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand, p_size % 4)::BIGINT AS zone FROM part""")
def j17(s, d):
    part = t(s, d, "part").select("p_partkey", "p_brand", (F.col("p_size") % 4).alias("k"))
    return J.dense_ids(part, ["p_brand", "k"], "zone").select("p_partkey", "zone")


@query("j18_join_on_key_not_order", """WITH f AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1), g AS (SELECT l_suppkey, max(l_quantity) AS q FROM lineitem GROUP BY 1) SELECT l_suppkey, n::BIGINT AS n, q FROM f JOIN g USING (l_suppkey)""")
def j18(s, d):
    line = t(s, d, "lineitem")
    return line.groupBy("l_suppkey").agg(F.count("*").alias("n")).join(line.groupBy("l_suppkey").agg(F.max("l_quantity").alias("q")), "l_suppkey")


@query("j19_cover_check", """WITH c AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_suppkey % 4 = 0 GROUP BY 1)
SELECT (count(*) FILTER (k IS NULL))::BIGINT AS missing, (count(*) FILTER (n_nationkey IS NULL))::BIGINT AS unknown, (count(*) FILTER (n > 1))::BIGINT AS repeated FROM nation FULL JOIN c ON n_nationkey = k""")
def j19(s, d):
    return J.cover_check(t(s, d, "nation"), t(s, d, "supplier").where("s_suppkey % 4 = 0").withColumnRenamed("s_nationkey", "n_nationkey"), "n_nationkey")


@query("j20_bracket_interpolation", """WITH g AS (SELECT p_size % 10 AS k, p_size::DOUBLE AS x, min(p_retailprice) AS y FROM part WHERE p_size % 3 = 0 GROUP BY 1, 2), q AS (SELECT DISTINCT p_size % 10 AS k, p_size + 1.5 AS x FROM part)
SELECT q.k::BIGINT AS k, q.x AS x, round(CASE WHEN lo.x = hi.x THEN lo.y ELSE lo.y + (hi.y - lo.y) * (q.x - lo.x) / (hi.x - lo.x) END, 6) AS value FROM q
JOIN LATERAL (SELECT max(x) AS x, arg_max(y, x) AS y FROM g WHERE g.k = q.k AND g.x <= q.x) lo ON true JOIN LATERAL (SELECT min(x) AS x, arg_min(y, x) AS y FROM g WHERE g.k = q.k AND g.x >= q.x) hi ON true""")
def j20(s, d):
    part = t(s, d, "part").withColumn("k", (F.col("p_size") % 10).cast("long"))
    grid = part.where("p_size % 3 = 0").groupBy("k", F.col("p_size").cast("double").alias("x")).agg(F.min("p_retailprice").alias("y"))
    asked = part.select("k", (F.col("p_size") + F.expr("cast(1.5 as double)")).alias("x")).distinct()
    return J.bracket(asked.withColumnRenamed("x", "at"), grid, ["k"], "at", "x", "y").select("k", F.col("at").alias("x"), F.round("value", 6).alias("value"))


@query("j21_zonal_network", f"WITH {NE} SELECT least(region_a, region_b) AS z0, greatest(region_a, region_b) AS z1, count(*)::BIGINT AS lines, round(0.7 * sum(J)::DOUBLE, 6) AS cap FROM ne WHERE region_a <> region_b GROUP BY 1, 2")
def j21(s, d):
    rows = nation_edge(s, d).where("is_cross").groupBy(F.least("region_a", "region_b").alias("z0"), F.greatest("region_a", "region_b").alias("z1"))
    return rows.agg(F.count("*").alias("lines"), F.round(F.lit(0.7) * F.sum("J"), 6).alias("cap"))
