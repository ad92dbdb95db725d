"""Queries G01-G19: graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.operators import graph as G
from weft.operators import reach as R
from weft.operators.joins import both_ends, dense_ids
from weft.operators.stats import gap_significance
from weft.plans.fixtures import NE, nation_edge, query, t


def r6(c):
    return F.round(c, 6)


def strong(s, d, most: str = "J > 6300"):
    return nation_edge(s, d).where(most)


COMP = "RECURSIVE " + NE + """, st AS (SELECT a, b, J, region_a, region_b FROM ne WHERE J > 6300), n AS (SELECT n_nationkey::BIGINT AS id FROM nation), both_ AS (SELECT a, b FROM st UNION SELECT b, a FROM st),
rc AS (SELECT id, id AS m FROM n UNION SELECT both_.b, rc.m FROM rc JOIN both_ ON both_.a = rc.id)"""


def nodes(s, d):
    return t(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("zone"))


@query("g01_components", f"WITH {COMP} SELECT id, min(m) AS comp FROM rc GROUP BY 1")
def g01(s, d):
    return G.components(strong(s, d), nodes(s, d))


@query("g02_topology", None)
def g02(s, d):
    """Contract pairs of heavy trade to the nation of more customers, drop islands of fewer than four nations, absorb stubs within a region."""
    e = nation_edge(s, d).select("a", "b", "J")
    rank = t(s, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("id")).agg(F.count("*").alias("v"))
    merged = G.contract(e, e.where("J > 8500").select("a", "b"), rank).groupBy("a", "b").agg(F.sum("J").alias("J")).where("J > 6500")
    heads = merged.select(F.col("a").alias("id")).union(merged.select("b")).distinct()
    lines, left = G.drop_islands(merged, nodes(s, d).join(heads, "id", "left_semi"), 4)
    return G.absorb_stubs(lines, left, "zone")[0]


@query("g03_zone_components", f"""WITH RECURSIVE {NE}, i AS (SELECT a, b, region_a AS zone FROM ne WHERE region_a = region_b AND J > 5000), both_ AS (SELECT a, b FROM i UNION SELECT b, a FROM i), n AS (SELECT n_nationkey::BIGINT AS id, n_regionkey::BIGINT AS zone FROM nation),
rc AS (SELECT id, id AS m FROM n UNION SELECT both_.b, rc.m FROM rc JOIN both_ ON both_.a = rc.id), c AS (SELECT id, min(m) AS comp FROM rc GROUP BY 1)
SELECT zone, count(DISTINCT comp)::BIGINT AS parts, (count(*) FILTER (id NOT IN (SELECT a FROM both_)))::BIGINT AS isolated FROM c JOIN n USING (id) GROUP BY 1""")
def g03(s, d):
    return G.zone_components(strong(s, d, "J > 5000").select("a", "b"), nodes(s, d))


@query("g04_merge_small", None)
def g04(s, d):
    sizes = t(s, d, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("id")).agg(F.count("*").alias("n"))
    return G.merge_small(nation_edge(s, d).select("a", "b", "J"), sizes, 4, "J")


@query("g05_degrees", f"WITH {NE}, b AS (SELECT a, b FROM ne WHERE J > 5000 UNION ALL SELECT b, a FROM ne WHERE J > 5000) SELECT a AS id, count(*)::BIGINT AS degree, count(DISTINCT b)::BIGINT AS neighbours FROM b GROUP BY 1")
def g05(s, d):
    return G.degrees(strong(s, d, "J > 5000"))


@query("g06_csr_graph", f"""WITH {NE}, x AS (SELECT a, b, J::DOUBLE / avg(J) OVER (PARTITION BY region_a) - 0.5 * n_lines / avg(n_lines) OVER (PARTITION BY region_a) AS w FROM ne), y AS (SELECT a, b, w FROM x UNION ALL SELECT b, a, w FROM x), p AS (SELECT a, count(*) AS deg FROM y GROUP BY 1)
SELECT a AS id, (sum(deg) OVER (ORDER BY a) - deg)::BIGINT AS ptr, deg::BIGINT AS deg, round(w, 6) AS w FROM p JOIN (SELECT a, sum(w) AS w FROM y GROUP BY 1) USING (a)""")
def g06(s, d):
    from weft.operators.stats import over_group_mean

    w = over_group_mean("J", ["region_a"]) - 0.5 * over_group_mean("n_lines", ["region_a"])
    y = G.both_directions(nation_edge(s, d).withColumn("w", w), ["w"]).groupBy("a").agg(F.count("*").alias("deg"), F.sum("w").alias("w"))
    ptr = F.sum("deg").over(Window.orderBy("a").rowsBetween(Window.unboundedPreceding, 0)) - F.col("deg")  # one row per node
    return y.select(F.col("a").alias("id"), ptr.alias("ptr"), "deg", r6("w").alias("w"))


@query("g07_cross_border_scales", f"WITH {NE}, sc AS (SELECT region_a AS r, avg(J) AS m FROM ne WHERE NOT is_cross GROUP BY 1) SELECT a, b, round(J / ((x.m + y.m) / 2), 6) AS J_n FROM ne JOIN sc x ON x.r = region_a JOIN sc y ON y.r = region_b")
def g07(s, d):
    ne = nation_edge(s, d)
    scales = ne.where("not is_cross").groupBy(F.col("region_a").alias("r")).agg(F.avg("J").alias("m"))
    return both_ends(ne, scales, "region_a", "region_b", "r", ["m"]).select("a", "b", r6(F.col("J") / ((F.col("m_a") + F.col("m_b")) / 2)).alias("J_n"))


def inner(s, d):
    return nation_edge(s, d).where("not is_cross").select(F.col("region_a").alias("region"), "a", "b", F.col("J").cast("double").alias("w"))


@query("g08_laplacian_spectrum", None)
def g08(s, d):
    return G.spectrum(inner(s, d), "region", "w").withColumn("value", r6("value"))


@query("g09_eigengap", None)
def g09(s, d):
    gaps = gap_significance(G.spectrum(inner(s, d), "region", "w"), ["region"], "k", "value")
    return gaps.groupBy("region").agg(F.max_by("k", F.struct("gap", -F.col("k"))).alias("k_gap"), F.max_by("k", F.struct("ratio", -F.col("k"))).alias("k_ratio"))


@query("g10_spectral_clusters", None)
def g10(s, d):
    return G.spectral_clusters(nation_edge(s, d).select(F.lit(0).cast("long").alias("g"), "a", "b", F.col("J").cast("double").alias("w")), "g", "w", 3)


@query("g11_representatives", None)
def g11(s, d):
    return G.representatives(t(s, d, "embeddings"), "vec_id", "embedding", 8)


@query("g12_conductance", f"WITH {NE}, y AS (SELECT region_a AS c, region_b AS o, J FROM ne UNION ALL SELECT region_b, region_a, J FROM ne), g AS (SELECT c AS cluster, sum(J) FILTER (c <> o) AS cut, sum(J) AS volume FROM y GROUP BY 1) SELECT cluster, cut::BIGINT AS cut, volume::BIGINT AS volume, round(cut::DOUBLE / least(volume, sum(volume) OVER () - volume), 6) AS conductance FROM g")
def g12(s, d):
    return G.conductance(nation_edge(s, d), nodes(s, d).withColumnRenamed("zone", "cluster"), "J").withColumn("conductance", r6("conductance"))


@query("g13_hops", f"WITH {COMP}, h AS (SELECT 0::BIGINT AS source, 0::BIGINT AS id, 0::BIGINT AS hops UNION SELECT h.source, both_.b, h.hops + 1 FROM h JOIN both_ ON both_.a = h.id WHERE h.hops < 25) SELECT source, id, min(hops)::BIGINT AS hops FROM h GROUP BY 1, 2")
def g13(s, d):
    return G.hops(strong(s, d).select("a", "b"), nodes(s, d).where("id = 0"))


@query("g13_k_nearest", f"""WITH {COMP}, h AS (SELECT id AS source, id, 0::BIGINT AS hops FROM n WHERE id % 4 = 1 UNION SELECT h.source, both_.b, h.hops + 1 FROM h JOIN both_ ON both_.a = h.id WHERE h.hops < 25),
d AS (SELECT source, id, min(hops)::BIGINT AS hops FROM h GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hops, source) AS rank FROM d) SELECT id, source, hops, rank FROM r WHERE rank <= 3""")
def g13_k_nearest(s, d):
    """The three nearest of the marked nations for every nation."""
    found = R.k_nearest_sources(strong(s, d).select("a", "b"), nodes(s, d).where("id % 4 = 1"), 3)
    return found.select("id", "source", F.col("dist").cast("long").alias("hops"), F.col("rank").cast("long").alias("rank"))


@query("g13_patch", f"""WITH RECURSIVE {NE}, m AS (SELECT n_nationkey::BIGINT AS id FROM nation WHERE n_nationkey % 5 <> 2), st AS (SELECT a, b FROM ne WHERE J > 6300 AND a IN (SELECT id FROM m) AND b IN (SELECT id FROM m)), bo AS (SELECT a, b FROM st UNION SELECT b, a FROM st),
r AS (SELECT id, id AS c FROM m UNION SELECT bo.b, r.c FROM r JOIN bo ON bo.a = r.id), k AS (SELECT id, min(c) AS comp FROM r GROUP BY 1) SELECT comp, count(*)::BIGINT AS size FROM k GROUP BY 1 ORDER BY size DESC, comp LIMIT 1""")
def g13_patch(s, d):
    return R.largest_patch(strong(s, d).select("a", "b"), nodes(s, d).where("id % 5 <> 2"))


@query("g13_farthest", None)
def g13_farthest(s, d):
    """Six nations by farthest-point choice; lengths fall with trade."""
    edges = nation_edge(s, d).select("a", "b", F.expr("1000000 div J").alias("length"))
    return R.farthest_points(edges, nodes(s, d), 0, 6, "length")


@query("g14_resistance", None)
def g14(s, d):
    return G.resistance(inner(s, d), "region", "w").withColumn("r", F.round("r", 9))


@query("g15_voronoi_zones", f"""WITH RECURSIVE {NE}, st AS (SELECT a, b FROM ne WHERE J > 6300), bo AS (SELECT a, b FROM st UNION SELECT b, a FROM st), n AS (SELECT n_nationkey::BIGINT AS id FROM nation),
r AS (SELECT id, id AS m FROM n UNION SELECT bo.b, r.m FROM r JOIN bo ON bo.a = r.id), co AS (SELECT id, min(m) AS comp FROM r GROUP BY 1), h AS (SELECT id AS zone, id, 0 AS hops FROM n WHERE id % 8 = 0 UNION SELECT h.zone, bo.b, h.hops + 1 FROM h JOIN bo ON bo.a = h.id WHERE h.hops < 25)
SELECT id, arg_min(zone, (hops, zone)) AS zone FROM h GROUP BY 1 UNION ALL SELECT id, comp FROM co WHERE comp NOT IN (SELECT comp FROM co WHERE id % 8 = 0)""")
def g15(s, d):
    """Contiguous zones around every eighth nation; a component without one is a zone of its own."""
    seeds = nodes(s, d).where("id % 8 = 0").select("id", F.col("id").alias("zone"))
    return G.zones_by_component(strong(s, d).select("a", "b"), nodes(s, d).select("id"), seeds)


@query("g17_placements", "WITH n AS (SELECT unnest(range(0, 100)) AS id) SELECT 'block' AS name, id FROM n WHERE id // 10 < 4 AND id % 10 < 4 UNION ALL SELECT 'band', id FROM n WHERE id // 10 IN (4, 5) UNION ALL SELECT 'dispersed', id FROM n WHERE (id // 10) % 3 = 0 AND (id % 10) % 3 = 0 UNION ALL SELECT 'two blocks', id FROM n WHERE (id // 10 < 3 AND id % 10 < 3) OR (id // 10 > 6 AND id % 10 > 6)")
def g17(s, d):
    row, col = F.expr("id div 10"), F.col("id") % 10
    pick = lambda name, c: s.range(100).where(c).select(F.lit(name).alias("name"), "id")
    out = pick("block", (row < 4) & (col < 4)).unionByName(pick("band", row.isin(4, 5))).unionByName(pick("dispersed", (row % 3 == 0) & (col % 3 == 0)))
    return out.unionByName(pick("two blocks", ((row < 3) & (col < 3)) | ((row > 6) & (col > 6))))


@query("g18_control_partitions", "WITH k AS (SELECT n_nationkey::BIGINT AS id, row_number() OVER (ORDER BY md5(n_nationkey::VARCHAR)) AS k FROM nation) SELECT id, CASE WHEN k <= 10 THEN 0 WHEN k <= 18 THEN 1 ELSE 2 END::BIGINT AS random, ((id // 13) * 2 + (id % 5) // 3)::BIGINT AS quarter FROM k")
def g18(s, d):
    k = nodes(s, d).withColumn("k", F.row_number().over(Window.orderBy(F.md5(F.col("id").cast("string")))))  # one row per node
    return k.select("id", F.when(F.col("k") <= 10, 0).when(F.col("k") <= 18, 1).otherwise(2).cast("long").alias("random"), F.expr("cast((id div 13) * 2 + (id % 5) div 3 as bigint)").alias("quarter"))


G19 = f"""{NE}, l AS (SELECT n_nationkey::BIGINT AS id, n_regionkey::BIGINT AS country, n_regionkey * 10 + n_nationkey % 2 AS zone FROM nation), s AS (SELECT a, b FROM ne WHERE J > 5500 AND region_a = region_b),
io AS (SELECT id FROM l WHERE id NOT IN (SELECT a FROM s UNION ALL SELECT b FROM s)), nb AS (SELECT a AS id, b AS o, J FROM ne WHERE NOT is_cross UNION ALL SELECT b, a, J FROM ne WHERE NOT is_cross),
ho AS (SELECT id, arg_min(o, (-J, o)) AS host FROM nb JOIN io USING (id) WHERE o NOT IN (SELECT id FROM io) GROUP BY 1), ow AS (SELECT * FROM l WHERE id NOT IN (SELECT id FROM ho)),
cp AS (SELECT a AS id, sum(J)::BIGINT AS cap FROM (SELECT a, J FROM ne UNION ALL SELECT b, J FROM ne) GROUP BY 1),
ib AS (SELECT s.a, s.b FROM s JOIN ow x ON x.id = s.a JOIN ow y ON y.id = s.b WHERE x.zone = y.zone), bo AS (SELECT a, b FROM ib UNION SELECT b, a FROM ib), r AS (SELECT id, id AS m FROM ow UNION SELECT bo.b, r.m FROM r JOIN bo ON bo.a = r.id),
pa AS (SELECT zone, count(DISTINCT c)::BIGINT AS parts FROM (SELECT id, min(m) AS c FROM r GROUP BY 1) JOIN ow USING (id) GROUP BY 1), zo AS (SELECT country, zone, count(*)::BIGINT AS n, row_number() OVER (PARTITION BY country ORDER BY zone) - 1 AS anchor FROM ow GROUP BY 1, 2),
ti AS (SELECT x.country, x.zone, count(*)::BIGINT AS attached, count(*) FILTER (x.zone <> y.zone)::BIGINT AS wrong_host FROM l x JOIN ho USING (id) JOIN l y ON y.id = host GROUP BY 1, 2),
at_ AS (SELECT x.country, coalesce(y.zone, x.zone) AS zone, sum(cap)::BIGINT AS capacity FROM l x JOIN cp USING (id) LEFT JOIN ho USING (id) LEFT JOIN l y ON y.id = host GROUP BY 1, 2)"""


@query("g19_country_anchors", f"""WITH RECURSIVE {G19} SELECT d.country, d.zone::BIGINT AS zone, anchor, coalesce(capacity, 0)::BIGINT AS capacity, coalesce(n, 0)::BIGINT AS n, coalesce(attached, 0)::BIGINT AS attached, coalesce(wrong_host, 0)::BIGINT AS wrong_host,
  coalesce(parts, 0)::BIGINT AS parts, coalesce(parts, 0) = 1 AS contiguous FROM (SELECT DISTINCT country, zone FROM l) d LEFT JOIN zo USING (country, zone) LEFT JOIN at_ USING (country, zone) LEFT JOIN pa USING (zone) LEFT JOIN ti USING (country, zone)""")
def g19_country(s, d):
    """Zones within regions: capacity with attached nations, host and contiguity checks."""
    e = nation_edge(s, d)
    labels = nodes(s, d).select("id", F.col("zone").alias("country"), (F.col("zone") * 10 + F.col("id") % 2).alias("zone"))
    inside = e.where("not is_cross and J > 5500").select("a", "b")
    linked = inside.select(F.col("a").alias("id")).union(inside.select("b")).distinct()
    alone = labels.join(linked, "id", "left_anti").select("id")
    near = G.both_directions(e.where("not is_cross"), ["J"]).toDF("id", "o", "J").join(alone, "id", "left_semi").join(linked.select(F.col("id").alias("o")), "o", "left_semi")
    hosts = near.groupBy("id").agg(F.min_by("o", F.struct(-F.col("J"), "o")).alias("host"))
    cap = G.both_directions(e, ["J"]).groupBy(F.col("a").alias("id")).agg(F.sum("J").alias("cap"))
    return G.anchors(labels, inside, cap, hosts)


@query("g19_anchors", f"""WITH {NE}, z AS (SELECT n_nationkey::BIGINT AS id, n_regionkey::BIGINT AS zone FROM nation), c AS (SELECT a AS id, sum(J) AS cap FROM (SELECT a, J FROM ne UNION ALL SELECT b, J FROM ne) GROUP BY 1) SELECT dense_rank() OVER (ORDER BY zone)::BIGINT AS anchor, zone, sum(cap)::BIGINT AS capacity, count(*)::BIGINT AS n FROM z JOIN c USING (id) GROUP BY zone""")
def g19(s, d):
    cap = G.both_directions(nation_edge(s, d), ["J"]).groupBy(F.col("a").alias("id")).agg(F.sum("J").alias("cap"))
    z = nodes(s, d).join(cap, "id").groupBy("zone").agg(F.sum("cap").alias("capacity"), F.count("*").alias("n"))
    return dense_ids(z, ["zone"], "anchor")
