"""Queries W01-W20, T01-T06, U01-U04: windows, sorts, sets."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.functions import columns as C
from weft.operators import series as Y
from weft.operators import stats as S
from weft.operators.scans import exponential_lag
from weft.plans.fixtures import ES, HR, NE, NP, RD, edge_series, hourly, nation_edge, node_price, query, readings, t


def r6(c):
    return F.round(c, 6)


@query("w01_share_of_total", "WITH z AS (SELECT p_brand, p_size::BIGINT AS size, count(*) AS n FROM part GROUP BY 1, 2) SELECT p_brand, size, round(n::DOUBLE / sum(n) OVER (PARTITION BY p_brand), 6) AS share FROM z")
def w01(s, d):
    z = t(s, d, "part").groupBy("p_brand", F.col("p_size").cast("long").alias("size")).agg(F.count("*").alias("n"))
    return z.select("p_brand", "size", r6(S.share_of_group("n", ["p_brand"])).alias("share"))


@query("w02_normalise_by_mean", f"WITH {NE} SELECT a, b, round(J::DOUBLE / avg(J) OVER (PARTITION BY region_a), 6) AS J_n, round(J::DOUBLE / avg(CASE WHEN NOT is_cross THEN J END) OVER (PARTITION BY region_b), 6) AS J_ac FROM ne")
def w02(s, d):
    return nation_edge(s, d).select("a", "b", r6(S.over_group_mean("J", ["region_a"])).alias("J_n"), r6(S.over_group_mean("J", ["region_b"], ~F.col("is_cross"))).alias("J_ac"))


@query("w03_remedies", f"""WITH {NE}, g AS (SELECT region_a, quantile_cont(J, 0.95) AS q, median(J) FILTER (J > 0) AS m FROM ne GROUP BY 1)
SELECT a, b, round(least(J, q), 4) AS clipped, round(ln(1 + J::DOUBLE / m), 6) AS logged, round((rank() OVER (PARTITION BY region_a ORDER BY J) + (count(*) OVER (PARTITION BY region_a, J) - 1) / 2) / count(*) OVER (PARTITION BY region_a), 6) AS ranked FROM ne JOIN g USING (region_a)""")
def w03(s, d):
    ne = nation_edge(s, d)
    out = S.remedy(ne, "clip", ["region_a"], "J").withColumnRenamed("y", "clipped")
    out = S.remedy(out, "log1p", ["region_a"], "J").withColumnRenamed("y", "logged")
    out = S.remedy(out, "rank", ["region_a"], "J").withColumnRenamed("y", "ranked")
    return out.select("a", "b", F.round("clipped", 4).alias("clipped"), r6("logged").alias("logged"), r6("ranked").alias("ranked"))


@query("w04_frozen_remedy", f"""WITH {NE}, ref AS (SELECT region_a, J FROM ne WHERE NOT is_cross), n AS (SELECT region_a, count(*) AS n FROM ref GROUP BY 1)
SELECT a, b, round(((SELECT count(*) FROM ref r WHERE r.region_a = ne.region_a AND r.J < ne.J) + ((SELECT count(*) FROM ref r WHERE r.region_a = ne.region_a AND r.J = ne.J) + 1) / 2) / n, 6) AS y FROM ne JOIN n USING (region_a)""")
def w04(s, d):
    ne = nation_edge(s, d)
    return S.frozen_ecdf(ne, ne.where("not is_cross"), ["region_a"], "J").where("y is not null").select("a", "b", r6("y").alias("y"))


def gappy(s, d):
    """The hourly series on its full spine, with gaps."""
    h = hourly(s, d).where("kind = 'click' or kind = 'view' or n >= 1")
    ends = h.groupBy("kind").agg(F.min("hour").alias("a"), F.max("hour").alias("b"))
    spine = ends.select("kind", F.explode(F.sequence("a", "b")).alias("hour"))
    return spine.join(h.select("kind", "hour", "v"), ["kind", "hour"], "left")


GP = HR + ", gp AS (SELECT kind, hour, v FROM (SELECT kind, unnest(range(a, b + 1)) AS hour FROM (SELECT kind, min(hour) AS a, max(hour) AS b FROM hr GROUP BY 1)) LEFT JOIN hr USING (kind, hour))"


@query("w05_shift_fill", f"WITH {GP} SELECT kind, hour, coalesce(v, lag(v, 24) OVER w, lead(v, 24) OVER w, -1)::BIGINT AS v FROM gp WINDOW w AS (PARTITION BY kind ORDER BY hour)")
def w05(s, d):
    return Y.fill_by_shift(gappy(s, d), ["kind"], "hour", "v", 24).fillna(-1)


@query("w06_mid_rank", f"WITH {RD} SELECT config, event, bus, (rank() OVER (PARTITION BY config ORDER BY abs(x)) + (count(*) OVER (PARTITION BY config, abs(x)) - 1) / 2)::DOUBLE AS mid, rank() OVER (PARTITION BY config ORDER BY abs(x))::BIGINT AS ordinary FROM rd")
def w06(s, d):
    r = readings(s, d).withColumn("y", F.abs("x"))
    return r.select("config", "event", "bus", S.mid_rank("y", ["config"]).alias("mid"), F.rank().over(Window.partitionBy("config").orderBy("y")).cast("long").alias("ordinary"))


@query("w07_interpolation", f"""WITH {GP}, k AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN hour END) OVER (PARTITION BY kind ORDER BY hour) AS lo, min(CASE WHEN v IS NOT NULL THEN hour END) OVER (PARTITION BY kind ORDER BY hour ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hi FROM gp)
SELECT k.kind, k.hour, round(coalesce(k.v::DOUBLE, CASE WHEN k.hour - lo <= 2 OR hi - k.hour <= 2 THEN x.v + (y.v - x.v)::DOUBLE * (k.hour - lo) / (hi - lo) END, -1), 4) AS v FROM k LEFT JOIN gp x ON x.kind = k.kind AND x.hour = lo LEFT JOIN gp y ON y.kind = k.kind AND y.hour = hi""")
def w07(s, d):
    return Y.interpolate(gappy(s, d), ["kind"], "hour", "v", 2).select("kind", "hour", F.round(F.coalesce("v", F.lit(-1.0)), 4).alias("v"))


@query("w08_top_share", f"WITH {NP}, c AS (SELECT *, sum(weight) OVER (PARTITION BY nation ORDER BY price DESC, month) AS cum, sum(weight) OVER (PARTITION BY nation) AS tot FROM np) SELECT month, nation, price, weight FROM c WHERE (cum - weight) * 20 < tot")
def w08(s, d):
    return S.top_share(node_price(s, d), ["nation"], "price", "weight", ["month"], 1, 20)


@query("w09_count_for_share", f"WITH {NE}, c AS (SELECT region_a, sum(J) OVER w AS cum, sum(J) OVER (PARTITION BY region_a) AS tot, row_number() OVER w AS k FROM ne WINDOW w AS (PARTITION BY region_a ORDER BY J DESC, a, b ROWS UNBOUNDED PRECEDING)) SELECT region_a, min(k)::BIGINT AS k FROM c WHERE cum * 2 >= tot GROUP BY 1")
def w09(s, d):
    return S.count_for_share(nation_edge(s, d), ["region_a"], "J", ["a", "b"], 1, 2)


@query("w10_duration_curve", f"WITH {NP} SELECT nation, month, round(sum(weight) OVER (PARTITION BY nation ORDER BY price DESC, month)::DOUBLE / sum(weight) OVER (PARTITION BY nation), 6) AS share FROM np")
def w10(s, d):
    return S.duration_curve(node_price(s, d), ["nation"], "price", "weight", ["month"]).select("nation", "month", r6("share").alias("share"))


@query("w11_latest_per_key", """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1""")
def w11(s, d):
    best = F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_orderdate", "o_orderkey"))  # an aggregate combines before the shuffle, a window does not
    return t(s, d, "orders").groupBy("o_custkey").agg(best.alias("x")).select("o_custkey", "x.*")


@query("w12_differences", f"""WITH {NP} SELECT nation, month, coalesce(lead(price) OVER w - price, 0)::BIGINT AS step, (CASE WHEN lag(price) OVER w IS NULL THEN lead(price) OVER w - price WHEN lead(price) OVER w IS NULL THEN price - lag(price) OVER w ELSE (lead(price) OVER w - lag(price) OVER w) / 2 END)::DOUBLE AS slope FROM np WINDOW w AS (PARTITION BY nation ORDER BY month)""")
def w12(s, d):
    return Y.gradient(node_price(s, d), ["nation"], "month", "price").select("nation", "month", F.coalesce("step", F.lit(0)).alias("step"), "slope")


@query("w13_gap_significance", f"""WITH {NE}, o AS (SELECT region_a, J, row_number() OVER (PARTITION BY region_a ORDER BY J, a, b) AS k FROM ne), g AS (SELECT region_a, k, lead(J) OVER (PARTITION BY region_a ORDER BY k) - J AS gap FROM o), h AS (SELECT * FROM g WHERE gap IS NOT NULL)
SELECT x.region_a, x.k::BIGINT AS k, x.gap, round(coalesce(x.gap / nullif(median(y.gap), 0), -1), 6) AS ratio FROM h x LEFT JOIN h y ON y.region_a = x.region_a AND y.k <> x.k AND abs(y.k - x.k) <= 3 GROUP BY 1, 2, 3""")
def w13(s, d):
    o = nation_edge(s, d).withColumn("k", F.row_number().over(Window.partitionBy("region_a").orderBy("J", "a", "b")).cast("long"))
    return S.gap_significance(o, ["region_a"], "k", "J").select("region_a", "k", "gap", r6(F.coalesce("ratio", F.lit(-1.0))).alias("ratio"))


@query("w14_pareto_front", "SELECT p_brand, p_partkey FROM (SELECT *, min(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_size, p_retailprice, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM part) WHERE m IS NULL OR p_retailprice < m")
def w14(s, d):
    return Y.pareto(t(s, d, "part"), ["p_brand"], "p_size", "p_retailprice", ["p_partkey"]).select("p_brand", "p_partkey")


@query("w15_running_maximum", f"WITH {NP} SELECT nation, month, max(price) OVER (PARTITION BY nation ORDER BY month)::BIGINT AS envelope FROM np")
def w15(s, d):
    return Y.running_max(node_price(s, d), ["nation"], ["month"], "price", "envelope").select("nation", "month", "envelope")


@query("w16_window_slope", f"WITH {NP}, r AS (SELECT nation, month, (lead(price, 6) OVER (PARTITION BY nation ORDER BY month) - price) / 6 AS rate FROM np) SELECT nation, round(max(abs(rate)), 6) AS worst, arg_max(month, (abs(rate), month)) FILTER (rate IS NOT NULL) AS at, round(arg_min(rate, month), 6) AS first FROM r GROUP BY 1")
def w16(s, d):
    r = Y.windowed_slope(node_price(s, d), ["nation"], "month", "price", 6)
    size = F.abs("rate")
    return r.groupBy("nation").agg(r6(F.max(size)).alias("worst"), F.max_by("month", F.when(F.col("rate").isNotNull(), F.struct(size, F.col("month")))).alias("at"), r6(F.min_by("rate", "month")).alias("first"))


@query("w17_exponential_lag", f"""WITH RECURSIVE {NP}, o AS (SELECT nation, month, price::DOUBLE AS x, row_number() OVER (PARTITION BY nation ORDER BY month) AS k FROM np), y AS (SELECT nation, k, x AS y FROM o WHERE k = 1 UNION ALL SELECT o.nation, o.k, y.y + 0.25 * (o.x - y.y) FROM y JOIN o ON o.nation = y.nation AND o.k = y.k + 1)
SELECT nation, month, round(y, 4) AS state FROM y JOIN o USING (nation, k)""")
def w17(s, d):
    return exponential_lag(node_price(s, d), ["nation"], [F.col("month")], "price", 0.25, "y").select("nation", "month", F.round("y", 4).alias("state"))


@query("w18_stratified_draw", """WITH q AS (SELECT quantile_cont(p_retailprice, [0.25, 0.5, 0.75]) AS e FROM part), b AS (SELECT p_partkey, CASE WHEN p_retailprice <= e[1] THEN 0 WHEN p_retailprice <= e[2] THEN 1 WHEN p_retailprice <= e[3] THEN 2 ELSE 3 END AS bin FROM part, q)
SELECT p_partkey, bin::BIGINT AS bin FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY md5(p_partkey::VARCHAR)) AS k FROM b) WHERE k <= 20""")
def w18(s, d):
    part = t(s, d, "part")
    edges = part.agg(F.percentile("p_retailprice", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("e"))
    p = F.col("p_retailprice")
    b = part.crossJoin(F.broadcast(edges)).select("p_partkey", C.ladder([(p <= F.col("e")[0], 0), (p <= F.col("e")[1], 1), (p <= F.col("e")[2], 2)], 3).cast("long").alias("bin"))  # one row
    k = F.row_number().over(Window.partitionBy("bin").orderBy(F.md5(F.col("p_partkey").cast("string"))))
    return b.withColumn("k", k).where("k <= 20").drop("k")


@query("w18_largest_remainder", """WITH z AS (SELECT r_regionkey::BIGINT AS region, c_nationkey::BIGINT AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2), e AS (SELECT *, n * 17.0::DOUBLE / sum(n) OVER (PARTITION BY region) AS e FROM z),
k AS (SELECT *, floor(e) AS f, row_number() OVER (PARTITION BY region ORDER BY e - floor(e) DESC, nation) AS k, sum(floor(e)) OVER (PARTITION BY region) AS s FROM e) SELECT region, nation, (f + (k <= 17 - s)::INT)::BIGINT AS seats FROM k""")
def w18b(s, d):
    z = t(s, d, "customer").join(t(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").cast("long").alias("region"), F.col("c_nationkey").cast("long").alias("nation")).agg(F.count("*").alias("n"))
    return Y.largest_remainder(z, ["region"], "nation", "n", 17).select("region", "nation", "seats")


@query("w19_simpson_weights", f"WITH {NP}, k AS (SELECT nation, price, row_number() OVER (PARTITION BY nation ORDER BY month) - 1 AS k, count(*) OVER (PARTITION BY nation) AS n FROM np) SELECT nation, round(sum(price * CASE WHEN k IN (0, n - 1) THEN 0.5 / 3 WHEN k % 2 = 1 THEN 2.0 / 3 ELSE 1.0 / 3 END), 4) AS integral FROM k GROUP BY 1")
def w19(s, d):
    w = Window.partitionBy("nation")
    k = node_price(s, d).withColumn("k", F.row_number().over(w.orderBy("month")) - 1).withColumn("n", F.count("*").over(w))
    return k.groupBy("nation").agg(F.round(F.sum(F.col("price") * C.simpson_weight("k", "n", F.lit(0.5))), 4).alias("integral"))


@query("w20_stratum_summary", f"WITH {RD} SELECT abs(x) // 100 AS level, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd, min(x) AS low, max(x) AS high, round(max(abs(x))::DOUBLE / (min(abs(x)) + 1), 6) AS ratio FROM rd GROUP BY 1 HAVING count(*) > 1")
def w20(s, d):
    g = readings(s, d).groupBy(F.expr("abs(x) div 100").alias("level"))
    return g.agg(r6(F.avg("x")).alias("mean"), r6(F.stddev_samp("x")).alias("sd"), F.min("x").alias("low"), F.max("x").alias("high"), r6(F.max(F.abs("x")) / (F.min(F.abs("x")) + 1)).alias("ratio"), F.count("*").alias("n")).where("n > 1").drop("n")


@query("t01_top_n", "SELECT o_custkey, count(*)::BIGINT AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 15")
def t01(s, d):
    return t(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "o_custkey").limit(15)


@query("t02_several_keys", f"""WITH {NE}, c AS (SELECT *, 1 AS p FROM (SELECT a, b, 'J' AS why FROM ne ORDER BY J DESC, a, b LIMIT 10) UNION ALL SELECT *, 2 FROM (SELECT a, b, 'lines' FROM ne ORDER BY n_lines, a, b LIMIT 10)) SELECT a, b, arg_min(why, p) AS why FROM c GROUP BY 1, 2""")
def t02(s, d):
    ne = nation_edge(s, d)
    first = ne.orderBy(F.col("J").desc(), "a", "b").limit(10).select("a", "b", F.lit("J").alias("why"), F.lit(1).alias("p"))
    second = ne.orderBy("n_lines", "a", "b").limit(10).select("a", "b", F.lit("lines").alias("why"), F.lit(2).alias("p"))
    return first.unionByName(second).groupBy("a", "b").agg(F.min_by("why", "p").alias("why"))


@query("t03_merit_order", "SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_size DESC, p_partkey)::BIGINT AS place FROM part")
def t03(s, d):
    w = Window.partitionBy("p_brand").orderBy("p_retailprice", F.col("p_size").desc(), "p_partkey")
    return t(s, d, "part").select("p_brand", "p_partkey", F.row_number().over(w).cast("long").alias("place"))


@query("t04_siblings", f"WITH {RD}, b AS (SELECT config, bus, sum(x) AS e FROM rd GROUP BY 1, 2), h AS (SELECT config, max(e) AS m FROM b GROUP BY 1), k AS (SELECT b.*, row_number() OVER (PARTITION BY config ORDER BY e DESC, bus) AS k FROM b JOIN h USING (config) WHERE m - e <= 300) SELECT config, bus, e::BIGINT AS e FROM k WHERE k <= 4")
def t04(s, d):
    b = readings(s, d).groupBy("config", "bus").agg(F.sum("x").alias("e")).withColumn("m", F.max("e").over(Window.partitionBy("config")))
    near = b.where("m - e <= 300").withColumn("k", F.row_number().over(Window.partitionBy("config").orderBy(F.col("e").desc(), "bus")))
    return near.where("k <= 4").select("config", "bus", "e")


@query("t05_anchor_order", f"WITH {ES}, g AS (SELECT a, b, avg((dp > 12000)::INT) AS p, avg((dp > 25000)::INT) AS o, sum(dp) AS s FROM es GROUP BY 1, 2) SELECT a, b, row_number() OVER (ORDER BY p DESC, s DESC, a, b)::BIGINT AS place FROM g WHERE p >= 0.5 OR o >= 0.2")
def t05(s, d):
    share = lambda x: F.avg((F.col("dp") > x).cast("int"))
    g = edge_series(s, d).groupBy("a", "b").agg(share(12000).alias("p"), share(25000).alias("o"), F.sum("dp").alias("s")).where("p >= 0.5 or o >= 0.2")
    return g.select("a", "b", F.row_number().over(Window.orderBy(F.col("p").desc(), F.col("s").desc(), "a", "b")).cast("long").alias("place"))  # one row per edge


@query("t06_headline", f"WITH {RD} SELECT config, bus FROM (SELECT config, bus, count(*) FILTER (x < 0) AS failures, sum(abs(x)) AS score FROM rd GROUP BY 1, 2) ORDER BY failures > 0, score, config, bus LIMIT 1")
def t06(s, d):
    g = readings(s, d).groupBy("config", "bus").agg(F.count_if(F.col("x") < 0).alias("failures"), F.sum(F.abs("x")).alias("score"))
    return g.orderBy(F.col("failures") > 0, "score", "config", "bus").limit(1).select("config", "bus")


@query("u01_union_by_name", f"WITH {NE} SELECT a, b, J, 'ac' AS kind FROM ne WHERE NOT is_cross UNION ALL SELECT a, b, -1, 'dc' FROM ne WHERE is_cross UNION ALL SELECT b, a, J, 'back' FROM ne WHERE n_lines % 5 = 0")
def u01(s, d):
    ne = nation_edge(s, d)
    ac, dc = ne.where("not is_cross").select("a", "b", "J", F.lit("ac").alias("kind")), ne.where("is_cross").select("a", "b", F.lit("dc").alias("kind"))
    back = ne.where("n_lines % 5 = 0").select(F.col("b").alias("a"), F.col("a").alias("b"), "J", F.lit("back").alias("kind"))
    return ac.unionByName(dc, allowMissingColumns=True).unionByName(back).fillna(-1, ["J"])


@query("u02_intersect_except", """(SELECT s_nationkey::BIGINT AS k, 'both' AS w FROM supplier WHERE s_suppkey % 3 = 0 INTERSECT SELECT s_nationkey, 'both' FROM supplier WHERE s_suppkey % 4 = 0) UNION ALL (SELECT s_nationkey, 'left' FROM supplier WHERE s_suppkey % 3 = 0 EXCEPT SELECT s_nationkey, 'left' FROM supplier WHERE s_suppkey % 4 = 0)""")
def u02(s, d):
    k = lambda m: t(s, d, "supplier").where(f"s_suppkey % {m} = 0").select(F.col("s_nationkey").cast("long").alias("k"))
    return k(3).intersect(k(4)).withColumn("w", F.lit("both")).unionByName(k(3).subtract(k(4)).withColumn("w", F.lit("left")))


@query("u03_duplicates", "SELECT l_orderkey, l_linenumber::BIGINT AS line, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def u03(s, d):
    return t(s, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").cast("long").alias("line")).agg(F.count("*").alias("n")).where("n > 1")


@query("u04_symmetric_difference", """WITH b AS (SELECT DISTINCT p_size AS k FROM part WHERE p_brand = 'Brand#11'), a AS (SELECT DISTINCT p_size AS k FROM part WHERE p_brand = 'Brand#21') SELECT ((SELECT count(*) FROM b) + (SELECT count(*) FROM a) - 2 * (SELECT count(*) FROM b JOIN a USING (k)))::BIGINT AS n""")
def u04(s, d):
    sizes = t(s, d, "part").where("p_brand in ('Brand#11', 'Brand#21')").groupBy("p_size").agg(F.count_distinct("p_brand").alias("sides"))
    return sizes.agg(F.count_if(F.col("sides") == 1).alias("n"))
