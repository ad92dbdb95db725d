"""Queries S01-S17 and K01-K04: sources and sinks. Files are written to the shared folder first and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions.shared import fresh_path
from weft.plans.fixtures import NP, RD, SN, node_price, query, readings, snapshots, t
from weft.sources import readers as R
from weft.sources import writers as W


def r6(c):
    return F.round(c, 6)


@query("s01_csv_single_quote", "SELECT n_nationkey::BIGINT AS k, n_name || ', ' || n_regionkey::VARCHAR AS name FROM nation")
def s01(s, d):
    path = fresh_path(s, "csv")
    t(s, d, "nation").select(F.col("n_nationkey").alias("k"), F.concat_ws(", ", "n_name", "n_regionkey").alias("name")).write.csv(path, header=True, quote="'")
    return R.csv(s, path, "k bigint, name string", quote="'")


@query("s02_csv_suffix_columns", "SELECT strftime(o_orderdate, '%Y-%m') AS month, (count(*) FILTER (o_orderstatus = 'F'))::BIGINT AS F, (count(*) FILTER (o_orderstatus = 'O'))::BIGINT AS O FROM orders GROUP BY 1")
def s02(s, d):
    path = fresh_path(s, "csv")
    load = t(s, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).pivot("o_orderstatus", ["F", "O"]).agg(F.count("o_orderkey")).fillna(0)
    load.select("month", F.col("F").alias("F_load"), F.lit(1).alias("F_price"), F.col("O").alias("O_load")).write.csv(path, header=True)
    return R.with_suffix(R.csv(s, path, "month string, F_load bigint, F_price bigint, O_load bigint"), ["month"], "_load")


@query("s03_csv_tables", "SELECT s_suppkey, s_nationkey::BIGINT AS nation, s_acctbal FROM supplier")
def s03(s, d):
    path = fresh_path(s, "csv")
    t(s, d, "supplier").drop("s_name").write.csv(path, header=True)
    return R.csv(s, path, "s_suppkey bigint, nation bigint, s_acctbal double")


@query("s04_wide_to_long", f"WITH {NP} SELECT month, nation, price FROM np")
def s04(s, d):
    path = fresh_path(s, "wide")
    node_price(s, d).groupBy("month").pivot("nation", list(range(25))).agg(F.first("price")).write.parquet(path)
    long = R.to_long(s.read.parquet(path), ["month"], "nation", "price")
    return long.where("price is not null").select("month", F.col("nation").cast("long").alias("nation"), "price")


@query("s05_sdmx", "SELECT c_mktsegment AS segment, c_nationkey::VARCHAR AS geo, y AS period, CASE WHEN count(*) FILTER (c_custkey % 2 = y::INT % 2) > 20 THEN (count(*) FILTER (c_custkey % 2 = y::INT % 2))::DOUBLE ELSE -1 END AS value FROM customer, (SELECT unnest(['2019', '2020']) AS y) GROUP BY 1, 2, 3")
def s05(s, d):
    path = fresh_path(s, "tsv")
    cell = lambda n: F.when(F.col(n) > 20, F.concat(F.col(n), F.lit(" b"))).otherwise(": ")
    rows = t(s, d, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count_if(F.col("c_custkey") % 2 == 1).alias("x"), F.count_if(F.col("c_custkey") % 2 == 0).alias("y"))
    rows.select(F.concat_ws(",", "c_mktsegment", "c_nationkey").alias("key"), cell("x").alias("2019"), cell("y").alias("2020")).write.option("compression", "gzip").csv(path, header=True, sep="\t")
    raw = R.csv(s, path, "key string, `2019` string, `2020` string", sep="\t")
    return R.sdmx(raw, "key", ["segment", "geo"]).fillna(-1.0)


@query("s06_json_series", "SELECT s_nationkey::BIGINT AS point, s_suppkey::VARCHAR AS time, s_acctbal AS wind FROM supplier")
def s06(s, d):
    path = fresh_path(s, "json")
    x = F.array_sort(F.collect_list(F.struct(F.col("s_suppkey").cast("string").alias("t"), F.col("s_acctbal").alias("v"))))
    rows = t(s, d, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("point")).agg(x.alias("x"))
    rows.select("point", F.struct(F.col("x.t").alias("time"), F.col("x.v").alias("wind")).alias("hourly")).write.json(path)
    return R.point_series(s, path, ["wind"])


@query("s07_geojson", """SELECT n_nationkey::VARCHAR AS id, 'zone ' || n_nationkey::VARCHAR AS name, CASE WHEN n_nationkey % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS parts, 2::BIGINT AS holes,
  CASE WHEN n_nationkey % 3 = 0 THEN 14 ELSE 12 END::BIGINT AS points, CASE WHEN n_nationkey % 3 = 0 THEN 8 ELSE 7 END + n_nationkey::DOUBLE AS most FROM nation WHERE n_nationkey < 12""")
def s07(s, d):
    """Polygons with two holes, every third in two parts with a hole each, read back and renamed."""
    path = fresh_path(s, "geojson")
    k = F.col("n_nationkey").cast("double")
    ring = lambda *p: F.array(*[F.array(k + x, k + y) for x, y in p])
    box = lambda x, y, w: ring((x, y), (x + w, y), (x + w, y + w), (x, y + w))
    hole = lambda x: ring((x, x), (x + 1, x), (x, x + 1))
    one, two = F.array(box(0, 0, 7), box(1, 1, 1), box(4, 4, 2)), F.array(F.array(box(0, 0, 3), hole(1)), F.array(ring((5, 5), (8, 5), (8, 8), (5, 8)), hole(6)))
    for kind, shape, rows in (("Polygon", one, "n_nationkey % 3 <> 0"), ("MultiPolygon", two, "n_nationkey % 3 = 0")):
        feature = F.struct(F.struct(F.col("n_nationkey").cast("string").alias("id")).alias("properties"), F.struct(F.lit(kind).alias("type"), shape.alias("coordinates")).alias("geometry"))
        t(s, d, "nation").where(rows).agg(F.collect_list(feature).alias("features")).write.json(f"{path}/{kind}")  # a document of some nations
    found = R.polygons(s, path + "/*", {str(i): f"zone {i}" for i in range(12)})
    rings = F.flatten("parts")
    return found.select("id", "name", F.size("parts").cast("long").alias("parts"), (F.size(rings) - F.size("parts")).cast("long").alias("holes"), F.size(F.flatten(rings)).cast("long").alias("points"), F.array_max(F.transform(F.flatten(rings), lambda p: p["x"])).alias("most"))


@query("s08_plant_register", """SELECT CASE WHEN p_type LIKE 'PROMO%' THEN 'storage' WHEN p_size % 7 = 0 THEN 'closed' WHEN p_size > 45 THEN 'no place' ELSE 'kept' END AS reason, sum(round(p_retailprice * 100)::BIGINT)::BIGINT AS mw, count(*)::BIGINT AS n FROM part GROUP BY 1""")
def s08(s, d):
    reason = F.when(F.col("p_type").startswith("PROMO"), "storage").when(F.col("p_size") % 7 == 0, "closed").when(F.col("p_size") > 45, "no place").otherwise("kept")
    return t(s, d, "part").groupBy(reason.alias("reason")).agg(F.sum(F.round(F.col("p_retailprice") * 100).cast("long")).alias("mw"), F.count("*").alias("n"))


@query("s09_parameters", "SELECT p_partkey FROM part WHERE p_size <= 12 AND p_retailprice > 950")
def s09(s, d):
    p = R.merge_parameters({"size": {"most": 40, "least": 0}, "price": 900.0}, {"size": {"most": 12}, "price": 950})
    return s.sql("SELECT p_partkey FROM {part} WHERE p_size <= :most AND p_retailprice > :price", args={"most": p["size"]["most"], "price": p["price"]}, part=t(s, d, "part")).select("p_partkey")


@query("s10_verified_cache", """SELECT 'nations' AS name, sha256(string_agg(n_name, chr(10) ORDER BY n_nationkey) || chr(10)) AS sha256, true AS ok FROM nation
UNION ALL SELECT 'regions', sha256(string_agg(r_name, chr(10) ORDER BY r_regionkey) || chr(10)), false FROM region""")
def s10(s, d):
    """Files of a cache against a manifest of hashes that was computed from the tables; the regions' entry is wrong on purpose."""
    path = fresh_path(s, "cache")
    t(s, d, "nation").orderBy("n_nationkey").select("n_name").coalesce(1).write.option("lineSep", "\n").text(path + "/nations")
    t(s, d, "region").orderBy("r_regionkey").select("r_name").coalesce(1).write.option("lineSep", "\n").text(path + "/regions")
    lines = lambda name, key: F.sha2(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, name))), lambda x: x[name]), "\n"), F.lit("\n")), 256)
    manifest = t(s, d, "nation").agg(lines("n_name", "n_nationkey").alias("expected")).select(F.lit("nations").alias("name"), "expected")
    manifest = manifest.union(s.range(1).select(F.lit("regions"), F.sha2(F.lit("something else"), 256)))
    found = R.verified_files(s, path + "/*/part-*").select(F.element_at(F.split("path", "/"), -2).alias("name"), "sha256")
    return found.join(manifest, "name").select("name", "sha256", (F.col("sha256") == F.col("expected")).alias("ok"))


@query("s11_frozen_grid", "SELECT s_suppkey AS bus, (s_suppkey // 10)::BIGINT AS \"row\", (s_suppkey % 10)::BIGINT AS col, sha256(s_suppkey::VARCHAR || ':' || (s_suppkey // 10)::VARCHAR || ':' || (s_suppkey % 10)::VARCHAR) AS sha FROM supplier")
def s11(s, d):
    """The grid is frozen with its files' hashes and read again only if they still match."""
    path = fresh_path(s, "grid")
    R.freeze(t(s, d, "supplier").select(F.col("s_suppkey").alias("bus"), F.expr("s_suppkey div 10").alias("row"), (F.col("s_suppkey") % 10).alias("col")), path)
    return R.frozen(s, path, "bus bigint, row bigint, col bigint").withColumn("sha", F.sha2(F.concat_ws(":", "bus", "row", "col"), 256))


@query("s12_array_tables", "SELECT vec_id, (i - 1)::BIGINT AS i, round(embedding[i]::DOUBLE, 6) AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def s12(s, d):
    return t(s, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x")).select("vec_id", F.col("i").cast("long").alias("i"), r6(F.col("x").cast("double")).alias("x"))


@query("s14_time_spine", "WITH e AS (SELECT date_trunc('hour', min(ts)) AS a, date_trunc('hour', max(ts)) AS b FROM events) SELECT strftime(h, '%Y-%m-%d %H') AS hour, count(event_id)::BIGINT AS n FROM (SELECT unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS h FROM e) LEFT JOIN events ON date_trunc('hour', ts) = h GROUP BY 1")
def s14(s, d):
    e = t(s, d, "events").withColumn("h", F.date_trunc("hour", "ts"))
    bounds = e.agg(F.min("h").alias("a"), F.max("h").alias("b"))
    spine = R.hourly_spine(bounds, "a", "b", "h").select("h")
    n = e.groupBy("h").agg(F.count("*").alias("n"))
    return spine.join(n, "h", "left").select(F.date_format("h", "yyyy-MM-dd HH").alias("hour"), F.coalesce("n", F.lit(0)).alias("n"))


@query("s15_hex_grid", """WITH g AS (SELECT i, j, i * 2.0 + (j % 2) AS x, j * 1.75 AS y FROM (SELECT unnest(range(0, 30)) AS i), (SELECT unnest(range(0, 30)) AS j)), a AS (SELECT s_suppkey % 60 AS ax, s_suppkey * 7 % 53 AS ay FROM supplier)
SELECT i::BIGINT AS i, j::BIGINT AS j, round(min((x - ax) * (x - ax) + (y - ay) * (y - ay)), 6) AS d2 FROM g, a GROUP BY 1, 2 HAVING min((x - ax) * (x - ax) + (y - ay) * (y - ay)) < 25""")
def s15(s, d):
    i, j = s.range(30).withColumnRenamed("id", "i"), s.range(30).withColumnRenamed("id", "j")
    g = i.crossJoin(j).withColumn("x", F.col("i") * 2.0 + F.col("j") % 2).withColumn("y", F.col("j") * 1.75)  # a grid of 900 points
    anchors = t(s, d, "supplier").agg(F.collect_set(F.struct((F.col("s_suppkey") % 60).alias("x"), (F.col("s_suppkey") * 7 % 53).alias("y"))).alias("a"))  # at most 60 x 53 places
    near = F.array_min(F.transform("a", lambda p: (F.col("x") - p["x"]) * (F.col("x") - p["x"]) + (F.col("y") - p["y"]) * (F.col("y") - p["y"])))
    return g.crossJoin(F.broadcast(anchors)).select("i", "j", r6(near).alias("d2")).where("d2 < 25")


@query("s16_disturbance_sets", f"WITH {RD}, b AS (SELECT DISTINCT bus FROM rd) SELECT 'fixed' AS name, bus, round(-1.0 * exp(-(bus % 10) / 2.5), 6) AS dp FROM b WHERE bus % 5 = 0 UNION ALL SELECT 'scaled', bus, round(-0.5 * exp(-(bus % 10) / 2.5), 6) FROM b WHERE bus % 3 = 0 UNION ALL SELECT 'control', bus, 0.0 FROM b WHERE bus = 1")
def s16(s, d):
    b = readings(s, d).select("bus").distinct()
    rows = lambda name, which, size: b.where(which).select(F.lit(name).alias("name"), "bus", r6(F.lit(size) * F.exp(-(F.col("bus") % 10) / 2.5) + 0.0).alias("dp"))
    return rows("fixed", "bus % 5 = 0", -1.0).unionByName(rows("scaled", "bus % 3 = 0", -0.5)).unionByName(b.where("bus = 1").select(F.lit("control").alias("name"), "bus", F.lit(0.0).alias("dp")))


@query("s17_lattice", "WITH n AS (SELECT unnest(range(0, 100)) AS id) SELECT id AS a, id + 1 AS b, 'row' AS kind FROM n WHERE id % 10 < 9 UNION ALL SELECT id, id + 10, 'col' FROM n WHERE id < 90")
def s17(s, d):
    n = s.range(100)
    row = n.where("id % 10 < 9").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit("row").alias("kind"))
    return row.unionByName(n.where("id < 90").select(F.col("id").alias("a"), (F.col("id") + 10).alias("b"), F.lit("col").alias("kind")))


@query("k01_stage_outputs", "SELECT p_brand, count(*)::BIGINT AS n, sum(p_size)::BIGINT AS size FROM part GROUP BY 1")
def k01(s, d):
    path, text = fresh_path(s, "stage"), fresh_path(s, "stage-csv")
    W.write_stage(t(s, d, "part").select("p_brand", "p_partkey", "p_size"), path, ["p_brand"])
    W.write_stage(s.read.parquet(path).groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("p_size").alias("size")), text, fmt="csv")
    return R.csv(s, text, "p_brand string, n bigint, size bigint")


@query("k02_sparse", f"WITH {RD} SELECT config, event, bus, x FROM rd WHERE abs(x) > 450")
def k02(s, d):
    return W.sparse(readings(s, d), "x", 450.0)


@query("k03_resume", "SELECT DISTINCT n_regionkey::BIGINT AS config FROM nation WHERE n_regionkey >= 2")
def k03(s, d):
    path = fresh_path(s, "resume")
    nation = t(s, d, "nation").select(F.col("n_regionkey").cast("long").alias("config"), "n_name")
    W.write_stage(nation.where("config < 2"), path, ["config"])
    return W.left_to_do(nation.select("config").distinct(), s, path, "config")


@query("k04_report_table", f"WITH {NP}, {SN} SELECT 'nodes' AS what, count(DISTINCT nation)::DOUBLE AS value FROM np UNION ALL SELECT 'hours', count(*)::DOUBLE FROM sn UNION ALL SELECT 'mean price', round(sum(price * weight)::DOUBLE / sum(weight), 4) FROM np")
def k04(s, d):
    np = node_price(s, d)
    line = lambda what, c: c.select(F.lit(what).alias("what"), F.col("v").cast("double").alias("value"))
    return line("nodes", np.agg(F.count_distinct("nation").alias("v"))).unionByName(line("hours", snapshots(s, d).agg(F.count("*").alias("v")))).unionByName(line("mean price", np.agg(F.round(F.sum(F.col("price") * F.col("weight")) / F.sum("weight"), 4).alias("v"))))
