"""The two shared fixtures and a register of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query, with the SQL that DuckDB runs on the same tables."""

    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def node_price(spark: SparkSession, d: str) -> DataFrame:
    """(month, nation, price, weight): cents per unit sold to customers of a nation in a month, and its orders."""
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    c = t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("nation"))
    sold = t(spark, d, "lineitem").groupBy("l_orderkey").agg(  # by order first: the join then moves one row per order
        F.sum(F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("long")).alias("cents"), F.sum(F.col("l_quantity").cast("long")).alias("qty"))
    rows = o.join(sold, o["o_orderkey"] == sold["l_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"])
    return rows.groupBy("month", "nation").agg(F.expr("sum(cents) div sum(qty)").alias("price"), F.count("*").alias("weight"))


NP = """np AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, c_nationkey::BIGINT AS nation,
  (sum(round(l_extendedprice * (1 - l_discount) * 100)::BIGINT) // sum(l_quantity::BIGINT))::BIGINT AS price, count(DISTINCT o_orderkey)::BIGINT AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""


def nation_edge(spark: SparkSession, d: str) -> DataFrame:
    """(a, b, region_a, region_b, is_cross, J, n_lines): trade between two nations, whichever sells."""
    sells = t(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("s"))
    buys = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").cast("long").alias("c"))
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q"))
    rows = rows.join(sells, F.col("l_suppkey") == F.col("s_suppkey")).join(buys, F.col("l_orderkey") == F.col("o_orderkey")).where("c <> s")
    edges = rows.groupBy(F.least("c", "s").alias("a"), F.greatest("c", "s").alias("b")).agg(F.sum("q").alias("J"), F.count("*").alias("n_lines"))
    region = t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n"), F.col("n_regionkey").cast("long").alias("r"))
    edges = edges.join(region.select(F.col("n").alias("a"), F.col("r").alias("region_a")), "a").join(region.select(F.col("n").alias("b"), F.col("r").alias("region_b")), "b")
    return edges.select("a", "b", "region_a", "region_b", (F.col("region_a") != F.col("region_b")).alias("is_cross"), "J", "n_lines")


NE = """ne AS (SELECT a, b, na.n_regionkey::BIGINT AS region_a, nb.n_regionkey::BIGINT AS region_b, na.n_regionkey <> nb.n_regionkey AS is_cross, J, n_lines FROM (
  SELECT least(c_nationkey, s_nationkey)::BIGINT AS a, greatest(c_nationkey, s_nationkey)::BIGINT AS b, sum(l_quantity::BIGINT)::BIGINT AS J, count(*)::BIGINT AS n_lines
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey GROUP BY 1, 2) JOIN nation na ON na.n_nationkey = a JOIN nation nb ON nb.n_nationkey = b)"""


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """(month, w): orders per month, the snapshot weight."""
    return t(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("w"))


SN = "sn AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*)::BIGINT AS w FROM orders GROUP BY 1)"


def edge_series(spark: SparkSession, d: str) -> DataFrame:
    """(a, b, region_a, region_b, is_cross, J, n_lines, month, dp, w): absolute price difference over each edge."""
    from weft.operators.joins import endpoint_series

    rows = endpoint_series(nation_edge(spark, d), node_price(spark, d).select("month", "nation", "price"), "a", "b", "nation", "month", "price")
    return rows.withColumn("dp", F.abs(F.col("price_a") - F.col("price_b"))).drop("price_a", "price_b").join(snapshots(spark, d), "month")


ES = NP + ", " + NE + ", " + SN + """, es AS (SELECT ne.*, x.month, abs(x.price - y.price) AS dp, w
  FROM ne JOIN np x ON x.nation = a JOIN np y ON y.nation = b AND y.month = x.month JOIN sn ON sn.month = x.month)"""


def readings(spark: SparkSession, d: str) -> DataFrame:
    """(config, event, bus, x): flag, status, supplier, quantity in cents-weighted units; the stand-in for response readings."""
    rows = t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("config"), F.col("l_linestatus").alias("event"), F.col("l_suppkey").alias("bus"))
    return rows.agg((F.sum(F.round(F.col("l_extendedprice")).cast("long")) % 1000 - 500).alias("x"))


RD = """rd AS (SELECT l_returnflag AS config, l_linestatus AS event, l_suppkey AS bus, (sum(round(l_extendedprice)::BIGINT) % 1000 - 500)::BIGINT AS x
  FROM lineitem GROUP BY 1, 2, 3)"""


def hourly(spark: SparkSession, d: str) -> DataFrame:
    """(hour, kind, n, v): events by hour since the epoch and type; v in thousandths."""
    e = t(spark, d, "events")
    hour = F.expr("unix_seconds(cast(ts as timestamp)) div 3600")
    return e.groupBy(hour.alias("hour"), F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 1000).cast("long")).alias("v"))


HR = """hr AS (SELECT (epoch(date_trunc('hour', ts))::BIGINT // 3600)::BIGINT AS hour, event_type AS kind, count(*)::BIGINT AS n, sum(round(value * 1000)::BIGINT)::BIGINT AS v
  FROM events GROUP BY 1, 2)"""
