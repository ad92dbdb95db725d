"""Queries against DuckDB on tables that the small samples do not show: quiet prices, long keys."""

import duckdb
import pytest
from pyspark.sql import functions as F

from weft.plans import catalog

SF = "/root/testdata/sf0.001"


def both(spark, name, folder):
    """Rows of the query and of its SQL over the folder's tables."""
    with duckdb.connect() as con:
        for path in folder.iterdir():
            con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}/*.parquet'")
        found = con.execute(catalog.ORACLE_SQL[name])
        columns, want = [c[0] for c in found.description], found.fetchall()
    got = catalog.QUERIES[name](spark, str(folder)).select(*columns).collect()
    return sorted(map(tuple, got), key=str), sorted(want, key=str)


def write(spark, folder, **changed):
    """Tables of sf0.001, some of them changed."""
    for table, change in changed.items():
        change(spark.read.parquet(f"{SF}/{table}.parquet")).write.parquet(f"{folder}/{table}.parquet")


@pytest.mark.parametrize("name", ["a02_weighted_duration", "a13_line_loading", "a39_ensemble_mean"])
def test_a_share_of_no_row_is_null(spark, tmp_path, name):
    same = dict.fromkeys(("nation", "customer", "supplier", "orders"), lambda df: df)
    even = lambda df: df.withColumns({"l_extendedprice": F.col("l_quantity") * 0 + 20, "l_discount": F.lit(0.0)}).dropDuplicates(["l_returnflag", "l_linestatus", "l_suppkey"])
    write(spark, tmp_path, **same, lineitem=even)
    got, want = both(spark, name, tmp_path)
    assert got == want and want


def test_names_of_long_and_missing_keys(spark, tmp_path):
    keys = F.when(F.col("p_partkey") % 7 == 0, None).when(F.col("p_partkey") % 7 == 1, -F.col("p_partkey")).otherwise(F.col("p_partkey") + 999_900)
    write(spark, tmp_path, part=lambda df: df.withColumn("p_partkey", keys))
    got, want = both(spark, "p21_display_words", tmp_path)
    assert got == want and len(want) == 200
