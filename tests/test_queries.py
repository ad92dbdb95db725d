"""Every query with SQL gives DuckDB's rows; the others run."""

import os

import duckdb
import pytest

import __spark_entry__
from weft.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def con():
    with duckdb.connect() as c:
        for t in TABLES:
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        yield c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name not in catalog.ORACLE_SQL:
        assert len(got.columns)
        return
    want = con.execute(catalog.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: df[columns].astype(str).sort_values(columns).reset_index(drop=True)
    assert len(got) == len(want) and rows(got).equals(rows(want))


def test_entry(spark):
    assert set(__spark_entry__.entry(spark).columns) == {"a", "b", "dp_mean", "dp_duration"}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
