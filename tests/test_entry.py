"""Every engine query of the driver's contract against its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from docspire import queries as engine

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 20


@pytest.mark.parametrize("name", sorted(engine.queries()))
def test_query(spark, duck, name):
    got = engine.queries()[name](spark, SF).toPandas()
    want = duck.sql(engine.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = lambda df: sorted(df[cols].astype(str).itertuples(index=False, name=None))
    assert rows(got) == rows(want)
