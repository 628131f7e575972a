"""Every bound query against its SQL in DuckDB, on the smallest tables; and the driver's contract."""

import math
import os

import pytest

import __spark_entry__
from tallygrid.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    found = duck.sql(catalog.ORACLES[name])
    assert columns == sorted(found.columns)
    expected = duck.sql(f"SELECT {', '.join(f'{chr(34)}{c}{chr(34)}' for c in columns)} FROM ({catalog.ORACLES[name]})").fetchall()
    assert sorted(tuple(map(plain, r)) for r in df.select(*columns).collect()) == sorted(tuple(map(plain, r)) for r in expected)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs_and_repeats(spark, name):
    # Sums may be taken in another order, so the last digits may differ.
    shown = lambda v: f"{round(v, 6) + 0.0:.6f}" if isinstance(v, float) else repr(v)
    first, again = (sorted(tuple(map(shown, r)) for r in catalog.QUERIES[name](spark, FOLDER).collect()) for _ in range(2))
    assert first == again and first


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
