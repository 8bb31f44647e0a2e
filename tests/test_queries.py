"""Every query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from rasterloom.plans import catalogue
from rasterloom.plans.fixtures import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v.replace(tzinfo=None).isoformat() if hasattr(v, "isoformat") else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("key", sorted(catalogue.queries()))
def test_query(spark, duck, key):
    df = catalogue.queries()[key](spark, SF)
    got = df.collect()
    if key not in catalogue.oracle_sql():
        assert len(df.columns) > 0
        return
    r = duck.execute(catalogue.oracle_sql()[key])
    names = [x[0] for x in r.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, got) == rows(names, r.fetchall())
