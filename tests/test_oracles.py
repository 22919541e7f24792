"""Every query with SQL beside it gives the SQL's rows."""

import datetime
import decimal
import math
from collections import Counter

import duckdb
import pytest

from larkspur.plans import catalog

DIR = "/root/testdata/sf0.001"
#: Queries whose right answer is no row, at least on the smallest tables.
NONE = ["flt_12_saved_by_nobody", "fit_05_without_profile"]


def same(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float) and not math.isnan(v):
        return round(v, 6)
    if isinstance(v, list | dict):
        return str(v)
    return v.date() if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages conversations".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DIR)
    rows = Counter(tuple(same(r[c]) for c in sorted(df.columns)) for r in df.collect())
    assert rows or name in NONE
    if name in catalog.ORACLES:
        found = duck.sql(catalog.ORACLES[name])
        columns = [d[0] for d in found.description]
        assert sorted(columns) == sorted(df.columns)
        order = sorted(range(len(columns)), key=columns.__getitem__)
        assert rows == Counter(tuple(same(r[i]) for i in order) for r in found.fetchall())
