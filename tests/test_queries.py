"""Every query against its SQL on the smallest tables; queries without SQL must run."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import pytest

from tests.conftest import SF
from tidemark.plans import catalog


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, db, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    sql = catalog.oracle_sql().get(name)
    if sql:
        r = db.sql(sql)
        at = [r.columns.index(c) for c in cols]
        assert len(r.columns) == len(cols)
        assert got == sorted(repr([plain(x[i]) for i in at]) for x in r.fetchall())
