"""Every query against its SQL, at the smallest scale."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from fieldloom.plans import registry

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    rows = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in rows.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = sorted((tuple(plain(r[i]) for i in order) for r in rows.fetchall()), key=repr)
    assert sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr) == expected


def test_every_query_has_its_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)
