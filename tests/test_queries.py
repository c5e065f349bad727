"""Every registered query against its SQL in DuckDB, over the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from strata.plans import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def text(v):
    return ("nan" if math.isnan(v) else repr(v)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    rows = df.collect()
    if name not in registry.ORACLES:
        assert rows
        return
    cursor = duck.execute(registry.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    got = sorted(tuple(text(r[c]) for c in order) for r in rows)
    want = sorted(tuple(text(r[columns.index(c)]) for c in order) for r in cursor.fetchall())
    assert got == want
