"""Every core query with SQL, against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from paronym.plans import registry

FOLDER = os.environ.get("PARONYM_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for file in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{FOLDER}/{file}'")
    return c


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    made = [tuple(_plain(float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i]) for i in order) for r in rows]
    return sorted(made, key=lambda r: [(v is not None, str(type(v)), v) for v in r])


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, name):
    made = registry.QUERIES[name](spark, FOLDER)
    mine = _rows(made.columns, [tuple(r) for r in made.collect()])
    found = duck.execute(registry.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(made.columns)
    theirs = _rows(names, found.fetchall())
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs):
        assert all(x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and math.isclose(x, y, abs_tol=2e-5)) for x, y in zip(a, b)), (a, b)


def test_flagship_is_registered():
    assert registry.FLAGSHIP in registry.QUERIES
