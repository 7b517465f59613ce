"""Every registered query against its SQL."""

import math

import duckdb
import pytest

from tsmill.plans import registry

FOLDER = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12) or (math.isnan(a) and math.isnan(b))
    return type(a) is type(b) and a == b


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, FOLDER)
    rows = got.collect()
    assert rows
    if name not in registry.ORACLE_SQL:
        return
    want = duck.sql(registry.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    key = lambda r: [(x is None, str(type(x)), x if x is not None else 0) for x in r]
    a = sorted(([r[c] for c in columns] for r in rows), key=key)
    b = sorted(([r[i] for i in at] for r in want.fetchall()), key=key)
    assert len(a) == len(b)
    bad = [(x, y) for x, y in zip(a, b) if not all(map(same, x, y))]
    assert not bad, (columns, len(bad), bad[:3])
