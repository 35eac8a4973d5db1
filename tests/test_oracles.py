"""Every query of the registry against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest
from cartulary.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return str(v)[:10] if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{small}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/**/*.parquet' if os.path.isdir(path) else ''}'")
    return con


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_against_sql(spark, small, duck, name):
    got = registry.queries()[name](spark, small)
    want = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    key = lambda rows: sorted((tuple(plain(v) for v in r) for r in rows), key=repr)
    assert key(tuple(r[c] for c in names) for r in got.collect()) == key(want.fetchall())
