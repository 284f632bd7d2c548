"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import math
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from strandline.plans import catalogue  # noqa: E402

DATA = Path("/root/testdata/sf0.001")
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels"]
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, str(DATA))
    want = duck.sql(catalogue.oracle_sql()[name])
    cols, names = got.columns, want.columns
    assert sorted(cols) == sorted(names)
    a = sorted((tuple(plain(r[c]) for c in sorted(cols)) for r in got.collect()), key=repr)
    b = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in want.fetchall()), key=repr)
    assert a == b
