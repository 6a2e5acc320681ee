"""Every registered query of the core library against its DuckDB SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from starloom import catalog

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in SF.glob("*.parquet"):
        c.sql(f"create view {f.stem} as select * from '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=str)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_matches_sql(spark, duck, name):
    df = catalog.queries()[name](spark, str(SF))
    got = rows(df.columns, df.collect())
    if name in catalog.oracle_sql():
        r = duck.execute(catalog.oracle_sql()[name])
        want = rows(names := [d[0] for d in r.description], r.fetchall())
        assert sorted(df.columns) == sorted(names)
        assert got == want


def test_entry_imports():
    import __spark_entry__ as e

    assert set(catalog.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
