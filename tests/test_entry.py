"""Every registered query of the core runs on the smallest tables; those with SQL give what the SQL gives."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from kikitori.plans import registry
from verify_local import rows_of

DATA = Path("/root/testdata/sf0.001")


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and set(registry.queries()) <= set(queries)


@pytest.fixture(scope="module")
def tables():
    if not DATA.exists():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, tables, name):
    df = registry.queries()[name](spark, str(DATA))
    got = df.collect()
    if (sql := registry.oracle_sql().get(name)) is not None:
        want = tables.execute(sql)
        names = [c[0] for c in want.description]
        assert sorted(names) == sorted(df.columns)
        assert rows_of(df.columns, got) == rows_of(names, want.fetchall())
