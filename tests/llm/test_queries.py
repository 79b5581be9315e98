"""Every registered query of the text problems runs on the smallest tables; those with SQL give what the SQL gives."""

import ast
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import kikitori.llm
from kikitori.llm import queries as Q
from verify_local import rows_of

DATA = Path("/root/testdata/sf0.001")


def test_no_name_is_defined_twice():
    for path in Path(kikitori.llm.__file__).parent.glob("*.py"):
        names = Counter(n.name for n in ast.parse(path.read_text()).body if isinstance(n, (ast.FunctionDef, ast.ClassDef)))
        assert not [n for n, k in names.items() if k > 1], path


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, name):
    if not DATA.exists():
        pytest.skip("no test tables here")
    df = Q.queries()[name](spark, str(DATA))
    got = df.collect()
    if (sql := Q.oracle_sql().get(name)) is not None:
        con = duckdb.connect()
        for p in DATA.glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        want = con.execute(sql)
        names = [c[0] for c in want.description]
        assert sorted(names) == sorted(df.columns) and rows_of(df.columns, got) == rows_of(names, want.fetchall())
