import ast
import pathlib

import duckdb
import pytest

import __spark_entry__ as entry
from turnwright.plans import catalogue, problems

ROOT = pathlib.Path(__file__).parent.parent


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_only_the_entry_and_its_own_tests_import_llm():
    for p in ROOT.rglob("*.py"):
        at = p.relative_to(ROOT).parts
        if "llm" in at or p.name in ("__spark_entry__.py", "bench.py"):
            continue
        for n in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in n.names] if isinstance(n, ast.Import) else [n.module or ""] if isinstance(n, ast.ImportFrom) else []
            assert not any(x.startswith("turnwright.llm") for x in names), p


@pytest.mark.parametrize("name", sorted({**catalogue.SQL, **problems.SQL}))
def test_query_equals_its_sql(spark, tiny, name):
    con = duckdb.connect()
    for p in pathlib.Path(tiny).iterdir():
        con.execute(f"create view {p.stem} as select * from '{p}'")
    r = con.execute({**catalogue.SQL, **problems.SQL}[name])
    names = [x[0] for x in r.description]
    df = {**catalogue.QUERIES, **problems.QUERIES}[name](spark, tiny)
    assert sorted(df.columns) == sorted(names)
    clean = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    assert sorted((tuple(clean(v) for v in x) for x in df.select(*names).collect()), key=repr) == sorted((tuple(clean(v) for v in x) for x in r.fetchall()), key=repr)
