"""python -m turnwright: run a query over a folder of tables and write its result, or list the queries."""

from __future__ import annotations

import argparse

from turnwright.session import build_session
from turnwright.sources.paths import resolve
from turnwright.sources.writers import once, write_csv


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="turnwright", description=__doc__)
    p.add_argument("query", nargs="?", help="name of a query; without one all names are listed")
    p.add_argument("--data", default="data", help="folder of the tables, one <name>.parquet each")
    p.add_argument("--out", help="folder for the result; without one the first rows are shown")
    p.add_argument("--base", default=".", help="folder that relative paths start from")
    p.add_argument("--format", choices=("parquet", "csv"), default="parquet")
    p.add_argument("--force", action="store_true", help="make the result again if it is there")
    return p.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    from turnwright.plans import catalogue, problems

    a = arguments(argv)
    queries = {**catalogue.QUERIES, **problems.QUERIES}
    if a.query is None:
        print("\n".join(sorted(queries)))
        return 0
    if a.query not in queries:
        print(f"no query {a.query}")
        return 2
    spark = build_session()
    make = lambda: queries[a.query](spark, resolve(a.base, a.data))
    if a.out is None:
        make().show(20, False)
    elif a.format == "csv":
        write_csv(make(), resolve(a.base, a.out))
    else:
        once(spark, resolve(a.base, a.out), make, a.force)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
