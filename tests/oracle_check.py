"""Compare registered queries with their SQL: schema, row count and values.

    python -m tests.oracle_check [folder] [query ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from lexmill.plans.oracles import ORACLES
from lexmill.plans.queries import QUERIES
from lexmill.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "float": "FLOAT",
}


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _sort_key(row):
    return tuple((v is not None, str(v)) for v in row)


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=0, abs_tol=0)
    return a == b


def compare(spark, con, sf: str, name: str) -> tuple[str, int]:
    """An empty message when both sides agree, and the number of rows."""
    df = QUERIES[name](spark, sf)
    names = sorted(df.columns)
    mine = [tuple(r) for r in df.select(*names).collect()]
    if name not in ORACLES:
        return "", len(mine)
    cursor = con.execute(ORACLES[name])
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    rows = cursor.fetchall()
    if sorted(kinds) != names:
        return f"columns {names} vs {sorted(kinds)}", len(mine)
    order = [list(kinds).index(n) for n in names]
    theirs = [tuple(r[i] for i in order) for r in rows]
    for field in df.schema.fields:
        if KINDS.get(field.dataType.simpleString()) != kinds[field.name]:
            return f"type of {field.name}: {field.dataType} vs {kinds[field.name]}", len(mine)
    if len(mine) != len(theirs):
        return f"{len(mine)} rows vs {len(theirs)}", len(mine)
    mine.sort(key=_sort_key)
    theirs.sort(key=_sort_key)
    wrong = [
        (a, b)
        for a, b in zip(mine, theirs, strict=True)
        if not all(_same(x, y) for x, y in zip(a, b, strict=True))
    ]
    return (f"{len(wrong)} rows differ, first {wrong[0]}"[:600] if wrong else ""), len(mine)


def main(argv: list[str]) -> int:
    sf = argv[0] if argv else "/root/testdata/sf0.01"
    spark, con = local_session(), connect(sf)
    failed = 0
    for name in argv[1:] or QUERIES:
        start = time.time()
        try:
            message, rows = compare(spark, con, sf, name)
        except Exception as error:  # report and go on with the next query
            message, rows = f"{type(error).__name__}: {str(error)[:700]}", 0
        failed += bool(message)
        kind = "O" if name in ORACLES else "R"
        print(f"{name:22} {kind} {rows:7} {time.time() - start:6.1f}s {message or 'ok'}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
