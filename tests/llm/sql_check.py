"""Compare this package's queries with their SQL: ``python -m tests.llm.sql_check sf query...``"""

from __future__ import annotations

import sys
import time

from lexmill.llm.queries import ORACLES, QUERIES
from lexmill.session import local_session
from tests.oracle_check import KINDS, connect


def compare(spark, con, sf: str, name: str) -> tuple[str, list]:
    df = QUERIES[name](spark, sf)
    names = sorted(df.columns)
    mine = [tuple(r) for r in df.select(*names).collect()]
    if name not in ORACLES:
        return "", mine
    cursor = con.execute(ORACLES[name])
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    rows = cursor.fetchall()
    if sorted(kinds) != names:
        return f"columns {names} vs {sorted(kinds)}", mine
    for field in df.schema.fields:
        if KINDS.get(field.dataType.simpleString()) != kinds[field.name]:
            return f"type of {field.name}: {field.dataType} vs {kinds[field.name]}", mine
    order = [list(kinds).index(n) for n in names]
    key = lambda r: tuple((v is not None, str(v)) for v in r)
    theirs = sorted((tuple(r[i] for i in order) for r in rows), key=key)
    if len(mine) != len(theirs):
        return f"{len(mine)} rows vs {len(theirs)}", mine
    wrong = [(a, b) for a, b in zip(sorted(mine, key=key), theirs, strict=True) if a != b]
    return (f"{len(wrong)} rows differ, first {wrong[0]}"[:500] if wrong else ""), mine


if __name__ == "__main__":
    sf = sys.argv[1]
    spark, con = local_session(), connect(sf)
    for name in sys.argv[2:] or QUERIES:
        start = time.time()
        message, rows = compare(spark, con, sf, name)
        print(name, len(rows), f"{time.time() - start:.1f}s", message or "ok", rows[:3], flush=True)
