"""The test tables, and the comparison of results across engines."""

import math
from pathlib import Path

TESTDATA = "/root/testdata"


def plain(x):
    """A value that compares equal across engines."""
    if hasattr(x, "tolist") and not isinstance(x, str):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if x is None or (isinstance(x, float) and math.isnan(x)) or type(x).__name__ in ("NaTType", "NAType"):
        return None
    if isinstance(x, bool) or type(x).__name__ == "bool_":
        return bool(x)
    if hasattr(x, "isoformat"):
        return x.isoformat()[:10]
    return x if isinstance(x, str) else f"{float(x):.9g}"


def same_rows(got, want):
    """Both pandas frames have the same columns and, in any order, the same rows."""
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    rows = [sorted((tuple(plain(x) for x in r) for r in d[names].itertuples(index=False)), key=str) for d in (got, want)]
    assert rows[0] == rows[1]


def duck(sql, sf):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in Path(sf).iterdir():
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con.execute(sql).df()
