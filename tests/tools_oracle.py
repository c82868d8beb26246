"""Order-insensitive comparison of a Spark result with a DuckDB cursor."""

import math


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(round(v, 9))
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def compare(df, cur):
    cols = df.columns
    dcols = [d[0] for d in cur.description]
    if sorted(cols) != sorted(dcols):
        return False, (cols, dcols)
    idx = [dcols.index(c) for c in cols]
    a = sorted("|".join(map(_norm, r)) for r in df.collect())
    b = sorted("|".join(_norm(r[i]) for i in idx) for r in cur.fetchall())
    if a != b:
        return False, (len(a), len(b), sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2])
    return True, None
