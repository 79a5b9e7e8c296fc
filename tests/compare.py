"""Rows of a Spark query and of its SQL, order aside, with doubles to nine digits."""

from __future__ import annotations

import math


def norm(v) -> str:
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.9g}"
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{norm(x)}" for k, x in v.items()) + "}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


def same_rows(frame, duck, sql: str) -> int:
    found = duck.execute(sql)
    names = [d[0] for d in found.description]
    columns = sorted(frame.columns)
    assert sorted(names) == columns
    b = sorted(tuple(norm(r[names.index(c)]) for c in columns) for r in found.fetchall())
    a = sorted(tuple(norm(r[c]) for c in columns) for r in frame.collect())
    assert len(a) == len(b)
    assert a == b
    return len(a)
