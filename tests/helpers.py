"""Comparison of a DataFrame with the rows of a SQL query, whatever their order."""

from __future__ import annotations

import numpy as np


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple((k, plain(x)) for k, x in sorted(v.asDict().items()))
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return float(v) if isinstance(v, float) else v


def rows(df):
    return sorted((str(tuple(plain(r[c]) for c in sorted(df.columns))) for r in df.collect()))


def sql_rows(duck, sql):
    cursor = duck.execute(sql)
    names = [d[0] for d in cursor.description]
    return sorted(names), sorted(str(tuple(plain(v) for _, v in sorted(zip(names, r)))) for r in cursor.fetchall())


def same(df, duck, sql):
    names, expected = sql_rows(duck, sql)
    assert sorted(df.columns) == names
    found = rows(df)
    assert found == expected
    return found
