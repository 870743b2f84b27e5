"""Compare a query with its SQL on the same tables, as multisets of rows."""

import math
from collections import Counter
from pathlib import Path

import duckdb


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    return x.asDict() if hasattr(x, "asDict") else x


def connection(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def differences(spark, query, sql, sf_dir):
    """Rows that only one side has; an empty list if the two agree."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    ours = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    got = connection(sf_dir).execute(sql)
    columns = [c[0] for c in got.description]
    assert sorted(columns) == names, (names, sorted(columns))
    order = [columns.index(c) for c in names]
    theirs = Counter(tuple(plain(r[i]) for i in order) for r in got.fetchall())
    only = [("spark", r) for r in (ours - theirs).elements()] + [("sql", r) for r in (theirs - ours).elements()]
    return only, sum(ours.values())
