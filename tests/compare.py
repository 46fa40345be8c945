"""A query's rows beside those of its SQL."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def differences(df, sql: str, sf_dir: str) -> str:
    """What differs, or an empty text."""
    theirs = duck(sf_dir).sql(sql)
    a, b = sorted(df.columns), sorted(theirs.columns)
    if a != b:
        return f"columns {a} {b}"
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    other = rows(theirs.columns, theirs.fetchall())
    if mine == other:
        return ""
    odd = [x for x in zip(mine, other) if x[0] != x[1]][:2]
    return f"{len(mine)} and {len(other)} rows; first differences {odd}"
