"""Rows of two engines in a common form."""

from __future__ import annotations

import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if value is None or value != value:
        return "null"
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return str(bool(value))
    if isinstance(value, (int, float)) or hasattr(value, "dtype"):
        return repr(round(float(value), 9))
    return str(value)


def rows(frame) -> list[tuple]:
    columns = sorted(frame.columns)
    return sorted(tuple(plain(v) for v in row) for row in frame[columns].itertuples(index=False))


def assert_same(spark, sf_dir: str, query, sql: str) -> None:
    import pandas as pd

    ours, theirs = query(spark, sf_dir).toPandas(), duck(sf_dir).sql(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    ours, theirs = (f.astype(object).where(pd.notna(f), None) for f in (ours, theirs))
    a, b = rows(ours), rows(theirs)
    assert len(a) == len(b)
    assert [x for x, y in zip(a, b, strict=True) if x != y] == []
