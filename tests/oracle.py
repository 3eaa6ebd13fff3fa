"""Runs a query's oracle and compares rows whatever their order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(sql: str, sf: str, columns: list[str]) -> list[tuple]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(columns)
    return ordered([tuple(r[names.index(c)] for c in columns) for r in got.fetchall()])


def ordered(rows) -> list[tuple]:
    plain = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: tuple((v is not None, v if v is not None else 0) for v in r))


def agrees(df, sql: str, sf: str) -> None:
    columns = sorted(df.columns)
    got = ordered(tuple(r) for r in df.select(*columns).collect())
    assert got == rows_of(sql, sf, columns)
