"""Runs a query and its SQL side by side and compares rows, whatever their order."""

from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in sorted(Path(folder).iterdir()):
        at = p if p.is_file() else p / "*.parquet"
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{at}'")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if x != x else repr(round(x, 9))
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(plain, x)) + "]"
    if hasattr(x, "asDict"):
        return plain(list(x.asDict().values()))
    return repr(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


def same(spark, connection, folder, query, sql):
    df = query(spark, folder)
    cur = connection.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, cur.fetchall())
