"""Comparison of a query with its SQL on the same tables, order aside."""

from pathlib import Path

import duckdb


def canon(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "NULL" if v != v else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(canon, v)) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{canon(x)}" for k, x in sorted(v.items())) + "}"
    return str(v)


def rows(table):
    cols = sorted(table.column_names)
    return cols, sorted(tuple(canon(r[c]) for c in cols) for r in table.to_pylist())


def connect(data):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def assert_same(spark, data, entry):
    got = rows(entry.run(spark, data).toArrow())
    want = rows(connect(data).execute(entry.sql).to_arrow_table())
    assert got[0] == want[0]
    assert got[1] == want[1]
