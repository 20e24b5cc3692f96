"""Runs queries and their SQL twins on the same tables and compares the rows."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb


def cell(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6)
    return v.item() if hasattr(v, "item") else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(cell(r[i]) for i in order) for r in data)


def compare(spark, folder, name, query, sql):
    db = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found = db.execute(sql)
    names = [d[0] for d in found.description]
    want = rows(names, found.fetchall())
    df = query(spark, folder)
    assert sorted(df.columns) == sorted(names), (name, df.columns, names)
    got = rows(df.columns, df.collect())
    assert got == want, (name, sum(got.values()), sum(want.values()), list((got - want).items())[:2], list((want - got).items())[:2])
    assert got or name in ("alert_conditions",), f"{name} is empty"
