"""Compares a query with its SQL on DuckDB: names, row counts and values without order."""

from pathlib import Path

import duckdb


def connect(sf_dir: str):
    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    v = v.item() if hasattr(v, "item") else v
    return f"{v:.9g}" if isinstance(v, float) else v


def rows(columns, values) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([plain(r[i]) for i in order]) for r in values)


def same(df, c, text: str) -> None:
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    relation = c.sql(text)
    want = rows(relation.columns, relation.fetchall())
    assert sorted(df.columns) == sorted(relation.columns)
    assert len(got) == len(want)
    unlike = [(a, b) for a, b in zip(got, want) if a != b]
    assert not unlike, unlike[:3]
