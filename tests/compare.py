"""Run registered queries beside their SQL statements in DuckDB."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _row(values):
    return tuple("NULL" if v is None or (isinstance(v, float) and math.isnan(v)) else v
                 for v in values)


def differences(df, con, sql: str, slack: float = 0.0) -> list[str]:
    """Problems found; empty when both sides hold the same rows."""
    expected = con.execute(sql)
    names = [d[0] for d in expected.description]
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    order = sorted(names)
    theirs = [_row(r[names.index(c)] for c in order) for r in expected.fetchall()]
    ours = [_row(r) for r in df.select(*order).collect()]
    key = lambda row: tuple(str(v) for v in row)
    if len(ours) != len(theirs):
        return [f"{len(ours)} rows != {len(theirs)}"]
    left, right = set(ours), set(theirs)
    bad_a, bad_b = sorted(left - right, key=key), sorted(right - left, key=key)
    if not bad_a and not bad_b:
        return []
    return [f"{len(bad_a)} of {len(ours)} rows differ"] + [
        f"  spark {a}\n  duck  {b}" for a, b in zip(bad_a[:3], bad_b[:3])]
