"""Runs a query and its SQL and compares their rows, whatever their order."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(rows: list[tuple]) -> list[str]:
    return sorted(repr(tuple(float(v) if isinstance(v, float) else (int(v) if type(v).__name__ == "Decimal" else v) for v in r)) for r in rows)


def differences(spark, con, query, sql: str, sf_dir: str) -> str:
    """Empty if both give the same columns and rows."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = plain([tuple(r) for r in df.select(*names).collect()])
    res = con.execute(sql)
    cols = [c[0] for c in res.description]
    if sorted(cols) != names:
        return f"columns {names} and {sorted(cols)}"
    at = [cols.index(n) for n in names]
    want = plain([tuple(r[i] for i in at) for r in res.fetchall()])
    if got == want:
        return ""
    a, b = [x for x in got if x not in set(want)][:2], [x for x in want if x not in set(got)][:2]
    return f"{len(got)} and {len(want)} rows; only here {a}, only there {b}"
