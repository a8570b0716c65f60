"""Rows of a Spark query and of its SQL in DuckDB, made comparable."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 7) + 0.0
    return int(v) if isinstance(v, int) and not isinstance(v, bool) else [plain(x) for x in v] if isinstance(v, list) else v


def duck_rows(sf_dir: str, sql: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.sql(f"create view {t} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    got = con.sql(sql)
    order = sorted(range(len(got.columns)), key=lambda i: got.columns[i])
    return sorted(got.columns), Counter(tuple(repr(plain(r[i])) for i in order) for r in got.fetchall())


def spark_rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(repr(plain(r[n])) for n in names) for r in df.collect())
