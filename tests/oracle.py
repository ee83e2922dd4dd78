"""Rows of a query and of its SQL twin in DuckDB, in one canonical form."""

import math
from pathlib import Path

import duckdb


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda x: None if x is None or isinstance(x, float) and math.isnan(x) else round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else float(x) if type(x).__name__ == "Decimal" else x
    return sorted(([cell(r[i]) for i in order] for r in rows), key=repr), sorted(columns)


def twin(sql: str, sf_dir: str):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got = con.execute(sql)
    return canonical([d[0] for d in got.description], got.fetchall())


def ours(df):
    return canonical(df.columns, [tuple(r) for r in df.collect()])
