"""Holds a registered query against its DuckDB counterpart."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=_key)


def _key(row):
    return tuple((v is None, str(v)) for v in row)


def expected(sql, folder):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    found = con.sql(sql)
    return sorted(found.project(", ".join(f'"{c}"' for c in sorted(found.columns))).fetchall(), key=_key), sorted(found.columns)
