"""Compares a query's rows with its SQL's, order aside."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def tidy(row):
    return tuple("null" if v is None else f"{v:.5f}" if isinstance(v, float) and math.isfinite(v) else str(v) for v in row)


def difference(df, con, sql):
    rel = con.sql(sql)
    names = sorted(rel.columns)
    if sorted(df.columns) != names:
        return f"columns {sorted(df.columns)} and {names}"
    a = sorted(tidy(r[c] for c in names) for r in df.collect())
    at = [rel.columns.index(c) for c in names]
    b = sorted(tidy(r[i] for i in at) for r in rel.fetchall())
    if a != b:
        only = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
        return f"{len(a)} and {len(b)} rows; only here and there: {only}"
    return ""
