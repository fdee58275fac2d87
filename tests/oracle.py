"""Compares a query with its SQL, column by column, whatever the row order."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def value(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, float):
        return f"{v:.6g}" if v else "0"
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist"):
        v = v.tolist() if hasattr(v, "tolist") else v
        return str([value(x) for x in v]) if isinstance(v, list) else value(v)
    return str(v)


def differences(df, con, sql):
    rel = con.sql(sql)
    want_cols, got_cols = list(rel.columns), df.columns
    if sorted(want_cols) != sorted(got_cols):
        return f"columns {sorted(got_cols)} and {sorted(want_cols)}"
    cols = sorted(got_cols)
    got = sorted(tuple(value(r[c]) for c in cols) for r in df.collect())
    want = sorted(tuple(value(r[want_cols.index(c)]) for c in cols) for r in rel.fetchall())
    if len(got) != len(want):
        return f"{len(got)} rows, not {len(want)}"
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    return f"{len(bad)} of {len(got)} rows differ, as {bad[0]}" if bad else ""
