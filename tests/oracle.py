"""Compare a query with its SQL as the driver does: names, row count, values."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def _rows(frame):
    frame = frame[sorted(frame.columns)]
    out = [tuple(None if pd.isna(v) else round(v, 9) if isinstance(v, float) else v for v in row) for row in frame.astype(object).itertuples(index=False)]
    return sorted(out, key=lambda r: tuple((v is not None, v) for v in r))


def assert_same(df, sql, con):
    got, want = df.toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = _rows(got), _rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(v == w or (isinstance(v, float) and isinstance(w, float) and abs(v - w) < 1e-9) for v, w in zip(x, y)), (x, y)
