"""Compare a query with its SQL over the same tables."""

import os

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con


def same(got, want):
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    order = [c for c in columns if got[c].dtype.kind != "f"] or columns
    a, b = (x[columns].sort_values(order).reset_index(drop=True) for x in (got, want))
    assert len(a) == len(b)
    for c in columns:
        if a[c].dtype.kind == "f" or b[c].dtype.kind == "f":
            assert np.isclose(a[c].astype(float), b[c].astype(float), rtol=1e-6, atol=2e-6, equal_nan=True).all(), c
        else:
            assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c
