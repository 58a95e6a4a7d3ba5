"""Bars for tests, and the comparison of a query with its SQL."""

from __future__ import annotations

from datetime import datetime, timedelta

import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
BARS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def bars(spark, closes, symbol="SPY", start=datetime(2020, 1, 1), spread=1.0, volume=1e6, step=timedelta(days=1)):
    rows = [(symbol, start + i * step, float(c), float(c + spread), float(c - spread), float(c), float(volume)) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, BARS)


def sorted_frame(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "M":
            df[c] = df[c].astype("datetime64[us]").astype(str)
        elif df[c].dtype.kind in "iu":
            df[c] = df[c].astype(float)
        elif df[c].dtype == object:
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NaT or v != v else str(v)[:10] if hasattr(v, "isoformat") else str(v))
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


def same_as_sql(query, sql, spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    mine, want = sorted_frame(query(spark, sf_dir).toPandas()), sorted_frame(con.execute(sql).df())
    for c in want.columns:  # dates come as such or as midnight
        if want[c].dtype == object and len(want) and isinstance(want[c].iloc[0], str) and want[c].str.len().eq(26).all() and mine[c].astype(str).str.len().eq(10).all():
            want[c] = want[c].str[:10]
    pd.testing.assert_frame_equal(mine, want, check_dtype=False, rtol=0, atol=2e-6)
