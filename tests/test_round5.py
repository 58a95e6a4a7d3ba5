"""Fills without a time, and times of a session in a zone with daylight saving."""

from datetime import datetime, timedelta

import pytest

from barspark import catalog
from helpers import sorted_frame

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@pytest.mark.parametrize("name", ["trades_fifo", "trades_alternating", "trades_by_symbol"])
def test_trades_equal_sql_in_any_time_zone_and_without_times(spark, tmp_path, name):
    import duckdb
    import pandas as pd

    t = datetime(2024, 3, 9, 20)  # New York skips an hour on the 10th
    rows = [(i, None if i in (5, 6, 18) else t + timedelta(hours=i // 2), i % 3, "view", float(7 * i % 11), None) for i in range(30)]
    rows += [(None, t, 2, "view", 2.5, None), (99, t, None, "view", 3.0, None), (98, t + timedelta(days=2), None, "view", 4.0, None)]
    spark.createDataFrame(rows, EVENTS).write.parquet(f"{tmp_path}/events.parquet")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        mine = sorted_frame(catalog.queries()[name](spark, str(tmp_path)).toPandas())
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    want = sorted_frame(duckdb.connect().execute(f"WITH events AS (SELECT * FROM '{tmp_path}/events.parquet/*.parquet') SELECT * FROM ({catalog.oracle_sql()[name]})").df())
    pd.testing.assert_frame_equal(mine, want, check_dtype=False, rtol=0, atol=0)
