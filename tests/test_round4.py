"""Zero prices as SQL has them, and steps whose tasks and batches are bounded however long the input."""

import math
import os
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from barspark import catalog, session
from barspark.catalog import research
from barspark.functions import factors as fx
from barspark.functions.expr import col, compile, compile_long, rolling
from barspark.operators import results
from barspark.operators.prefix import numbered
from barspark.operators.recursive import Ema
from barspark.streaming import streams
from helpers import bars

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
T0 = datetime(2020, 1, 1)


def test_a_long_replay_has_no_more_batches_than_asked_for(spark, monkeypatch):
    ran = []
    kept = streams._table
    monkeypatch.setattr(streams, "_table", lambda s, path, schema: ran.append(sorted(os.listdir(path.removeprefix("file://")))) or kept(s, path, schema))
    stream = research._replayed(spark, bars(spark, range(1, 41)).select("symbol", "ts", "close"), "few", 2, most_batches=3)
    assert sorted(r.close for r in streams.drain(stream, "append", at_once=False).collect()) == [float(x) for x in range(1, 41)]
    assert ran == [["batch=0", "batch=1", "batch=2"]]


def test_range_volatility_of_a_bar_that_touches_zero(spark):
    b = bars(spark, range(10, 60)).selectExpr("symbol", "ts", "open", "high", "CASE WHEN close = 12 THEN 0D ELSE low END AS low", "close", "volume")
    got = compile(b, {"g": fx.garman_klass(5), "p": fx.parkinson(5)}).orderBy("ts").collect()
    assert [i for i, r in enumerate(got) if math.isinf(r.g)] == [i for i, r in enumerate(got) if math.isinf(r.p)] == [2, 3, 4, 5, 6]
    wide = compile(b, {"g": fx.garman_klass(40), "p": fx.parkinson(40)}).orderBy("ts").collect()
    assert [i for i, r in enumerate(wide) if math.isinf(r.g) and math.isinf(r.p)] == list(range(2, 42))


def fills(spark, rows):
    return spark.createDataFrame([(i, s, T0 + timedelta(hours=i), float(p), float(z)) for i, (s, p, z) in enumerate(rows)], "order_id long, symbol string, ts timestamp_ntz, price double, size double")


def test_a_trade_entered_at_zero_has_an_infinite_gain(spark):
    f = fills(spark, [("A", 0, 5), ("A", 3, -5), ("B", 0, -2), ("B", 1, 2), ("C", 0, 1), ("C", 0, -1), ("D", 2, 1), ("D", 3, -1)])
    got = {r.symbol: r.pnl_pct for r in results.fifo_trades(f).collect()}
    assert got["A"] == math.inf and got["B"] == -math.inf and math.isnan(got["C"]) and got["D"] == 0.5
    assert {r.symbol: r.avg_pnl_pct for r in results.by_symbol(results.fifo_trades(f.where("symbol in ('A', 'D')"))).collect()} == {"A": math.inf, "D": 0.5}
    assert results.by_month(results.fifo_trades(f.where("symbol in ('A', 'D')"))).first().avg_pnl_pct == math.inf


def test_rounding_is_that_of_the_sql(spark):
    import duckdb

    values = [8.0046875, -8.0046875, 57.63 / 6.4 - 1, 0.0000005, 1.0078125, -0.0, 1e15 + 0.3, math.inf]
    got = [r.v for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(catalog.r6("v", "v")).collect()]
    assert got == [duckdb.sql(f"SELECT {catalog.R('$v')}", params={"v": v}).fetchall()[0][0] for v in values]


def test_fills_are_sorted_twice_and_dealt_once(spark, monkeypatch):
    f = fills(spark, [(s, 1 + i % 7, 3 if i % 2 else -2) for i in range(40) for s in "AB"])
    plan = results.fifo_trades(f)._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 2
    wanted = sorted(map(str, results.fifo_trades(f).collect()))
    assert sorted(map(str, results.fifo_trades(session.spread(f, ["symbol"], 23)).collect())) == wanted
    assert session.spread(f, ["symbol"], 23).rdd.getNumPartitions() == 23 and session.spread(f, ["symbol"], 2) is f
    assert session.tasks_for(0) == 0 and session.tasks_for(session.TASK_ROWS + 1) == 2


def test_a_streamed_average_goes_out_in_pieces(spark):
    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    rng, state, n = np.random.default_rng(3), State(), streams.PIECE + 500
    price = rng.normal(100, 5, 2 * n)
    price[[0, n + 7]] = np.nan
    frame = pd.DataFrame({"symbol": "A", "ts": pd.date_range(T0, periods=2 * n, freq="s"), "price": price})
    got = []
    for half in (frame[:n], frame[n:]):
        pieces = list(streams._averaged(20)(("A",), iter(np.array_split(half.sample(frac=1, random_state=1), 5)), state))
        assert [len(p) for p in pieces] == [streams.PIECE, 500]
        got += pieces
    out = pd.concat(got)
    want, _ = Ema(20).step(price, None)
    assert (out["ts"].to_numpy() == frame["ts"].to_numpy()).all() and np.allclose(out["ema"], want, equal_nan=True, rtol=1e-12)


def test_long_histories_in_chunks_with_what_they_look_back_on(spark):
    rng = np.random.default_rng(5)
    rows = [(s, T0 + timedelta(minutes=i), float(v)) for s, n in (("A", 430), ("B", 1), (None, 95)) for i, v in enumerate(rng.normal(50, 9, n))]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, close double").repartition(4)
    laid = numbered(df, "symbol", "ts", "x")
    places = {}
    for r in sorted(laid.collect(), key=lambda r: (r.symbol or "", r.ts)):
        places.setdefault(r.symbol, []).append(r.x)
    assert places == {s: [float(i) for i in range(1, n + 1)] for s, n in (("A", 430), ("B", 1), (None, 95))}
    exprs = {"m": rolling("avg", 40, col("close")), "s": rolling("stddev_samp", 40, col("close")), "b": rolling("regr_slope", 40, col("close"), col("x")), "k": rolling("count", 7, col("close"))}
    keyed = lambda d: d.toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    want = keyed(compile(laid, exprs))
    for rows_each, tasks in ((100, 23), (40, None), (1, None)):
        pd.testing.assert_frame_equal(keyed(compile_long(laid, exprs, "x", 40, tasks, rows_each)), want, rtol=1e-9)
    plan = compile_long(laid, exprs, "x", 40, 23, 100)
    assert "hashpartitioning(symbol" in plan._jdf.queryExecution().executedPlan().toString() and ", 23)" in plan._jdf.queryExecution().executedPlan().toString()
