"""Golden values of indicators, loaders, execution, results and streams."""

from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barspark.functions import execution as ex
from barspark.functions import factors as fx
from barspark.functions.expr import col, compile
from barspark.operators import actions, alloc, filters, panel, recursive, regress, results, risk, signals
from barspark.operators.prefix import running
from barspark.plans import backtest as bt
from barspark.plans import research, strategies
from barspark.plans.pipeline import Pipeline
from barspark.plans.report import html, markdown
from barspark.sources import readers
from barspark.sources.bars import resample
from barspark.streaming import streams
from helpers import bars


def values(df, name="value"):
    return [r[name] for r in df.orderBy("symbol", "ts").collect()]


def orders(spark, rows):
    return spark.createDataFrame(rows, "run_id string, ts timestamp_ntz, seq int, " + bt.ORDER)


def test_sma_and_roc(spark):
    b = bars(spark, range(100, 120))
    sma = values(compile(b, {"value": fx.sma(5)}))
    assert sma[0] == 100.0 and sma[4] == 102.0
    assert values(compile(b, {"value": fx.sma(10)}))[9] == 104.5
    assert values(compile(b, {"value": fx.roc(1)}))[1] == pytest.approx(1.0)
    assert all(0 <= v <= 100 for v in values(compile(b, {"value": fx.rsi()})))
    assert values(compile(b, {"value": fx.atr(5)}))[-1] == pytest.approx(2.0)


def test_moments_agree_with_pandas(spark):
    rng = np.random.default_rng(1)
    c = 100 + rng.normal(size=60).cumsum()
    b, r = bars(spark, c), pd.Series(c).pct_change()
    for e, want in ((fx.return_skew(20), r.rolling(20, min_periods=3).skew()), (fx.return_kurtosis(20), r.rolling(20, min_periods=4).kurt())):
        got = np.array(values(compile(b, {"value": e})), float)
        assert np.allclose(got[4:], want[4:], equal_nan=True)
    ema = values(recursive.ema(b.select("symbol", "ts", "close"), 10), "ema")
    assert np.allclose(ema, pd.Series(c).ewm(span=10, adjust=False).mean())


def test_factor_difference_and_common_nodes(spark):
    b = bars(spark, [1, 2, 4, 8])
    e = fx.returns() - fx.returns()
    assert values(compile(b, {"value": e}))[1:] == [0.0, 0.0, 0.0]
    plan = compile(b, {"a": fx.volatility(5), "b": fx.low_volatility(5)})._jdf.queryExecution().toString()
    assert plan.count("stddev_samp") > 0


def test_rank_ties_and_missing(spark):
    d = datetime(2020, 1, 1)
    rows = [(s, d, 0.0, 0.0, 0.0, c, 1.0) for s, c in (("a", 1.0), ("b", 2.0), ("c", 2.0), ("d", None))]
    b = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    assert values(compile(b, {"value": col("close").rank()})) == [3.0, 1.5, 1.5, None]
    assert values(compile(b, {"value": col("close").percentile()})) == [pytest.approx(100 / 3), pytest.approx(250 / 3), pytest.approx(250 / 3), None]
    kept = Pipeline({"c": col("close")}, {}, filters.TopN("c", 2)).run(b)
    assert sorted(r["symbol"] for r in kept.where("screen").collect()) == ["b", "c"]
    with pytest.raises(ValueError):
        Pipeline({"c": col("close")}, {}, "none").run(b)
    with pytest.raises(ValueError):
        Pipeline({"c": col("close")}, {}, filters.TopN("x", 2)).run(b)


def test_crossings(spark):
    b = bars(spark, [100, 105, 95, 100, 105, 95]).withColumn("m", F.lit(100.0))
    up = signals.cross_over(b, "close", "m")
    assert [r["cross_over"] for r in up.orderBy("ts").collect()] == [False, False, False, False, False, False]
    b = bars(spark, [99, 105, 95, 101]).withColumn("m", F.lit(100.0))
    assert [r["cross_over"] for r in signals.cross_over(b, "close", "m").orderBy("ts").collect()] == [False, True, False, True]
    assert [r["cross_under"] for r in signals.cross_under(b, "close", "m").orderBy("ts").collect()] == [False, False, True, False]


def test_calendar_and_alignment(spark):
    a, b = bars(spark, range(10), "A"), bars(spark, range(8), "B", datetime(2020, 1, 3))
    both = a.unionByName(b)
    assert panel.common_calendar(both).count() == 8
    assert panel.align_to_calendar(both, panel.common_calendar(both)).count() == 16
    with pytest.raises(Exception, match="no close|no open"):
        panel.align_to_calendar(both, both.select("ts")).collect()


def test_loaders(spark, tmp_path):
    (tmp_path / "SPY_daily.csv").write_text("datetime,open,high,low,close,volume\n,SPY,SPY,SPY,SPY,SPY\n" + "".join(f"2020-01-0{i},100,101,99,100.5,1000\n" for i in (1, 2, 3)))
    df = readers.load_csv(spark, str(tmp_path / "SPY_daily.csv"))
    assert df.count() == 3 and {r["symbol"] for r in df.collect()} == {"SPY"}
    bars(spark, [1, 2, 3, 4]).drop("symbol").toPandas().to_parquet(tmp_path / "tqqq.parquet", coerce_timestamps="us")
    assert {(r["symbol"], r["close"]) for r in readers.load_parquet(spark, str(tmp_path / "tqqq.parquet")).collect()} == {("TQQQ", c) for c in (1.0, 2.0, 3.0, 4.0)}
    (tmp_path / "qqq.csv").write_text("Date,Open,High,Low,Close,Volume,Adj Close\n2020-01-01,1,2,0.5,1.5,10,0.75\n")
    (tmp_path / "iwm.csv").write_text("Adj Close,Note,Vol,Close,Low,High,Open,time\n0.75,x,10,1.5,0.5,2,1,2020-01-01\n")
    (tmp_path / "dia_old.csv").write_text("Date,Close,Open,High,Low,Volume\n2020-01-01,9,9,9,9,9\n")
    (tmp_path / "dia_x.csv").write_text("Date,Close,Open,High,Low,Volume\n2020-01-01,2,1,4,0.5,10\n")
    every = {(r["symbol"], str(r["ts"])[:10]): tuple(r)[2:] for r in readers.load_directory(spark, str(tmp_path)).collect()}
    day = "2020-01-01"
    assert every.pop(("QQQ", day)) == every.pop(("IWM", day)) == (1.0, 2.0, 0.5, 0.75, 10.0, 1.5)
    assert every.pop(("DIA", day)) == (1.0, 4.0, 0.5, 2.0, 10.0, None)
    assert sorted(every) == [("SPY", f"2020-01-0{i}") for i in (1, 2, 3)] + [("TQQQ", f"2020-01-0{i}") for i in (1, 2, 3, 4)]
    assert every["SPY", day] == (100.0, 101.0, 99.0, 100.5, 1000.0, None) and every["TQQQ", "2020-01-03"] == (3.0, 4.0, 2.0, 3.0, 1e6, None)
    assert {r["symbol"] for r in readers.load_directory(spark, str(tmp_path), symbols=["qqq", "Tqqq"]).collect()} == {"QQQ", "TQQQ"}
    assert {r["symbol"] for r in readers.load_directory(spark, str(tmp_path), "parquet").collect()} == {"TQQQ"}
    with pytest.raises(ValueError, match="missing"):
        readers.normalize(spark.createDataFrame([("2020-01-01", 1.0)], "date string, close double"))


def test_action_files(spark, tmp_path):
    (tmp_path / "splits.csv").write_text("ticker,date,split_ratio\naapl,2020-01-11,2\n,bad,1\n")
    got = readers.load_splits(spark, str(tmp_path / "splits.csv")).collect()
    assert [(r["symbol"], r["date"], r["ratio"]) for r in got] == [("AAPL", date(2020, 1, 11), 2.0)]
    (tmp_path / "bad.csv").write_text("symbol,date,ratio\nA,2020-01-01,0\n")
    with pytest.raises(Exception, match="above 0"):
        readers.load_splits(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "div.csv").write_text("sym,date,div\na,2020-01-02,0.5\n")
    assert readers.load_dividends(spark, str(tmp_path / "div.csv")).first()["amount"] == 0.5
    (tmp_path / "events.csv").write_text("timestamp,type,symbol,eps,revenue\n2023-01-15 10:00:00,earnings,aapl,1.5,\n2023-01-16 10:00:00,macro,,,\n")
    e = {r["type"]: r for r in readers.load_events(spark, str(tmp_path / "events.csv")).collect()}
    assert e["earnings"]["payload"] == {"eps": "1.5"} and e["earnings"]["symbol"] == "AAPL"
    assert e["macro"]["payload"] is None and e["macro"]["symbol"] is None


def test_split_detection(spark):
    d0 = datetime(2021, 1, 1)
    raw = [100 + 0.1 * i if i < 10 else 50 + 0.05 * (i - 10) for i in range(20)]
    s = spark.createDataFrame([("SPY", date(2021, 1, 11), 2.0)], "symbol string, date date, ratio double")
    b = bars(spark, raw, start=d0)
    r = actions.detect_adjusted(b, s).first()
    assert not r["is_adjusted"] and r["raw_votes"] == 1
    flat = bars(spark, [100.0] * 20, start=d0)
    assert actions.detect_adjusted(flat, s).first()["is_adjusted"]
    assert actions.drop_adjusted(flat, s).count() == 0 and actions.drop_adjusted(b, s).count() == 1
    adjusted = values(actions.back_adjust(b, s), "close")
    assert adjusted[0] == pytest.approx(50.0) and adjusted[10] == pytest.approx(50.0)


def test_limit_and_stop_fills(spark):
    t = datetime(2021, 1, 1)
    b = spark.createDataFrame([("A", t, 100.0, 110.0, 90.0, 105.0, 1000.0)], "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    o = orders(spark, [("r", t, 1, "A", "LIMIT", 1.0, 95.0, None, None), ("r", t, 2, "A", "LIMIT", 1.0, 85.0, None, None), ("r", t, 3, "A", "STOP", 1.0, None, 108.0, None), ("r", t, 4, "A", "STOP", -1.0, None, 92.0, None), ("r", t, 5, "A", "STOP_LIMIT", 1.0, 200.0, 108.0, None)])
    got = bt.fills(bt.run(b, o)).orderBy("order_id").collect()
    assert sorted(r["price"] for r in got) == [92.0, 95.0, 108.0]


def test_volume_and_gross_limits(spark):
    t = datetime(2021, 1, 1)
    b = bars(spark, [100], "A", t, volume=1000)
    o = orders(spark, [("r", t, 1, "A", "MARKET", 500.0, None, None, None)])
    assert bt.fills(bt.run(b, o, bt.Rules(volume=ex.volume_limit(0.1)))).first()["size"] == 100.0
    assert bt.fills(bt.run(bars(spark, [100], "A", t, volume=0), o)).count() == 0
    two = b.unionByName(bars(spark, [100], "B", t, volume=1000))
    o = orders(spark, [("r", t, i, s, "TARGET_PERCENT", None, None, None, 1.0) for i, s in enumerate("AB")])
    sizes = [r["size"] for r in bt.fills(bt.run(two, o, bt.Rules(capital=1000.0, max_gross_leverage=1.0))).collect()]
    assert sizes == [5.0, 5.0]


def test_next_open_and_splits_and_dividends(spark):
    b = bars(spark, [100, 101, 102], "A")
    t = datetime(2020, 1, 1)
    o = orders(spark, [("r", t, 1, "A", "MARKET", 10.0, None, None, None)])
    got = bt.fills(bt.run(b, o, bt.Rules(next_open=True, price=ex.open_price()))).collect()
    assert [(r["ts"], r["price"]) for r in got] == [(t + timedelta(days=1), 101.0)]
    c = [100.0 if i < 3 else 50.0 for i in range(6)]
    s = spark.createDataFrame([("A", date(2020, 1, 4), 2.0)], "symbol string, date date, ratio double")
    e = [r["equity"] for r in bt.equity(bt.run(bars(spark, c, "A"), o, splits=s)).orderBy("ts").collect()]
    assert len(set(e)) == 1
    d = spark.createDataFrame([("A", date(2020, 1, 3), 0.5)], "symbol string, date date, amount double")
    e = [r["cash"] for r in bt.equity(bt.run(bars(spark, [100.0] * 4, "A"), o, dividends=d)).orderBy("ts").collect()]
    assert e[2] - e[1] == pytest.approx(5.0)


def test_apply_fill_averages():
    s = bt.State(1000.0, 1000.0, 1000.0)
    bt.apply_fill(s, "A", 10, 10.0, 0.0)
    bt.apply_fill(s, "A", 5, 12.0, 0.0)
    assert s.average["A"] == pytest.approx((10 * 10 + 5 * 12) / 15)
    bt.apply_fill(s, "A", -8, 11.0, 0.0)
    assert s.cash == pytest.approx(1000 - 100 - 60 + 88) and s.positions["A"] == 7
    bt.apply_fill(s, "A", -7, 11.0, 0.0)
    assert not s.positions


def test_price_models():
    bar = {"open": 99.0, "high": 102.0, "low": 98.0, "close": 104.0}
    assert ex.midpoint().scalar(bar) == 100.0 and ex.typical_vwap().scalar(bar) == 100.75
    assert ex.bps_slippage(25).scalar(-1, 100.0) == pytest.approx(99.75)


def test_stream_backtest_equals_batch(spark, tmp_path):
    b = bars(spark, [100, 102, 101, 105, 103, 107, 110, 108], "A")
    o = bt.target_orders(strategies.sma_crossover(b, fast=2, slow=4))
    batch = [r["equity"] for r in bt.equity(bt.run(b, o)).orderBy("ts").collect()]
    lines = bt.by_time(b, o)
    lines.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "lines"))
    stream = spark.readStream.schema(lines.schema).parquet(str(tmp_path / "lines"))
    got = streams.drain(streams.backtest(stream), "append").where("kind = 'equity'").orderBy("ts").collect()
    assert [r["equity"] for r in got] == pytest.approx(batch)


def test_metrics_and_trades(spark):
    t = datetime(2023, 1, 1)
    e = spark.createDataFrame([(t + timedelta(days=i), float(v)) for i, v in enumerate([100, 110, 105, 120])], "ts timestamp_ntz, equity double")
    s = results.summary(e).first()
    assert s["total_return"] == pytest.approx(0.2) and s["max_drawdown"] == pytest.approx(105 / 110 - 1)
    f = spark.createDataFrame([(1, "AAPL", 10.0, 100.0, t), (2, "AAPL", -10.0, 110.0, t + timedelta(days=1)), (3, "MSFT", 5.0, 200.0, t), (4, "MSFT", -5.0, 210.0, t + timedelta(days=1))], "order_id long, symbol string, size double, price double, ts timestamp_ntz")
    tr = results.fifo_trades(f)
    assert {r["symbol"]: r["pnl"] for r in tr.collect()} == {"AAPL": 100.0, "MSFT": 50.0}
    assert "total_return" in markdown(e, tr) and "<table" in html(e, tr)
    c = spark.createDataFrame([(1.0, 0.5, 100.0), (2.0, 0.5, 200.0), (3.0, 0.5, 100.0)], "fees double, slippage double, size double")
    assert results.costs(c).first()["cost_per_turnover"] == pytest.approx(7.5 / 200)


def test_fifo_lots_partial_and_short(spark):
    t = datetime(2023, 1, 1)
    rows = [(1, 10.0, 100.0), (2, 5.0, 110.0), (3, -12.0, 120.0), (4, -8.0, 90.0), (5, 5.0, 80.0)]
    f = spark.createDataFrame([(i, "A", s, p, t + timedelta(days=i)) for i, s, p in rows], "order_id long, symbol string, size double, price double, ts timestamp_ntz")
    got = sorted((r["direction"], r["size"], r["entry_price"], r["exit_price"], r["pnl"]) for r in results.fifo_trades(f).collect())
    assert got == [("long", 2.0, 110.0, 120.0, 20.0), ("long", 3.0, 110.0, 90.0, -60.0), ("long", 10.0, 100.0, 120.0, 200.0), ("short", 5.0, 90.0, 80.0, 50.0)]


def test_optimisers():
    cov = np.full((3, 3), 0.01) + np.diag([0.03, 0.03, 0.03])
    lo, hi = alloc.Bounds(high=0.5).of(list("ABC"))
    assert alloc.min_variance(cov, lo, hi) == pytest.approx([1 / 3] * 3, abs=1e-6)
    w = alloc.max_sharpe(np.array([0.10, 0.08, 0.06]), cov, lo, hi)
    assert w.sum() == pytest.approx(1) and w[0] >= w[1] >= w[2] and (w <= 0.5 + 1e-9).all()
    c = np.diag([0.01, 0.04, 0.09])
    w = alloc.risk_parity(c, *alloc.Bounds().of(list("ABC")))
    shares = w * (c @ w)
    assert shares == pytest.approx([shares.mean()] * 3, rel=1e-6)
    with pytest.raises(ValueError):
        alloc.Bounds(low=1.0, high=0.0)


def test_regression_and_psd(spark):
    rng = np.random.default_rng(0)
    x, z = rng.normal(size=200), rng.normal(size=200)
    y = 1.5 * x + 0.5 * z + rng.normal(scale=0.1, size=200) + 0.01
    df = spark.createDataFrame(pd.DataFrame({"y": y, "x": x, "z": z}))
    a = regress.attribution(df, "y", ["x", "z"])
    want = np.linalg.lstsq(np.c_[np.ones(200), x, z], y, rcond=None)[0]
    assert [a["alpha"], a["betas"]["x"], a["betas"]["z"]] == pytest.approx(want)
    assert risk.is_psd(np.eye(2)) and risk.condition_number(np.diag([1.0, 4.0])) == 4.0


def test_rolling_ols_three_factors(spark):
    rng = np.random.default_rng(2)
    n = 40
    d = pd.DataFrame(rng.normal(size=(n, 4)), columns=["y", "a", "b", "c"])
    d["symbol"], d["ts"] = "A", pd.date_range("2020-01-01", periods=n)
    got = regress.rolling_ols(spark.createDataFrame(d), "y", ["a", "b", "c"], 15).orderBy("ts").toPandas()
    for k in (0, 7, len(got) - 1):
        w = d.iloc[k : k + 15]
        want = np.linalg.lstsq(np.c_[np.ones(15), w[["a", "b", "c"]]], w["y"], rcond=None)[0]
        assert got.loc[k, ["alpha", "beta_a", "beta_b", "beta_c"]].to_numpy(float) == pytest.approx(want)


def test_search_space_and_walk_forward(spark):
    s = research.SearchSpace({"a": [1, 2], "b": [3, 4, 5]})
    assert s.size == 6 and len(s.grid()) == 6
    c = research.SearchSpace({"a": research.Continuous(1e-3, 1.0, log=True)})
    assert c.size is None and c.random(3, 1) == c.random(3, 1)
    with pytest.raises(ValueError):
        research.windows(bars(spark, [1]), 0, 1)
    b = bars(spark, [100, 110, 90, 95, 92, 91, 93, 94, 90, 92, 91, 93])

    def exposure(p, exposure):
        return p.select("symbol", "ts", F.lit(float(exposure)).alias("weight"))

    found, _ = research.walk_forward(b, exposure, [{"exposure": 0}, {"exposure": 1}], 4, 3, name="max_drawdown")
    assert {r["combo"] for r in found.collect()} == {0}


def test_resample_rules(spark):
    b = bars(spark, range(10, 30), start=datetime(2021, 1, 1))
    w = resample(b, "1W").orderBy("ts").collect()
    assert w[0]["ts"] == datetime(2021, 1, 3) and w[0]["open"] == 10 and w[0]["close"] == 12 and w[0]["volume"] == 3e6
    with pytest.raises(ValueError):
        resample(b, "5Q")


def test_running_sums(spark):
    import random

    rng = random.Random(2)
    rows = [(i, None if i % 17 == 0 else datetime(2021, 1, 1 + rng.randrange(9), rng.randrange(24)), rng.randrange(5)) for i in range(400)]
    got = running(spark.createDataFrame(rows, "i long, at timestamp_ntz, v long").repartition(5), "at", ["i"], {"s": F.col("v"), "n": F.lit(1)}).collect()
    total, want = 0, {}
    for k, (i, _, v) in enumerate(sorted(rows, key=lambda r: (r[1] is not None, r[1] or datetime(1, 1, 1), r[0])), 1):
        total += v
        want[i] = (total, k)
    assert {r["i"]: (r["s"], r["n"]) for r in got} == want


def test_lots_of_partial_fills(spark):
    """Lots by overlaps against a queue."""
    import random

    rng = random.Random(5)
    t0 = datetime(2021, 1, 1)
    rows = [("r", s, t0 + timedelta(minutes=i), i, float(rng.choice([-3, -2, -1, 1, 2, 3])), float(i % 13 + 1)) for s in "AB" for i in range(200)]
    want = []
    for s in "AB":
        queue = []
        for _, _, t, _, size, price in (r for r in rows if r[1] == s):
            while size and queue and queue[0][0] * size < 0:
                n = min(abs(size), abs(queue[0][0]))
                want.append((s, queue[0][1], t, queue[0][2], price, n))
                size += n if size < 0 else -n
                queue[0][0] += n if queue[0][0] < 0 else -n
                if not queue[0][0]:
                    queue.pop(0)
            if size:
                queue.append([size, t, price])
    fills = spark.createDataFrame(rows, "run string, symbol string, ts timestamp_ntz, order_id long, size double, price double")
    got = [(r["symbol"], r["entry_time"], r["exit_time"], r["entry_price"], r["exit_price"], r["size"]) for r in results.fifo_trades(fills).collect()]
    assert sorted(got) == sorted(want)


def test_stream_batch_that_runs_again(spark, tmp_path, monkeypatch):
    """A micro-batch that is written twice leaves its rows once; late rows behind the watermark are left out in append mode."""
    t0 = datetime(2021, 1, 1)
    rows = [("A", t0 + timedelta(hours=i), 1.0) for i in (0, 1, 2, 30, 60, 61, 3)]
    for k, part in enumerate((rows[:5], rows[5:6], rows[6:])):
        spark.createDataFrame(part, "symbol string, ts timestamp, v double").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema("symbol string, ts timestamp, v double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    counted = stream.withWatermark("ts", "6 hours").groupBy(F.window("ts", "1 day"), "symbol").agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), "n")
    writer = type(spark.range(1).write)
    save, calls = writer.parquet, []

    def twice(self, path, *args, **kwargs):
        calls.append(path)
        save(self, path, *args, **kwargs)
        save(self, path, *args, **kwargs)

    monkeypatch.setattr(writer, "parquet", twice)
    got = sorted((r["day"].day, r["n"]) for r in streams.drain(counted, "append").collect())
    assert got == [(1, 3), (2, 1)] and len(calls) > 1


def test_risk_parity_within_bounds():
    cov = np.array([[0.04, 0.006, 0.0], [0.006, 0.09, 0.01], [0.0, 0.01, 0.16]])
    lo, hi = np.zeros(3), np.array([0.4, 1.0, 1.0])
    w = alloc.risk_parity(cov, lo, hi)
    spread = lambda w: float(((w * (cov @ w) / (w @ cov @ w) - 1 / 3) ** 2).sum())
    assert w.sum() == pytest.approx(1) and w[0] == pytest.approx(0.4, abs=1e-6)
    assert spread(w) <= min(spread(np.array([0.4, x, 0.6 - x])) for x in np.linspace(0.01, 0.59, 300)) + 1e-7
    free = alloc.risk_parity(cov, lo, np.ones(3))
    assert np.allclose(free * (cov @ free), free @ cov @ free / 3)
    assert alloc.deviation(np.array([0.5, 0.5]), np.array([[1.0, -2.0], [-2.0, 1.0]])) == 0.0
