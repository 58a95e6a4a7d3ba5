"""The forms that operators take at scale, against plain computations, with blocks, chunks and slices made small."""

import json
import os
import random
import statistics
import time
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barspark import catalog
from barspark.catalog.portfolio import _model, _yearly_cov
from barspark.functions import execution as ex
from barspark.functions.expr import col, compile, rolling
from barspark.operators import alloc, panel, prefix, quantiles, recursive, regress, results, risk
from barspark.plans import backtest as bt
from barspark.plans import custom, lockstep, report, research, strategies
from barspark.sources import readers, replay
from barspark.streaming import streams
from helpers import bars

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
T0 = datetime(2020, 1, 1)


def walk(n, seed, gaps=0.0):
    rng = np.random.default_rng(seed)
    x = 100 + rng.normal(size=n).cumsum()
    return [None if rng.random() < gaps else float(v) for v in x]


def series(spark, values, symbol="A"):
    return spark.createDataFrame([(symbol, T0 + timedelta(hours=i), v, float(i)) for i, v in enumerate(values)], "symbol string, ts timestamp_ntz, v double, x double")


# Rolling moments from two halves


def test_wide_frames_equal_sliding_ones(spark, monkeypatch):
    values = walk(300, 1, 0.1) + [7.25] * 120 + walk(60, 2)
    df = series(spark, values).unionByName(series(spark, walk(33, 3), "B"))
    v, x = col("v"), col("x")
    one = "count sum avg min max var_samp var_pop stddev_samp stddev_pop skewness kurtosis".split()
    two = "covar_samp covar_pop regr_slope regr_r2".split()

    def all_():
        exprs = {f: rolling(f, 40, v) for f in one} | {f: rolling(f, 40, v, x) for f in two}
        return compile(df, exprs).orderBy("symbol", "ts").toPandas()

    halves = all_()
    monkeypatch.setattr("barspark.functions.expr.SLIDE", 1000)
    sliding = all_()
    flat = np.arange(350, 415)  # within equal values
    assert (halves.loc[flat, "stddev_pop"] == 0).all() and halves.loc[flat, "skewness"].isna().all()
    moving = ~halves.index.isin(flat)
    for c in one + two:
        a, b = halves[c].astype(float)[moving], sliding[c].astype(float)[moving]
        assert np.allclose(a, b, rtol=1e-8, atol=1e-8, equal_nan=True), c


# Exponential averages by a parallel scan


def test_chunks_of_a_history_give_the_same_averages(spark):
    df = series(spark, [None] * 7 + walk(500, 4, 0.2)).unionByName(series(spark, walk(40, 5), "B")).unionByName(series(spark, [None] * 150, "C")).repartition(7)
    for make in (lambda: recursive.Ema(9), lambda: recursive.Macd(3, 7, 4), lambda: recursive.Ema(1)):
        whole, cut = ({(r.symbol, r.ts): r.y for r in recursive.along(df, {"y": ("v", make)}, chunk=c).collect()} for c in (10_000, 37))
        assert whole.keys() == cut.keys() and len(whole) == 697
        assert all((a is None) == (cut[k] is None) and (a is None or a == pytest.approx(cut[k], rel=1e-9, abs=1e-9)) for k, a in whole.items())


def test_average_in_blocks_equals_the_loop():
    rng = np.random.default_rng(6)
    for alpha in (1e-4, 0.09, 0.5, 0.999, 1.0):
        x = np.where(rng.random(2000) < 0.1, np.nan, 1e6 * rng.normal(size=2000))
        y, want = 3.0, []
        for v in x:
            y = y if v != v else y + alpha * (v - y)
            want.append(y)
        assert np.allclose(recursive.ema_step(x, alpha, 3.0), want, rtol=1e-10)
    assert np.isnan(recursive.ema_step(np.array([np.nan]), 0.5, None)).all()


def test_a_kernel_without_decay_keeps_its_history_whole(spark):
    class Highest(recursive.Kernel):
        def step(self, x, state):
            out = np.maximum.accumulate(np.concatenate([[-np.inf if state is None else state[0]], x]))[1:]
            return out, out[-1:]

    got = recursive.along(series(spark, [1.0, 3.0, 2.0, 5.0]), {"y": ("v", Highest)}, chunk=2).orderBy("ts").collect()
    assert [r.y for r in got] == [1, 3, 3, 5]


# Covariances by blocks


def test_blocks_of_symbols_give_pairwise_covariances(spark):
    rng = np.random.default_rng(7)
    wide = pd.DataFrame(rng.normal(size=(90, 11)) @ rng.normal(size=(11, 11)), columns=[f"s{i}" for i in range(11)], index=pd.date_range("2020-01-01", periods=90))
    wide = wide.mask(rng.random(wide.shape) < 0.2)
    long = wide.stack().rename("v").reset_index().set_axis(["ts", "symbol", "v"], axis=1)
    df = spark.createDataFrame(long).withColumn("ts", F.col("ts").cast("timestamp_ntz")).repartition(5)
    want = wide.cov(min_periods=2)
    for block, times in ((128, 1 << 16), (3, 20)):
        sums = risk.block_products(df, block=block, times=times).groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in risk.Gram.SUMS]).collect()
        assert len(sums) == 66
        for r in sums:
            assert (r.sxy - r.sx * r.sy / r.n) / (r.n - 1) == pytest.approx(want.loc[r.a, r.b])
    got = {(r.a, r.b): r.cov for r in risk.covariance(df, "v").collect()}
    assert all(c == pytest.approx(want.loc[a, b]) for (a, b), c in got.items()) and all(a <= b for a, b in got)

    def folded(**kw):
        parts = risk.block_products(df, 0.1, **kw).collect()
        out = {}
        for r in sorted(parts, key=lambda r: r["_chunk"]):
            y = out.get((r.a, r.b))
            out[r.a, r.b] = r.e if y is None else 0.9**r.n * (y - r.first) + r.e
        return out

    a, b = folded(), folded(block=4, times=13)
    assert a.keys() == b.keys() and all(v == pytest.approx(b[k]) for k, v in a.items())


# Sweeps as rows


def test_a_sweep_scans_its_panel_once(spark, tmp_path):
    bars(spark, walk(80, 8)).write.parquet(str(tmp_path / "panel"))
    p = spark.read.parquet(str(tmp_path / "panel"))
    combos = [{"fast": f, "slow": s} for f in (2, 3, 4) for s in (6, 9, 40)]
    curves = research.portfolio_equity(research.runs(p, strategies.sma_crossover, combos), ["combo"])
    assert curves._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    got = {(r.combo, r.ts): r.equity for r in curves.collect()}
    for k, c in enumerate(combos):  # each by itself
        alone = bt.long_flat(p.join(strategies.sma_crossover(p, **c), ["symbol", "ts"]), F.col("weight"), 1.0)
        assert all(got[k, r.ts] == pytest.approx(r.equity) for r in alone.collect())

    def same(q, **parameters):  # any callable
        return strategies.sma_crossover(q, **parameters)

    other = {(r.combo, r.ts): r.equity for r in research.portfolio_equity(research.runs(p, same, combos[:2]), ["combo"]).collect()}
    assert all(v == pytest.approx(got[k]) for k, v in other.items()) and len(other) == 160


def test_evaluation_of_candidates(spark):
    b = bars(spark, walk(120, 9)).unionByName(bars(spark, walk(120, 10), "B"))
    combos = [{"fast": 2, "slow": 5}, {"fast": 200, "slow": 200}]
    got = research.ranked(research.evaluate(b, strategies.sma_crossover, combos, research.Evaluation(min_trades=1))).collect()
    assert [r.combo for r in got] == [0, 1] and got[1].score == float("-inf") and got[1].folds == 0 and got[1].out_of_sample is None and got[0].trades > 0
    plain = research.evaluate(b, strategies.sma_crossover, combos[:1], research.Evaluation(overfit=False, stability=False)).first()
    assert plain.overfit == plain.stability == 0 and plain.score == pytest.approx(plain.out_of_sample)
    calmar = research.Metric(lambda: F.try_divide(F.col("total_return"), F.abs("max_drawdown")))
    assert research.evaluate(b, strategies.sma_crossover, combos[:1], research.Evaluation(name=calmar)).first().score is not None
    found = research.random_search(b, strategies.sma_crossover, research.SearchSpace({"fast": [2, 3], "slow": [5, 8]}), 5, seed=1).collect()
    assert len(found) == 5 and [r.score for r in found] == sorted((r.score for r in found), reverse=True) and {r.fast for r in found} <= {"2", "3"}


# Quantiles, bootstrap, carried values


def test_quantiles_by_refinement(spark):
    rng = random.Random(3)
    rows = [("a", rng.lognormvariate(0, 3)) for _ in range(3000)] + [("b", float(rng.randrange(4))) for _ in range(2000)] + [("c", 7.0)] * 900 + [("d", rng.gauss(0, 1)) for _ in range(50)]
    rows += [(None, rng.choice([-1e308, 1e308, 0.0, 1e-300, rng.random()])) for _ in range(1500)] + [("e", None)] * 5 + [("a", None)] * 7
    points = [0.0, 0.05, 0.5, 0.9, 0.999, 1.0]
    got = {r.g: (r.n, r.q) for r in quantiles.quantiles(spark.createDataFrame(rows, "g string, v double").repartition(6), ["g"], "v", points, small=200, buckets=8).collect()}
    for g in ("a", "b", "c", "d"):
        x = [v for k, v in rows if k == g and v is not None]
        assert got[g][0] == len(x) and np.allclose(got[g][1], np.quantile(x, points), rtol=1e-12, atol=0)
    assert got["e"] == (0, None) and got[None][1][0] == -1e308 and got[None][1][-1] == 1e308


def test_bootstrap_joined_or_sent(spark):
    e = spark.createDataFrame([(T0 + timedelta(days=i), v) for i, v in enumerate(walk(40, 11))], "ts timestamp_ntz, equity double")
    sent, joined = ({r[0]: r[1:] for r in research.bootstrap(e, 30, seed=5, sent=n).collect()} for n in (1000, 0))
    assert sent.keys() == joined.keys() and all(a == pytest.approx(joined[k]) for k, a in sent.items())


def test_carried_values(spark):
    values = [None, None, 3.0, None, 5.0, None, None, 1.0, None] * 20
    df = spark.createDataFrame([(f"{i:04}", v) for i, v in enumerate(values)], "symbol string, v double").repartition(9)
    want = pd.Series(values, dtype=float).ffill()
    got = prefix.carried(df, ["symbol"], "v", "w").orderBy("symbol").toPandas()["w"].astype(float)
    assert np.allclose(got, want, equal_nan=True)
    assert np.allclose(alloc.filled(df, "v").orderBy("symbol").toPandas()["v"], want.bfill())


# Many runs in lockstep


def order_lines(runs, times, seed):
    rng, lines = random.Random(seed), []
    for t in range(times):
        for r in range(runs):
            if rng.random() < 0.05:
                continue
            line = []
            for s in "ABCD" if r % 7 else "A":
                if rng.random() < 0.1:
                    continue
                c = rng.uniform(5, 20)
                line.append({"symbol": s, "open": c, "high": c * 1.1, "low": c * 0.9, "close": c, "volume": rng.choice([None, 0.0, 5.0, 100.0]), "split": rng.choice([None] * 20 + [2.0]), "dividend": rng.choice([None] * 15 + [0.5]), "exec_price": c * 1.01})
            orders = [{"symbol": rng.choice("ABCDZ"), "order_type": rng.choice(list(lockstep.KINDS)), "size": None if rng.random() < 0.1 else rng.choice([-8.0, -2.0, 3.0, 9.0, 0.0]), "limit_price": rng.choice([None, 8.0, 12.0]), "stop_price": rng.choice([None, 9.0, 14.0]), "target_percent": rng.choice([None, 0.3, -0.2, 0.9, 1.4])} for _ in range(rng.randrange(4))]
            if line:
                lines.append((0, f"r{r}", t, line, orders or None))
    return lines


def order_batches(lines, n):
    b = pa.list_(pa.struct([("symbol", pa.string()), *((c, pa.float64()) for c in lockstep.BAR)]))
    o = pa.list_(pa.struct([("symbol", pa.string()), ("order_type", pa.string()), *((c, pa.float64()) for c in lockstep.ORDER)]))
    for i in range(0, len(lines), n):
        lane, run, t, line, orders = zip(*lines[i : i + n])
        yield pa.RecordBatch.from_arrays([pa.array(lane, pa.int32()), pa.array(run), pa.array(t, pa.int64()).cast(pa.timestamp("us")), pa.array(line, b), pa.array(orders, o)], names=["_lane", "run_id", "ts", "bars", "orders"])


OUTPUT = [(c, {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "timestamp_ntz": pa.timestamp("us")}[t]) for c, t in (x.split(" ") for x in bt.OUTPUT.split(", "))]
RULES = [
    bt.Rules(),
    bt.Rules(slippage=ex.bps_slippage(30), fees=ex.percentage_fees(0.001), volume=ex.volume_limit(0.5), max_symbol_weight=0.4, max_gross_leverage=0.7),
    bt.Rules(next_open=True, fees=ex.per_share_fees(0.01)),
    bt.Rules(price=ex.PriceModel(lambda: None, lambda b: b["exec_price"]), slippage=ex.bps_slippage(500), volume=ex.SizedModel(None, lambda size, volume: size)),  # the price model comes first; a model of one's own
]


@pytest.mark.parametrize("k", range(len(RULES)))
def test_lockstep_equals_the_step_of_one_run(k):
    rules, lines = RULES[k], order_lines(30, 40, k)
    got = pa.Table.from_batches(list(lockstep.fold(order_batches(lines, 97), rules, OUTPUT, True))).to_pylist()
    states, shots, fills, held = {}, {}, [], set()
    for _, run, t, line, orders in lines:
        state = states.setdefault(run, bt.new_state(rules))
        made, shot = bt.step(state, {b["symbol"]: b for b in line}, orders or [], rules)
        ts = datetime(1970, 1, 1) + timedelta(microseconds=t)
        shots[run, ts] = shot
        fills += [(run, ts, f["order_id"], f["symbol"], round(f["size"], 6), round(f["price"], 6), round(f["fee"], 6)) for f in made]
        held |= {(run, ts, s, round(q, 6)) for s, q in state.positions.items()}
    for r in got:
        if r["kind"] == "equity":
            want = shots.pop((r["run_id"], r["ts"]))
            assert all(r[c] == pytest.approx(want[c], rel=1e-9, abs=1e-6) for c in ("equity", "cash", "positions_value", "pnl", "drawdown"))
    assert not shots
    assert sorted((r["run_id"], r["ts"], r["order_id"], r["symbol"], round(r["size"], 6), round(r["price"], 6), round(r["fee"], 6)) for r in got if r["kind"] == "fill") == sorted(fills)
    assert {(r["run_id"], r["ts"], r["symbol"], round(r["size"], 6)) for r in got if r["kind"] == "position"} == held


def test_dividends_are_paid_once_and_holdings_come_out(spark):
    b = bars(spark, [10, 11, 12, 13], volume=1e9)
    orders = spark.createDataFrame([("r", T0, 0, "SPY", "MARKET", 100.0)], "run_id string, ts timestamp_ntz, seq int, symbol string, order_type string, size double")
    paid = spark.createDataFrame([("SPY", "2020-01-03", 0.5)], "symbol string, date string, amount double").withColumn("date", F.to_date("date"))
    got = bt.run(b, orders, bt.Rules(capital=2000.0), positions=True, dividends=paid)
    assert [r.cash for r in bt.equity(got).orderBy("ts").collect()] == [1000, 1000, 1050, 1050]
    shots = bt.snapshots(got).orderBy("ts").collect()
    assert shots[0].positions == {"SPY": 100.0} and shots[3].prices == {"SPY": 13.0}
    assert [round(r.exposure, 6) for r in results.exposures(bt.snapshots(got)).orderBy("ts").collect()][0] == 0.5
    assert results.costs_over_time(bt.fills(got)).first().traded == 1000.0


# Own strategies


def test_own_strategy_over_all_symbols(spark):
    class Leader(custom.Strategy):
        """Holds the symbol with the highest close, and puts a stop under it."""

        def init(self):
            self.held = None

        def next(self, bars):
            best = max(bars, key=lambda s: bars[s]["close"])
            if best != self.held:
                if self.held:
                    self.order_target_percent(self.held, 0.0)
                self.order_target_percent(best, self.share)
                self.order_stop(best, -1, bars[best]["close"] * 0.5)
                self.held = best

    p = bars(spark, [1, 5, 2, 2], "A").unionByName(bars(spark, [2, 3, 4, 5], "B")).withColumn("run_id", F.lit("r"))
    p = p.unionByName(p.withColumn("run_id", F.lit("q")).where("symbol = 'A'"))
    got = [(r.run_id, r.ts.day, r.seq, r.symbol, r.order_type, r.target_percent) for r in custom.orders(p, Leader, share=0.5).orderBy("run_id", "ts", "seq").collect()]
    assert got[:2] == [("q", 1, 0, "A", "TARGET_PERCENT", 0.5), ("q", 1, 1, "A", "STOP", None)]
    assert [(d, s, k, t) for r, d, _, s, k, t in got if r == "r" and k != "STOP"] == [(1, "B", "TARGET_PERCENT", 0.5), (2, "B", "TARGET_PERCENT", 0.0), (2, "A", "TARGET_PERCENT", 0.5), (3, "A", "TARGET_PERCENT", 0.0), (3, "B", "TARGET_PERCENT", 0.5)]
    folded = bt.fills(bt.run(p.where("run_id = 'r'").drop("run_id"), custom.orders(p, Leader, share=0.5).where("run_id = 'r'")))
    assert folded.count() > 2
    with pytest.raises(Exception, match="lacks run_id"):
        custom.table_function(Leader, {})(p.drop("run_id").asTable()).collect()


# Events without symbol, files, streams


def test_events_without_symbol_in_and_between_parts(spark):
    rng = random.Random(12)
    b = [(rng.choice("AB"), T0 + timedelta(minutes=rng.randrange(20_000))) for _ in range(300)]
    e = [(T0 + timedelta(minutes=rng.randrange(20_000), seconds=rng.choice([0, 0, 7])), rng.choice([None, None, "A", "C"])) for _ in range(60)]
    rows, events = spark.createDataFrame(b, "symbol string, ts timestamp_ntz"), spark.createDataFrame([(t, "x", s) for t, s in e], "ts timestamp_ntz, type string, symbol string")
    for before, span in (("3 HOURS", timedelta(hours=3)), ("90 MINUTES", timedelta(minutes=90))):
        for now in (True, False):
            got = sorted((r.symbol, r.ts, r.has_event) for r in panel.has_event(rows, events, before, now).collect())
            want = sorted((s, t, any((x is None or x == s) and t - span <= u and (u <= t if now else u < t) for u, x in e)) for s, t in b)
            assert got == want


def test_folder_with_ends_in_capitals_and_bounds(spark, tmp_path):
    (tmp_path / "SPY_daily.CSV").write_text("﻿Date,Open,High,Low,Close,Volume\n" + "".join(f"2020-01-{d:02},1,2,0.5,1.5,10\n" for d in range(1, 21)))
    (tmp_path / "qqq.csv").write_text("close,open,high,low,vol,time\n2,1,3,1,5,2020-01-02\n")
    bars(spark, [1, 2]).drop("symbol").coalesce(1).write.parquet(str(tmp_path / "t"))
    part = next(p for p in (tmp_path / "t").iterdir() if p.name.startswith("part-"))
    part.rename(tmp_path / "IWM.Parquet")
    for p in (tmp_path / "t").iterdir():
        p.unlink()
    (tmp_path / "t").rmdir()
    got = readers.load_directory(spark, str(tmp_path))
    assert {r["symbol"]: r["n"] for r in got.groupBy("symbol").agg(F.count("*").alias("n")).collect()} == {"SPY": 20, "QQQ": 1, "IWM": 2}
    assert readers.load_directory(spark, str(tmp_path), symbols=["spy"], start="2020-01-05", end="2020-01-07").count() == 3
    assert readers.first_line(spark, str(tmp_path / "SPY_daily.CSV")) == "Date,Open,High,Low,Close,Volume"


def test_arrow_tables_as_bars(spark):
    table = pa.table({"Date": pa.array([T0, T0 + timedelta(days=1)]), **{c: [1.0, 2.0] for c in ("Open", "High", "Low", "Close")}})

    class Polars:
        def to_arrow(self):
            return table

    for given in (table, Polars()):
        assert [(r.symbol, r.close) for r in readers.from_arrow(spark, given, "spy").orderBy("ts").collect()] == [("SPY", 1.0), ("SPY", 2.0)]


def test_replay_goes_on_from_its_checkpoint(spark, tmp_path):
    p = bars(spark, range(1, 31)).unionByName(bars(spark, range(1, 29), "B", start=T0 + timedelta(days=2)))
    assert replay.prepare(p, f"file://{tmp_path}/data", 4) == 28
    run = lambda: replay.replay(spark, f"file://{tmp_path}/data", 10)
    first = streams.drain(run(), "append", base=f"file://{tmp_path}/run", at_once=False)
    assert first.count() == 56
    batches = sorted(os.listdir(tmp_path / "run/out"))
    assert batches == ["batch=0", "batch=1", "batch=2"]
    again = streams.drain(run(), "append", base=f"file://{tmp_path}/run", at_once=False)
    assert again.count() == 56 and sorted(os.listdir(tmp_path / "run/out")) == batches
    ordinals = [sorted({r.ordinal for r in spark.read.parquet(f"{tmp_path}/run/out/{b}").collect()}) for b in batches]
    assert ordinals == [list(range(10)), list(range(10, 20)), list(range(20, 28))]


def line_files(spark, tmp_path, closes, per):
    b = bars(spark, closes, volume=1e9)
    w = strategies.sma_crossover(b, fast=2, slow=4)
    lines = streams.as_text(bt.by_time(b.withColumn("run_id", F.col("symbol")), bt.target_orders(w.withColumn("run_id", F.col("symbol"))))).orderBy("ts").toPandas()
    want = [r.equity for r in bt.equity(bt.run(b.withColumn("run_id", F.col("symbol")), bt.target_orders(w.withColumn("run_id", F.col("symbol"))))).orderBy("ts").collect()]
    parts = [lines.iloc[i : i + per] for i in range(0, len(lines), per)]
    schema = "run_id string, ts timestamp, bars string, orders string"

    def put(k):
        rows = [(r.run_id, r.ts.to_pydatetime(), r.bars, r.orders if isinstance(r.orders, str) else None) for r in parts[k].itertuples()]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")

    stream = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    return put, stream, want, parts


def test_stream_backtest_starts_again_and_expires(spark, tmp_path):
    put, stream, want, parts = line_files(spark, tmp_path, walk(24, 13), 8)
    equity = lambda df: [r.equity for r in df.where("kind = 'equity'").orderBy("ts").collect()]
    for k in range(3):  # each a query of its own that goes on from the checkpoint
        put(k)
        got = equity(streams.drain(streams.backtest(stream()), "append", base=f"file://{tmp_path}/run"))
        assert got == pytest.approx(want[: 8 * (k + 1)])
    (tmp_path / "b").mkdir()
    put, stream, _, parts = line_files(spark, tmp_path / "b", walk(24, 13), 8)
    put(0)
    streams.drain(streams.backtest(stream(), ttl_ms=1000), "append", base=f"file://{tmp_path}/ttl", once=True)
    time.sleep(2)
    put(1)
    streams.drain(streams.backtest(stream(), ttl_ms=1000), "append", base=f"file://{tmp_path}/ttl", once=True)
    second = spark.read.parquet(f"{tmp_path}/ttl/out/batch=1").where("kind = 'equity'").orderBy("ts").collect()
    anew = bt.new_state(bt.Rules())
    shots = [bt.step(anew, {b["symbol"]: b for b in json.loads(r.bars)}, json.loads(r.orders) if isinstance(r.orders, str) else [], bt.Rules())[1]["equity"] for r in parts[1].itertuples()]
    assert [r.equity for r in second] == pytest.approx(shots)  # forgotten, so it began anew


# Risk, reports


def test_risk_model_is_checked_and_reported(spark):
    b = spark.createDataFrame([("A", "m", 1.0), ("B", "m", 0.5)], "symbol string, factor string, exposure double")
    fc, sp = spark.createDataFrame([("m", "m", 0.04)], "a string, b string, cov double"), spark.createDataFrame([("A", 0.1), ("B", 0.2)], "symbol string, specific_var double")
    assert risk.validate(b, fc, sp)
    w = spark.createDataFrame([("A", 0.5), ("B", 0.5)], "symbol string, weight double")
    parts = {r.symbol: r for r in risk.by_symbol(w, risk.total_covariance(b, fc, sp)).collect()}
    vol = (0.5**2 * 0.14 + 0.5**2 * 0.21 + 2 * 0.25 * 0.02) ** 0.5
    assert sum(r.component for r in parts.values()) == pytest.approx(vol) and parts["A"].marginal == pytest.approx((0.5 * 0.14 + 0.5 * 0.02) / vol)
    for bad in ((b.withColumn("factor", F.lit("x")), fc, sp), (b, fc, sp.where("symbol = 'A'")), (b.where("symbol = 'A'"), fc, sp)):
        with pytest.raises(ValueError):
            risk.validate(*bad)
    m = np.array([[0.04, 0.0], [0.0, 0.01]])
    assert risk.condition_number(m) == pytest.approx(4) and risk.is_psd(m) and not risk.is_psd(-m)


def test_report_sections(spark):
    e = spark.createDataFrame([(T0 + timedelta(days=i), v) for i, v in enumerate([100.0, 110.0, 105.0, 120.0])], "ts timestamp_ntz, equity double")
    t = spark.createDataFrame([("A", T0, T0 + timedelta(days=1), 10.0, 11.0, 5.0, 5.0, 0.1, 1.0, 0.5, 0.25)], "symbol string, entry_time timestamp_ntz, exit_time timestamp_ntz, entry_price double, exit_price double, size double, pnl double, pnl_pct double, duration double, fees double, slippage double")
    x = spark.createDataFrame([(T0 + timedelta(days=i), 2.0 * i + 1 + (i % 3) * 0.1, float(i)) for i in range(12)], "ts timestamp_ntz, y double, m double")
    text = report.markdown(e, t, regression=regress.attribution(x, "y", ["m"]))
    assert "## Turnover and costs" in text and "slippage_per_share | 0.05" in text and "## Factor regression" in text and "beta m" in text
    page = report.html(e, t)
    assert "Turnover and costs" in page and "<table" in page


# Queries that SQL does not express: the conditions of an optimum, from covariances computed apart


def by_year(name, spark):
    want = {}
    for r in _yearly_cov(spark, SF).collect():
        want.setdefault(r.ts, {})[r.a, r.b] = r.cov
    got = {}
    for r in catalog.queries()[name](spark, SF).collect():
        got.setdefault(r.ts, {})[r.symbol] = r.weight
    for ts, w in got.items():
        names = sorted(w)
        c = np.array([[want[ts][a, b] for b in names] for a in names], float)
        if np.linalg.eigvalsh(c).min() > 1e-9:  # the table's last year has too few days for a covariance
            yield ts, names, np.array([w[s] for s in names]), c
        else:
            assert sum(w.values()) == pytest.approx(1, abs=1e-5) or name == "target_vol_min_variance"


def feasible(n, high, rng, count=1500):
    for _ in range(count):
        yield alloc.project(rng.dirichlet(np.full(n, rng.choice([0.3, 1.0, 5.0]))), np.zeros(n), np.full(n, high))


@tables
def test_risk_parity_query_shares_the_risk(spark):
    seen = 0
    for _, names, w, c in by_year("risk_parity", spark):
        assert w.sum() == pytest.approx(1, abs=1e-5)
        assert np.allclose(w * (c @ w) / (w @ c @ w), 1 / len(w), atol=1e-4)
        seen += 1
    assert seen


@tables
def test_mean_variance_query_is_not_beaten(spark):
    returns = {}
    for r in catalog.portfolio._returns(spark, SF).where("r is not null").collect():
        returns.setdefault((datetime(r.ts.year, 1, 1), r.symbol), []).append(r.r)
    rng, seen = np.random.default_rng(14), 0
    for ts, names, w, c in by_year("mean_variance", spark):
        mu = np.array([252 * statistics.fmean(returns[ts, s]) for s in names])
        value = lambda w: (w @ mu) / max(alloc.deviation(w, c), 1e-12)  # noqa: E731, B023
        assert w.sum() == pytest.approx(1, abs=1e-5) and w.max() <= 0.5 + 1e-6 and w.min() >= -1e-9
        if value(w) > 0:
            assert value(w) >= max(map(value, feasible(len(w), 0.5, rng))) - 1e-3 * abs(value(w))
        seen += 1
    assert seen


@tables
def test_target_volatility_query_scales_the_least_variance(spark):
    rng, seen = np.random.default_rng(15), 0
    for _, names, w, c in by_year("target_vol_min_variance", spark):
        gross = np.abs(w).sum()
        vol = alloc.deviation(w, c)
        assert gross <= 1 + 1e-5 and (vol == pytest.approx(0.1, rel=1e-3) or gross == pytest.approx(1, abs=1e-5))
        one = w / gross
        assert one @ c @ one <= min(v @ c @ v for v in feasible(len(w), 1.0, rng)) + 1e-6 * abs(one @ c @ one) + 1e-9
        seen += 1
    assert seen


@tables
def test_factor_neutral_query_has_no_exposure(spark):
    b, fc, sp, _ = _model(spark, SF)
    c = {(r.a, r.b): r.cov for r in risk.total_covariance(b, fc, sp).collect()}
    m = {r.symbol: r.exposure for r in b.where("factor = 'm'").collect()}
    got = {r.symbol: r.weight for r in catalog.queries()["factor_neutral"](spark, SF).collect()}
    names = sorted(got)
    parity = alloc.risk_parity(np.array([[c[x, y] for y in names] for x in names]), np.zeros(len(names)), np.ones(len(names)))
    e = np.array([m[s] for s in names])
    want = parity - (parity @ e) / (e @ e) * e
    want = want / want.sum() if abs(want.sum()) > 1e-10 else want
    assert np.allclose([got[s] for s in names], want, atol=1e-5) and abs(np.array([got[s] for s in names]) @ e) < 1e-4
