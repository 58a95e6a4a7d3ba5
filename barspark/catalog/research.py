"""Sweeps, walk-forward, splits, bootstrap, and streams drained to tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..plans import backtest as bt
from ..plans import research as re_
from ..plans import strategies as st
from ..session import work_dir
from ..sources import replay
from ..sources.bars import bars_d, bars_h, bars_o
from ..streaming import streams
from . import R, query, r6
from .engine import LONG_FLAT

COMBOS = [{"fast": 2, "slow": 5}, {"fast": 3, "slow": 8}, {"fast": 4, "slow": 10}]


def _equity_sql(rows: str, key: str, combos: list[dict] = COMBOS) -> str:
    """SQL for the equity of each combination on rows (key, symbol, ts, close), partitioned by key and symbol, and how many symbols traded."""
    parts = []
    for k, c in enumerate(combos):
        w = lambda n: f"(PARTITION BY {key}, symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        parts.append(f"SELECT {k} AS combo, {key}, symbol, ts, close, avg(close) OVER {w(c['fast'])} AS f, avg(close) OVER {w(c['slow'])} AS s FROM {rows}")
    union = " UNION ALL ".join(parts)
    by = f"PARTITION BY combo, {key}, symbol ORDER BY ts"
    held = f"SELECT *, coalesce(last_value(CASE WHEN f > s THEN 1.0 WHEN f < s THEN 0.0 END IGNORE NULLS) OVER ({by}), 0)::DOUBLE AS w FROM ({union})"
    growth = f"SELECT *, 1 + coalesce(lag(w) OVER ({by}) * (close / lag(close) OVER ({by}) - 1), 0) AS g, (w > 0) <> (coalesce(lag(w) OVER ({by}), 0) > 0) AS went FROM ({held})"
    each = f"SELECT combo, {key}, symbol, ts, went, product(g) OVER ({by}) AS e FROM ({growth})"
    return f"SELECT combo, {key}, ts, avg(e) AS equity, sum(went::INT) AS trades FROM ({each}) GROUP BY ALL"


def _summary_sql(equity: str, key: str) -> str:
    by = f"PARTITION BY combo, {key} ORDER BY ts"
    return f"SELECT combo, {key}, arg_max(equity, ts) / arg_min(equity, ts) - 1 AS total_return, min(dd) AS max_drawdown, arg_max(equity, ts) AS final_equity, coalesce(CASE WHEN stddev_samp(r) > 0 THEN avg(r) / stddev_samp(r) * sqrt(252) END, 0) AS sharpe, count(*) AS bars, sum(trades)::BIGINT AS trades FROM (SELECT *, equity / max(equity) OVER ({by}) - 1 AS dd, equity / lag(equity) OVER ({by}) - 1 AS r FROM ({equity})) GROUP BY ALL"


_WHOLE = _summary_sql(_equity_sql("(SELECT 0 AS run_id, * FROM bars_d)", "run_id"), "run_id")


@query("parameter_sweep", f"SELECT combo, {R('total_return')} AS total_return, {R('max_drawdown')} AS max_drawdown, {R('sharpe')} AS sharpe FROM ({_WHOLE})")
def parameter_sweep(spark, sf_dir):
    s = re_.sweep(bars_d(spark, sf_dir), st.sma_crossover, COMBOS)
    return s.select("combo", r6("total_return", "total_return"), r6("max_drawdown", "max_drawdown"), r6("sharpe", "sharpe"))


@query("best_entry", f"SELECT combo, {R('sharpe')} AS sharpe FROM ({_WHOLE}) ORDER BY sharpe DESC, combo LIMIT 1")
def best_entry(spark, sf_dir):
    return re_.best(re_.sweep(bars_d(spark, sf_dir), st.sma_crossover, COMBOS)).select("combo", r6("sharpe", "sharpe"))


@query("multi_start", f"SELECT 3::BIGINT AS runs, {R('final_equity')} AS mean_final, {R('final_equity')} AS best_final FROM ({_WHOLE}) WHERE combo = 1")
def multi_start(spark, sf_dir):
    m = re_.multi_start(bars_d(spark, sf_dir), st.sma_crossover, 3, **COMBOS[1])
    return m.select("runs", r6("mean_final", "mean_final"), r6("best_final", "best_final"))


_CAL = "(SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i FROM (SELECT DISTINCT ts FROM bars_d))"
_WIN = f"(SELECT w AS win, CASE WHEN i - w * 5 < 12 THEN 'train' ELSE 'test' END AS phase, b.symbol, b.ts, b.close FROM bars_d b JOIN {_CAL} c USING (ts) JOIN range(0, 100) r(w) ON i >= w * 5 AND i < w * 5 + 17 AND w * 5 + 17 <= (SELECT count(*) FROM {_CAL}))"


def _walk():
    train = _summary_sql(_equity_sql(f"(SELECT * FROM {_WIN} WHERE phase = 'train')", "win"), "win")
    test = _equity_sql(f"(SELECT * FROM {_WIN} WHERE phase = 'test')", "win")
    best = f"(SELECT win, combo, sharpe FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY sharpe DESC, combo) AS n FROM ({train})) WHERE n = 1)"
    return best, test


_BEST, _TEST = _walk()


@query("walk_forward", f"SELECT win AS \"window\", b.combo, {R('b.sharpe')} AS metric_value, {R('t.total_return')} AS test_return, {R('t.max_drawdown')} AS test_max_drawdown FROM {_BEST} b JOIN ({_summary_sql(_TEST, 'win')}) t USING (win, combo)")
def walk_forward(spark, sf_dir):
    found, _ = re_.walk_forward(bars_d(spark, sf_dir), st.sma_crossover, COMBOS, 12, 5)
    return found.select("window", "combo", r6("metric_value", "metric_value"), r6("test_return", "test_return"), r6("test_max_drawdown", "test_max_drawdown"))


@query("oos_equity", f"SELECT win AS \"window\", ts, {R('equity')} AS equity FROM ({_TEST}) SEMI JOIN {_BEST} b USING (win, combo)")
def oos_equity(spark, sf_dir):
    _, e = re_.walk_forward(bars_d(spark, sf_dir), st.sma_crossover, COMBOS, 12, 5)
    return re_.chained_equity(e).select("window", "ts", r6("equity", "equity"))


@query("time_splits", f"SELECT fold, ts, CASE WHEN i < (fold + 1) * z THEN 'train' ELSE 'test' END AS phase FROM (SELECT ts, i, (SELECT count(*) FROM {_CAL}) // 5 AS z FROM {_CAL}), range(0, 4) r(fold) WHERE i < (fold + 2) * z".replace("SELECT fold,", "SELECT fold::INT AS fold,", 1))
def time_splits(spark, sf_dir):
    return re_.time_splits(bars_d(spark, sf_dir), 4)


@query("cv_penalties", f"""WITH s AS (SELECT symbol, avg(r) AS i, avg(r) FILTER (day(ts) > 15) AS o, count(r) AS n FROM rets_d GROUP BY symbol)
SELECT symbol, {R('greatest(i - o, 0) / 2 + 2 * ln(n) / (2 * n)')} AS overfit, {R('(SELECT 0.1 * stddev_pop(o) / abs(avg(o)) FROM s)')} AS stability FROM s""")
def cv_penalties(spark, sf_dir):
    from ..functions import factors as fx
    from ..functions.expr import compile

    r = compile(bars_d(spark, sf_dir), {"r": fx.returns()})
    s = r.groupBy("symbol").agg(F.avg("r").alias("i"), F.avg(F.when(F.day("ts") > 15, F.col("r"))).alias("o"), F.count("r").alias("n"))
    t = s.agg(re_.stability_penalty(F.col("o")).alias("stability"))
    return s.crossJoin(F.broadcast(t)).select("symbol", r6(re_.overfit_penalty(F.col("i"), F.col("o"), 2, F.col("n")), "overfit"), r6("stability", "stability"))


def _evaluate_sql(combos: list[dict], least: int, stability: bool, metric: str = "sharpe") -> str:
    """SQL of evaluate() on bars_o over three folds."""
    cal = "(SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i FROM (SELECT DISTINCT ts FROM bars_o))"
    size = f"(SELECT count(*) // 4 FROM {cal})"
    rows = f"(SELECT 2 * fold + (i >= (fold + 1) * {size})::INT AS k, symbol, ts, close FROM bars_o JOIN {cal} USING (ts), range(0, 3) r(fold) WHERE i < (fold + 2) * {size})"
    of = _summary_sql(_equity_sql(rows, "k", combos), "k")
    per = f"SELECT combo, k // 2 AS fold, max({metric}) FILTER (k % 2 = 0) AS i, max({metric}) FILTER (k % 2 = 1) AS o, max(bars) FILTER (k % 2 = 1) AS bars, max(trades) FILTER (k % 2 = 1) AS t FROM ({of}) GROUP BY ALL"
    means = f"SELECT combo, avg(i) FILTER (t >= {least}) AS i, avg(o) FILTER (t >= {least}) AS o, sum(bars) AS n, {f'coalesce(CASE WHEN count(o) FILTER (t >= {least}) >= 2 THEN 0.1 * stddev_pop(o) FILTER (t >= {least}) / abs(avg(o) FILTER (t >= {least})) END, 0)' if stability else '0.0'} AS stability, sum(t)::BIGINT AS trades, count(*) FILTER (t >= {least}) AS folds FROM ({per}) GROUP BY combo"
    return f"SELECT combo, i AS in_sample, o AS out_of_sample, greatest(i - o, 0) / 2 + 2 * ln(n) / (2 * n) AS overfit, stability, trades, folds FROM ({means})"


_E = "in_sample out_of_sample overfit stability score".split()
_SCORED = "(SELECT *, coalesce(out_of_sample - overfit - stability, '-inf'::DOUBLE) AS score FROM ({0}))"


@query("evaluate_candidates", f"SELECT combo, trades, folds, {', '.join(f'{R(c)} AS {c}' for c in _E)} FROM {_SCORED.format(_evaluate_sql(COMBOS, 0, True))}")
def evaluate_candidates(spark, sf_dir):
    e = re_.evaluate(bars_o(spark, sf_dir), st.sma_crossover, COMBOS, re_.Evaluation(folds=3))
    return e.select("combo", "trades", "folds", *[r6(c, c) for c in _E])


_SPACE = {"fast": [2, 5, 10], "slow": [20, 40]}
_GRID = [{"fast": f, "slow": s} for f in _SPACE["fast"] for s in _SPACE["slow"]]
_NAMED = "CASE combo " + " ".join(f"WHEN {k} THEN '{c['fast']}/{c['slow']}'" for k, c in enumerate(_GRID)) + " END"


@query("grid_search", f"SELECT combo, {_NAMED} AS parameters, trades, folds, {', '.join(f'{R(c)} AS {c}' for c in _E if c not in ('in_sample', 'stability'))} FROM {_SCORED.format(_evaluate_sql(_GRID, 200, False, 'total_return'))}")
def grid_search(spark, sf_dir):
    how = re_.Evaluation(name="total_return", folds=3, min_trades=200, stability=False)
    e = re_.grid_search(bars_o(spark, sf_dir), st.sma_crossover, re_.SearchSpace(_SPACE), how)
    return e.select("combo", F.concat_ws("/", "fast", "slow").alias("parameters"), "trades", "folds", *[r6(c, c) for c in _E if c not in ("in_sample", "stability")])


@query("bootstrap", f"""WITH r AS (SELECT row_number() OVER (ORDER BY ts) - 1 AS i, r FROM (SELECT ts, equity / lag(equity) OVER (ORDER BY ts) - 1 AS r FROM equity) WHERE r IS NOT NULL),
d AS (SELECT s.s AS sample, p.p AS position, floor(('0x' || substr(md5('3|' || s.s || '|' || p.p), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE * (SELECT count(*) FROM r))::BIGINT AS i FROM range(0, 200) s(s), range(0, (SELECT count(*) FROM r)) p(p)),
e AS (SELECT sample, position, product(1 + r) OVER (PARTITION BY sample ORDER BY position) AS e FROM d JOIN r USING (i))
SELECT sample, {R('arg_max(e, position) - 1')} AS total_return, {R('min(e / greatest(m, 1) - 1)')} AS max_drawdown FROM (SELECT *, max(e) OVER (PARTITION BY sample ORDER BY position) AS m FROM e) GROUP BY sample""")
def bootstrap(spark, sf_dir):
    e = bars_d(spark, sf_dir).groupBy("ts").agg(F.avg("close").alias("equity"))
    return re_.bootstrap(e, 200, seed=3).select("sample", r6("total_return", "total_return"), r6("max_drawdown", "max_drawdown"))


@query("parameter_grid", "SELECT fast, slow FROM (SELECT unnest([2, 3]) AS fast) CROSS JOIN (SELECT unnest([5, 8, 13]) AS slow)")
def parameter_grid(spark, sf_dir):
    return re_.grid_frame(spark, {"fast": [2, 3], "slow": [5, 8, 13]}).select(F.col("fast").cast("int"), F.col("slow").cast("int"))


# Streams.
@query("stream_bars", "SELECT symbol, ts, " + ", ".join(f"{R(c)} AS {c}" for c in ("open", "high", "low", "close", "volume")) + " FROM bars_d")
def stream_bars(spark, sf_dir):
    out = streams.drain(streams.bars(streams.ticks(spark, sf_dir), "1 day"), "complete")
    return out.select("symbol", "ts", *[r6(c, c) for c in ("open", "high", "low", "close", "volume")])


@query("stream_sliding", "SELECT symbol, w AS ts, count(*) AS n FROM (SELECT event_type AS symbol, unnest([time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '2000-01-01'), time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '2000-01-01') - INTERVAL 6 HOURS]) AS w FROM events) GROUP BY 1, 2")
def stream_sliding(spark, sf_dir):
    return streams.drain(streams.counts(streams.ticks(spark, sf_dir), "12 hours", "6 hours"), "complete")


@query("stream_sessions", """WITH t AS (SELECT user_id::VARCHAR AS symbol, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 3 HOURS THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY ts) AS k FROM t) SELECT symbol, min(ts) AS ts, count(*) AS n FROM s GROUP BY symbol, k""")
def stream_sessions(spark, sf_dir):
    return streams.drain(streams.sessions(streams.ticks(spark, sf_dir, "user_id"), "3 hours"), "complete")


@query("stream_ema", f"""WITH RECURSIVE n AS (SELECT event_type AS symbol, ts, value, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS i FROM events),
f(symbol, ts, i, y) AS (SELECT symbol, ts, i, value FROM n WHERE i = 1 UNION ALL SELECT n.symbol, n.ts, n.i, y + (n.value - y) * 2 / 21.0::DOUBLE FROM f JOIN n ON n.symbol = f.symbol AND n.i = f.i + 1)
SELECT symbol, ts, {R('y')} AS ema FROM f""")
def stream_ema(spark, sf_dir):
    return streams.drain(streams.ema(streams.ticks(spark, sf_dir), 20), "append").select("symbol", "ts", r6("ema", "ema"))


_TIMES = 7
_COMMON = "(SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i FROM (SELECT ts FROM bars_h GROUP BY ts HAVING count(*) = (SELECT count(DISTINCT symbol) FROM bars_h)))"


#: A batch's tasks at most, where a replay has a bounded number of batches.
_TASKS = 32


def _replayed(spark, panel, name: str, times: int, most_batches: int | None = None):
    """The panel as a stream of some times a batch; most_batches: a long calendar has more times in a batch, so that the fixed cost of a batch is not paid in proportion to the input."""
    folder = f"{work_dir(spark)}/barspark/replay-{uuid.uuid4().hex[:12]}"
    n = replay.prepare(panel, folder, times, most_batches and most_batches * _TASKS)
    return replay.replay(spark, folder, max(times, -(-n // most_batches)) if most_batches else times, name)


@query("stream_replay", f"SELECT symbol, ts, i AS ordinal, {R('close')} AS close FROM bars_h JOIN {_COMMON} USING (ts)")
def stream_replay(spark, sf_dir):
    stream = _replayed(spark, bars_h(spark, sf_dir).select("symbol", "ts", "close"), "bars", 50)
    return streams.drain(stream, "append", at_once=False).select("symbol", "ts", "ordinal", r6("close", "close"))


@query("stream_monitor", f"SELECT i // 40 AS batch, count(*) AS rows, {R('sum(close)')} AS total, min(symbol) AS first_symbol FROM bars_h JOIN {_COMMON} USING (ts) GROUP BY 1")
def stream_monitor(spark, sf_dir):
    stream = _replayed(spark, bars_h(spark, sf_dir).select("symbol", "ts", "close"), "watched", 40)
    stream = streams.watched(stream, "bars", total=F.sum("close"), first_symbol=F.min("symbol"))
    _, seen = streams.monitored_drain(stream, "append", "bars", at_once=False)
    return seen.select("batch", "rows", r6(F.col("metrics")["total"].cast("double"), "total"), F.col("metrics")["first_symbol"].alias("first_symbol"))


@query("stream_backtest", LONG_FLAT)
def stream_backtest(spark, sf_dir):
    """backtest_fold's runs, some days a batch, with account and positions in the state store between batches."""
    b = bars_d(spark, sf_dir).withColumn("volume", F.lit(1e12))
    orders = bt.target_orders(st.sma_crossover(b, fast=5, slow=10).withColumn("run_id", F.col("symbol")))
    lines = streams.as_text(bt.by_time(b.withColumn("run_id", F.col("symbol")), orders))
    stream = _replayed(spark, lines.select(F.col("run_id").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("ts"), "bars", "orders"), "lines", _TIMES)
    got = streams.drain(streams.backtest(stream.select(F.col("symbol").alias("run_id"), F.col("ts").cast("timestamp").alias("ts"), "bars", "orders")), "append", at_once=False)
    return got.where("kind = 'equity'").select(F.col("run_id").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("ts"), r6(F.col("equity") / 100_000, "growth"))


@query("stream_late", """WITH t AS (SELECT event_type AS symbol, time_bucket(INTERVAL 1 DAY, ts) AS ts FROM events)
SELECT symbol, ts, count(*) AS n FROM t WHERE ts + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 3 HOURS GROUP BY ALL""")
def stream_late(spark, sf_dir):
    """Daily counts in append mode: a window comes out once the watermark has passed its end, and those still open do not."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = _replayed(spark, e.select(F.lit("all").alias("symbol"), "ts", F.col("event_type").alias("kind")), "late", 2_000, most_batches=6)
    rows = stream.select(F.col("kind").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"))
    return streams.drain(streams.counts(rows, "1 day", "1 day", "3 hours"), "append", at_once=False)
