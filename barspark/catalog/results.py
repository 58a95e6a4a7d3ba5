"""Metrics of an equity curve, round trips and their groups, drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import results as rs
from ..sources.bars import bars_d
from ..session import spread, tasks_for
from . import R, query, r6

_DD = "SELECT ts, equity, equity / max(equity) OVER (ORDER BY ts) - 1 AS dd, equity / lag(equity) OVER (ORDER BY ts) - 1 AS r FROM equity"


def _equity(spark, sf_dir):
    return bars_d(spark, sf_dir).groupBy("ts").agg(F.avg("close").alias("equity"))


@query("equity_summary", f"""WITH e AS ({_DD})
SELECT {R('arg_max(equity, ts)')} AS final_equity, {R('arg_max(equity, ts) / arg_min(equity, ts) - 1')} AS total_return, {R('min(dd)')} AS max_drawdown, {R('avg(r) / stddev_samp(r) * sqrt(252)')} AS sharpe,
{R('(arg_max(equity, ts) / arg_min(equity, ts)) ^ (252.0 / count(*)) - 1')} AS cagr, {R('avg(r) / stddev_samp(r) FILTER (r < 0) * sqrt(252)')} AS sortino, count(*) AS bars FROM e""")
def equity_summary(spark, sf_dir):
    s = rs.summary(_equity(spark, sf_dir))
    return s.select(*[r6(c, c) for c in s.columns[:-1]], "bars")


@query("drawdown_curve", f"SELECT ts, {R('dd')} AS drawdown FROM ({_DD})")
def drawdown_curve(spark, sf_dir):
    return rs.drawdown(_equity(spark, sf_dir)).select("ts", r6("drawdown", "drawdown"))


_W5 = "(ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"


@query("rolling_metrics", f"""SELECT ts, CASE WHEN count(r) OVER w = 5 THEN {R('product(1 + r) OVER w - 1')} END AS rolling_return, CASE WHEN count(r) OVER w = 5 THEN {R('stddev_samp(r) OVER w * sqrt(252)')} END AS rolling_vol,
CASE WHEN count(r) OVER w = 5 THEN {R('avg(r) OVER w / stddev_samp(r) OVER w * sqrt(252)')} END AS rolling_sharpe, {R('equity / max(equity) OVER w - 1')} AS rolling_drawdown FROM ({_DD}) WINDOW w AS {_W5}""")
def rolling_metrics(spark, sf_dir):
    return rs.rolling(_equity(spark, sf_dir), 5).select("ts", *[r6(c, c) for c in ("rolling_return", "rolling_vol", "rolling_sharpe", "rolling_drawdown")])


@query("rolling_calendar", f"""SELECT ts, CASE WHEN count(r) OVER w > 0 THEN {R('product(1 + r) OVER w - 1')} END AS rolling_return, {R('stddev_samp(r) OVER w * sqrt(252.0 / 7 * 252)')} AS rolling_vol, {R('avg(r) OVER w / nullif(stddev_samp(r) OVER w, 0) * sqrt(252)')} AS rolling_sharpe, {R('equity / max(equity) OVER w - 1')} AS rolling_drawdown
FROM ({_DD}) WINDOW w AS (ORDER BY ts RANGE BETWEEN INTERVAL '6 days 23:59:59.999999' PRECEDING AND CURRENT ROW)""")
def rolling_calendar(spark, sf_dir):
    return rs.rolling_calendar(_equity(spark, sf_dir), 7).select("ts", *[r6(c, c) for c in ("rolling_return", "rolling_vol", "rolling_sharpe", "rolling_drawdown")])


# Fills: each user's events in turn buy and sell one unit lots; odd ones of a user open, even ones close.
_FILLS = "(SELECT event_id AS order_id, 'U' || user_id AS symbol, ts, value AS price, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) % 2 = 1 THEN 10.0 ELSE -10.0 END AS size FROM events)"
_ALT = f"(SELECT symbol, ts AS entry_time, price AS entry_price, abs(size)::DOUBLE AS size, row_number() OVER w AS n, lead(ts) OVER w AS exit_time, lead(price) OVER w AS exit_price FROM {_FILLS} WINDOW w AS (PARTITION BY symbol ORDER BY ts, order_id))"
_TRADES = f"(SELECT *, (exit_price - entry_price) * size AS pnl, exit_price / entry_price - 1 AS pnl_pct, (epoch_us(exit_time) - epoch_us(entry_time)) / 86400000000 AS duration FROM {_ALT} WHERE n % 2 = 1 AND exit_time IS NOT NULL)"


def _fills(spark, sf_dir):
    from pyspark.sql import Window as W

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    tasks = tasks_for(e.count())
    f = e.select(F.col("event_id").alias("order_id"), F.concat(F.lit("U"), F.col("user_id")).alias("symbol"), "ts", F.col("value").alias("price"))
    n = F.row_number().over(W.partitionBy("symbol").orderBy(*rs.fill_order()))  # the order that trades are matched in, so one sort serves both
    return spread(f, ["symbol"], tasks).withColumn("size", F.when(n % 2 == 1, F.lit(10.0)).otherwise(F.lit(-10.0)))


def _trades(spark, sf_dir):
    return rs.fifo_trades(_fills(spark, sf_dir)).where("exit_time is not null")


@query("trades_fifo", f"SELECT symbol, entry_time, exit_time, {R('entry_price')} AS entry_price, {R('exit_price')} AS exit_price, size, {R('pnl')} AS pnl, {R('pnl_pct')} AS pnl_pct, {R('duration')} AS duration, 'long' AS direction FROM {_TRADES}")
def trades_fifo(spark, sf_dir):
    return _trades(spark, sf_dir).select("symbol", "entry_time", "exit_time", r6("entry_price", "entry_price"), r6("exit_price", "exit_price"), "size", r6("pnl", "pnl"), r6("pnl_pct", "pnl_pct"), r6("duration", "duration"), "direction")


@query("trades_alternating", f"SELECT symbol, entry_time, exit_time, {R('entry_price')} AS entry_price, {R('exit_price')} AS exit_price, size, {R('pnl')} AS pnl FROM {_TRADES}")
def trades_alternating(spark, sf_dir):
    return rs.alternating_trades(_fills(spark, sf_dir)).select("symbol", "entry_time", "exit_time", r6("entry_price", "entry_price"), r6("exit_price", "exit_price"), "size", r6("pnl", "pnl"))


_GROUP = f"count(*) AS trades, {R('sum(pnl)')} AS total_pnl, {R('avg(pnl)')} AS avg_pnl, {R('avg((pnl > 0)::INT)')} AS win_rate, {R('avg(pnl_pct)')} AS avg_pnl_pct, {R('avg(duration)')} AS avg_duration"


def _grouped(df, key):
    return df.select(key, "trades", *[r6(c, c) for c in ("total_pnl", "avg_pnl", "win_rate", "avg_pnl_pct", "avg_duration")])


@query("trades_by_symbol", f"SELECT symbol, {_GROUP} FROM {_TRADES} GROUP BY symbol")
def trades_by_symbol(spark, sf_dir):
    return _grouped(rs.by_symbol(_trades(spark, sf_dir)), "symbol")


@query("trades_by_month", f"SELECT date_trunc('month', entry_time)::TIMESTAMP AS month, {_GROUP} FROM {_TRADES} GROUP BY 1")
def trades_by_month(spark, sf_dir):
    return _grouped(rs.by_month(_trades(spark, sf_dir)), "month")


@query("trade_summary", f"""WITH t AS (SELECT * FROM {_TRADES}), o AS (SELECT *, pnl > 0 AS win FROM t WHERE pnl <> 0),
i AS (SELECT win, row_number() OVER (ORDER BY exit_time, entry_time, symbol, pnl) - row_number() OVER (PARTITION BY win ORDER BY exit_time, entry_time, symbol, pnl) AS k FROM o), g AS (SELECT win, count(*) AS n FROM i GROUP BY win, k),
s AS (SELECT count(*) AS trades, avg((pnl > 0)::INT) AS win_rate, coalesce(avg(pnl) FILTER (pnl > 0), 0) AS avg_win, coalesce(avg(pnl) FILTER (pnl < 0), 0) AS avg_loss, quantile_cont(duration, 0.5) AS median_duration FROM t)
SELECT trades, {R('win_rate')} AS win_rate, {R('avg_win')} AS avg_win, {R('avg_loss')} AS avg_loss, {R('win_rate * avg_win + (1 - win_rate) * avg_loss')} AS expectancy, {R('median_duration')} AS median_duration, (SELECT coalesce(max(n), 0) FROM g WHERE win) AS max_wins, (SELECT coalesce(max(n), 0) FROM g WHERE NOT win) AS max_losses FROM s""")
def trade_summary(spark, sf_dir):
    s = rs.trade_summary(_trades(spark, sf_dir))
    return s.select("trades", *[r6(c, c) for c in ("win_rate", "avg_win", "avg_loss", "expectancy", "median_duration")], "max_wins", "max_losses")


@query("trade_distribution", f"SELECT quantile::DOUBLE AS quantile, {R('value')} AS value FROM (SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9]) AS quantile, unnest(quantile_cont(pnl, [0.1, 0.25, 0.5, 0.75, 0.9])) AS value FROM {_TRADES})")
def trade_distribution(spark, sf_dir):
    return rs.trade_distribution(_trades(spark, sf_dir)).select("quantile", r6("value", "value"))


@query("size_turnover", f"SELECT period, {R('coalesce(turnover, 0)')} AS turnover FROM (SELECT unnest(generate_series(min(p), max(p), INTERVAL 1 DAY)) AS period FROM (SELECT date_trunc('day', entry_time)::TIMESTAMP AS p FROM {_TRADES})) LEFT JOIN (SELECT date_trunc('day', entry_time)::TIMESTAMP AS period, sum(abs(size)) * 0.5 AS turnover FROM {_TRADES} GROUP BY 1) USING (period)")
def size_turnover(spark, sf_dir):
    return rs.size_turnover(_trades(spark, sf_dir), "day").select("period", r6("turnover", "turnover"))


@query("trade_costs", f"SELECT {R('sum(size * 0.02) / sum(abs(size))')} AS slippage_per_share, {R('sum(size * 0.02 + size * exit_price * 0.001) / (sum(abs(size)) * 0.5)')} AS cost_per_turnover FROM {_TRADES}")
def trade_costs(spark, sf_dir):
    t = _trades(spark, sf_dir).withColumns({"slippage": F.col("size") * 0.02, "fees": F.col("size") * F.col("exit_price") * 0.001})
    return rs.costs(t).select(r6("slippage_per_share", "slippage_per_share"), r6("cost_per_turnover", "cost_per_turnover"))


@query("cumulative_curves", f"SELECT symbol, entry_time, exit_time, {R('sum(pnl) OVER (ORDER BY exit_time, symbol, entry_time ROWS UNBOUNDED PRECEDING)')} AS cum_pnl FROM {_TRADES}")
def cumulative_curves(spark, sf_dir):
    return rs.cumulative(_trades(spark, sf_dir)).select("symbol", "entry_time", "exit_time", r6("cum_pnl", "cum_pnl"))


_EXPOSURE = "(SELECT ts, symbol, volume * close / sum(close * 2) OVER (PARTITION BY ts) AS exposure FROM bars_d)"


def _snapshots(spark, sf_dir):
    b = bars_d(spark, sf_dir)
    entry = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("symbol", c))))
    return b.groupBy("ts").agg(F.sum(F.col("close") * 2).alias("equity"), entry("volume").alias("positions"), entry("close").alias("prices"))


@query("exposures", f"SELECT ts, symbol, {R('exposure')} AS exposure FROM {_EXPOSURE}")
def exposures(spark, sf_dir):
    return rs.exposures(_snapshots(spark, sf_dir)).select("ts", "symbol", r6("exposure", "exposure"))


@query("weight_turnover", f"SELECT ts, {R('sum(d) * 0.5')} AS turnover FROM (SELECT ts, abs(exposure - coalesce(lag(exposure) OVER (PARTITION BY symbol ORDER BY ts), exposure)) AS d FROM {_EXPOSURE}) GROUP BY ts")
def weight_turnover(spark, sf_dir):
    return rs.weight_turnover(rs.exposures(_snapshots(spark, sf_dir))).select("ts", r6("turnover", "turnover"))


@query("drift", f"SELECT l.ts, {R('coalesce((l.equity - b.equity) / nullif(b.equity, 0), 0)')} AS drift FROM (SELECT date_trunc('hour', ts)::TIMESTAMP AS ts, avg(value) AS equity FROM events WHERE ts >= TIMESTAMP '2024-01-02' GROUP BY 1) l ASOF LEFT JOIN equity b ON l.ts >= b.ts")
def drift(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("ts >= TIMESTAMP_NTZ '2024-01-02'")
    live = e.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.avg("value").alias("equity"))
    return rs.drift(live, _equity(spark, sf_dir)).select("ts", r6("drift", "drift"))
