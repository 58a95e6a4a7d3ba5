"""Factors, transforms, indicators, filters and signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import factors as fx
from ..functions.expr import col, compile, compile_long, lit, rolling
from ..operators import filters as fl
from ..operators import panel as pn
from ..operators import recursive, signals
from ..operators.prefix import numbered
from ..plans.pipeline import Pipeline
from ..session import tasks_for
from ..sources.bars import bars_d, bars_h, bars_o, bars_s
from . import R, query, r6

BY = "PARTITION BY symbol ORDER BY ts"


def _w(n: int) -> str:
    return f"({BY} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _factor(name: str, expr, sql: str, panel=bars_h, table: str = "bars_h"):
    """Registers a factor; sql is the expression over the panel (or a full query if it selects)."""
    full = sql if sql.lstrip().upper().startswith(("SELECT", "WITH")) else f"SELECT symbol, ts, {R(sql)} AS value FROM {table}"

    @query(name, full)
    def run(spark, sf_dir):
        return compile(panel(spark, sf_dir), {"value": expr}).select("symbol", "ts", r6("value", "value"))


_factor("field_select", col("close"), "close")
_factor("pct_change", fx.returns(1), f"close / lag(close) OVER ({BY}) - 1")
_factor("momentum", fx.momentum(63), f"close / lag(close, 63) OVER ({BY}) - 1")
_factor("time_series_momentum", fx.time_series_momentum(252), f"close / lag(close, 252) OVER ({BY}) - 1", bars_o, "bars_o")
_factor("cross_sectional_momentum", fx.cross_sectional_momentum(63), f"close / lag(close, 63) OVER ({BY}) - 1", bars_o, "bars_o")
_factor("roc", fx.roc(10), f"100 * (close / lag(close, 10) OVER ({BY}) - 1)")
_factor("lag", fx.lag(col("close"), 3), f"lag(close, 3) OVER ({BY})")
_factor("diff", col("close") - fx.lag(col("close")), f"close - lag(close) OVER ({BY})")
_factor("sma", fx.sma(20), f"avg(close) OVER {_w(20)}")
_factor("sma_ratio", fx.sma_ratio(50), f"close / avg(close) OVER {_w(50)}")
_factor("volatility", fx.volatility(63), f"SELECT symbol, ts, {R(f'stddev_samp(r) OVER {_w(63)} * sqrt(252)')} AS value FROM rets_h")
_factor("low_volatility", fx.low_volatility(63), f"SELECT symbol, ts, {R(f'-stddev_samp(r) OVER {_w(63)} * sqrt(252)')} AS value FROM rets_h")
_TR = f"greatest(high - low, abs(high - lag(close) OVER ({BY})), abs(low - lag(close) OVER ({BY})))"
_factor("true_range", fx.true_range(), _TR)
_factor("atr", fx.atr(14), f"SELECT symbol, ts, {R(f'avg(tr) OVER {_w(14)}')} AS value FROM (SELECT *, {_TR} AS tr FROM bars_h)")
_factor("atr_vol", fx.atr_volatility(14), f"SELECT symbol, ts, {R(f'avg(tr) OVER {_w(14)} / close * sqrt(252)')} AS value FROM (SELECT *, {_TR} AS tr FROM bars_h)")
_GK = "0.5 * ln(high / low) ^ 2 - (2 * ln(2) - 1) * ln(close / open) ^ 2"
_factor("garman_klass", fx.garman_klass(63), f"SELECT symbol, ts, {R('CASE WHEN m >= 0 THEN sqrt(m) * sqrt(252) END')} AS value FROM (SELECT *, avg({_GK}) OVER {_w(63)} AS m FROM bars_h)")
_factor("parkinson", fx.parkinson(63), f"sqrt(avg(ln(high / low) ^ 2 / (4 * ln(2))) OVER {_w(63)}) * sqrt(252)")
_factor("return_skew", fx.return_skew(63), f"SELECT symbol, ts, {R('CASE WHEN n >= 3 THEN CASE WHEN sd = 0 THEN 0 ELSE s END END')} AS value FROM (SELECT symbol, ts, count(r) OVER w AS n, stddev_pop(r) OVER w AS sd, skewness(r) OVER w AS s FROM rets_h WINDOW w AS {_w(63)})")
_factor("return_kurtosis", fx.return_kurtosis(63), f"SELECT symbol, ts, {R('CASE WHEN n >= 4 THEN CASE WHEN sd = 0 THEN -3 ELSE s END END')} AS value FROM (SELECT symbol, ts, count(r) OVER w AS n, stddev_pop(r) OVER w AS sd, kurtosis(r) OVER w AS s FROM rets_h WINDOW w AS {_w(63)})")
_ROWS = f"(SELECT *, ln(close) AS y, row_number() OVER ({BY})::DOUBLE AS x FROM bars_h)"
_factor("trend_slope", fx.trend_slope(63), f"SELECT symbol, ts, {R('CASE WHEN n >= 2 THEN b END')} AS value FROM (SELECT symbol, ts, count(y) OVER w AS n, regr_slope(y, x) OVER w AS b FROM {_ROWS} WINDOW w AS {_w(63)})")
_factor("trend_strength", fx.trend_strength(63), f"SELECT symbol, ts, {R('CASE WHEN n >= 2 THEN CASE WHEN s = 0 THEN 0 ELSE b END END')} AS value FROM (SELECT symbol, ts, count(y) OVER w AS n, regr_r2(y, x) OVER w AS b, var_pop(y) OVER w AS s FROM {_ROWS} WINDOW w AS {_w(63)})")
_PAIR = "SELECT a.symbol, a.ts, CASE WHEN b.r IS NOT NULL THEN a.r END AS y, CASE WHEN a.r IS NOT NULL THEN b.r END AS x FROM rets_o a LEFT JOIN (SELECT ts, r FROM rets_o WHERE symbol = '1-URGENT') b USING (ts)"
_factor("beta", fx.beta(63, "1-URGENT"), f"SELECT symbol, ts, {R('''CASE WHEN symbol = '1-URGENT' THEN 1 WHEN n >= 2 AND k >= 63 THEN c / nullif(v, 0) END''')} AS value FROM (SELECT symbol, ts, count(y) OVER w AS n, count(y) OVER (PARTITION BY symbol) AS k, covar_samp(y, x) OVER w AS c, var_samp(x) OVER w AS v FROM ({_PAIR}) WINDOW w AS {_w(63)})", bars_o, "bars_o")
_factor("idio_vol", fx.idiosyncratic_volatility(63, "1-URGENT"), f"SELECT symbol, ts, {R('''CASE WHEN symbol = '1-URGENT' THEN 0 WHEN n >= 2 AND k >= 63 THEN sqrt(greatest(0, vy - 2 * (c / nullif(vx, 0)) * cp + (c / nullif(vx, 0)) ^ 2 * vx)) * sqrt(252) END''')} AS value FROM (SELECT symbol, ts, count(y) OVER w AS n, count(y) OVER (PARTITION BY symbol) AS k, covar_samp(y, x) OVER w AS c, covar_pop(y, x) OVER w AS cp, var_pop(x) OVER w AS vx, var_pop(y) OVER w AS vy FROM ({_PAIR}) WINDOW w AS {_w(63)})", bars_o, "bars_o")
_factor("dollar_volume", fx.dollar_volume(7), f"avg(close * volume) OVER {_w(7)}", bars_s, "bars_s")
_factor("turnover", fx.turnover(20), f"avg(volume) OVER {_w(20)}", bars_s, "bars_s")
_factor("log_market_cap", fx.log_market_cap(), "ln(nullif(close * volume, 0))", bars_s, "bars_s")
_D = f"(SELECT *, close - lag(close) OVER ({BY}) AS d FROM bars_h)"
_factor("rsi", fx.rsi(14), f"SELECT symbol, ts, {R('CASE WHEN l = 0 THEN 0 ELSE 100 - 100 / (1 + g / l) END')} AS value FROM (SELECT symbol, ts, avg(CASE WHEN d > 0 THEN d ELSE 0 END) OVER w AS g, avg(CASE WHEN d < 0 THEN -d ELSE 0 END) OVER w AS l FROM {_D} WINDOW w AS {_w(14)})")
_factor("stochastic_k", fx.stochastic_k(14), f"coalesce(100 * (close - min(low) OVER {_w(14)}) / nullif(max(high) OVER {_w(14)} - min(low) OVER {_w(14)}, 0), 50)")
_factor("williams_r", fx.williams_r(14), f"coalesce(-100 * (max(high) OVER {_w(14)} - close) / nullif(max(high) OVER {_w(14)} - min(low) OVER {_w(14)}, 0), -50)")
_factor("bollinger_z", fx.bollinger_z(20), f"coalesce((close - avg(close) OVER {_w(20)}) / nullif(2 * stddev_samp(close) OVER {_w(20)}, 0), 0)")
_factor("typical_price", fx.typical_price(), "(high + low + close) / 3")
_factor("cci", fx.cci(20), f"SELECT symbol, ts, {R('coalesce((tp - m) / nullif(0.015 * list_avg([abs(v - m) FOR v IN l]), 0), 0)')} AS value FROM (SELECT symbol, ts, tp, avg(tp) OVER w AS m, list(tp) OVER w AS l FROM (SELECT *, (high + low + close) / 3 AS tp FROM bars_h) WINDOW w AS {_w(20)})")

# Expressions of factors.
_factor("expr_arithmetic", (col("close") - col("open")) / col("open") * 100 + 2.0 - 1.0 / col("close"), "(close - open) / open * 100 + 2 - 1 / close")
_factor("expr_factor_minus_factor", fx.roc(10) - fx.volatility(20), f"SELECT symbol, ts, {R(f'100 * (close / lag(close, 10) OVER ({BY}) - 1) - stddev_samp(r) OVER {_w(20)} * sqrt(252)')} AS value FROM rets_h")
_factor("expr_negate", -fx.returns(1), f"-(close / lag(close) OVER ({BY}) - 1)")
_factor("expr_compare", (fx.returns(1) > 0.0) + (fx.returns(1) <= 0.0) * 2.0, f"CASE WHEN close / lag(close) OVER ({BY}) - 1 > 0 THEN 1 ELSE 0 END + CASE WHEN close / lag(close) OVER ({BY}) - 1 <= 0 THEN 2 ELSE 0 END")
_RANK = "CASE WHEN r IS NOT NULL THEN rank() OVER (PARTITION BY ts ORDER BY r {0} NULLS LAST) + (count(*) OVER (PARTITION BY ts, r) - 1) / 2.0 END"
_factor("rank", fx.returns(1).rank(), f"SELECT symbol, ts, {R(_RANK.format('DESC'))} AS value FROM rets_h")
_factor("percentile_rank", fx.returns(1).percentile(), f"SELECT symbol, ts, {R(f'({_RANK.format(chr(65) + chr(83) + chr(67))}) / count(r) OVER (PARTITION BY ts) * 100')} AS value FROM rets_h")
_factor("zscore_cross_section", fx.returns(1).zscore(), f"SELECT symbol, ts, {R('(r - avg(r) OVER (PARTITION BY ts)) / nullif(stddev_samp(r) OVER (PARTITION BY ts), 0)')} AS value FROM rets_h")
_GRID = "(SELECT t.ts, s.symbol, b.r FROM (SELECT DISTINCT ts FROM bars_h) t CROSS JOIN (SELECT DISTINCT symbol FROM bars_h) s LEFT JOIN rets_h b ON b.ts = t.ts AND b.symbol = s.symbol)"
_factor("rolling_zscore", fx.returns(1).zscore(20), f"SELECT symbol, ts, {R(f'(r - avg(r) OVER {_w(20)}) / nullif(stddev_samp(r) OVER {_w(20)}, 0)')} AS value FROM {_GRID}")
_factor("rolling_mean", fx.returns(1).rolling_mean(10), f"SELECT symbol, ts, {R(f'avg(r) OVER {_w(10)}')} AS value FROM {_GRID}")
_factor("rolling_std", fx.returns(1).rolling_std(10), f"SELECT symbol, ts, {R(f'stddev_samp(r) OVER {_w(10)}')} AS value FROM {_GRID}")
_factor("delay", fx.returns(1).delay(2), f"SELECT symbol, ts, {R(f'lag(r, 2) OVER ({BY})')} AS value FROM {_GRID}")
_factor("winsorize", fx.returns(1).winsorize(0.05, 0.95), f"SELECT symbol, ts, {R('CASE WHEN r IS NOT NULL THEN least(greatest(r, quantile_cont(r, 0.05) OVER (PARTITION BY symbol)), quantile_cont(r, 0.95) OVER (PARTITION BY symbol)) END')} AS value FROM rets_h")
_factor("normalize_minmax", col("close").normalize("minmax"), "coalesce((close - min(close) OVER (PARTITION BY symbol)) / nullif(max(close) OVER (PARTITION BY symbol) - min(close) OVER (PARTITION BY symbol), 0), 0)")
_factor("normalize_zscore", col("close").normalize("zscore"), "coalesce((close - avg(close) OVER (PARTITION BY symbol)) / nullif(stddev_samp(close) OVER (PARTITION BY symbol), 0), 0)")

# The same frames over ticks (one bar a tick), narrow ones sliding and wide ones put together from two halves.
_TICKS = "(SELECT event_type AS symbol, ts, value AS close, ln(value + 1) AS y, row_number() OVER (PARTITION BY event_type ORDER BY ts)::DOUBLE AS x FROM events)"


def _frames(name: str, n: int) -> None:
    close, y, x = col("close"), col("y"), col("x")
    parts = {
        "mean": (rolling("avg", n, y), "avg(y) OVER w"),
        "deviation": (rolling("stddev_samp", n, close), "stddev_samp(close) OVER w"),
        "least": (rolling("min", n, close), "min(close) OVER w"),
        "most": (rolling("max", n, close), "max(close) OVER w"),
        "slope": (rolling("regr_slope", n, y, x), "regr_slope(y, x) OVER w"),
        "fit": (rolling("regr_r2", n, y, x), "regr_r2(y, x) OVER w"),
    }

    @query(name, f"SELECT symbol, ts, {', '.join(f'{R(s)} AS {k}' for k, (_, s) in parts.items())} FROM {_TICKS} WINDOW w AS {_w(n)}")
    def run(spark, sf_dir):
        events = spark.read.parquet(f"{sf_dir}/events.parquet")
        ticks = numbered(events.select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("close")), "symbol", "ts", "x")
        ticks = ticks.withColumn("y", F.ln(F.col("close") + 1))
        return compile_long(ticks, {k: e for k, (e, _) in parts.items()}, "x", n, tasks_for(events.count())).select("symbol", "ts", *[r6(k, k) for k in parts])


_frames("rolling_narrow", 10)
_frames("rolling_wide", 1000)


# Recursive averages: DuckDB folds the rows by a recursive query.
def _fold(columns: str, first: str, then: str, out: str) -> str:
    return f"""WITH RECURSIVE n AS (SELECT symbol, ts, close, row_number() OVER ({BY}) AS i FROM bars_h),
f({columns}) AS (SELECT symbol, ts, i, {first} FROM n WHERE i = 1 UNION ALL SELECT n.symbol, n.ts, n.i, {then} FROM f JOIN n ON n.symbol = f.symbol AND n.i = f.i + 1)
SELECT symbol, ts, {R(out)} AS value FROM f"""


@query("ema", _fold("symbol, ts, i, y", "close", "y + (n.close - y) * 2 / 21.0::DOUBLE", "y"))
def ema(spark, sf_dir):
    return recursive.ema(bars_h(spark, sf_dir).select("symbol", "ts", "close"), 20).select("symbol", "ts", r6("ema", "value"))


_MACD_THEN = "a + (n.close - a) * 2 / 13.0::DOUBLE, b + (n.close - b) * 2 / 27.0::DOUBLE, s + ((a + (n.close - a) * 2 / 13.0::DOUBLE) - (b + (n.close - b) * 2 / 27.0::DOUBLE) - s) * 0.2::DOUBLE"


@query("macd", _fold("symbol, ts, i, a, b, s", "close, close, 0.0::DOUBLE", _MACD_THEN, "s"))
def macd(spark, sf_dir):
    return recursive.macd(bars_h(spark, sf_dir).select("symbol", "ts", "close")).select("symbol", "ts", r6("macd", "value"))


# Filters.
def _filter(name: str, make, sql: str, panel=bars_s, table="bars_s"):
    @query(name, f"SELECT symbol, ts, {sql} AS kept FROM {table}" if not sql.startswith(("SELECT", "WITH")) else sql)
    def run(spark, sf_dir):
        return Pipeline({}, {}, make()).run(panel(spark, sf_dir)).select("symbol", "ts", F.col("screen").alias("kept"))


_filter("top_n", lambda: fl.TopN(col("close"), 5), "row_number() OVER (PARTITION BY ts ORDER BY close DESC, symbol) <= 5")
_filter("bottom_n", lambda: fl.bottom_n(col("close"), 5), "row_number() OVER (PARTITION BY ts ORDER BY close, symbol) <= 5")
_filter("percentile_top", lambda: fl.Percentile(col("close"), top=20), "close >= quantile_cont(close, 0.8) OVER (PARTITION BY ts)")
_filter("percentile_bottom", lambda: fl.Percentile(col("close"), bottom=30, ascending=True), "close <= quantile_cont(close, 0.3) OVER (PARTITION BY ts)")
_DV = f"(SELECT *, avg(close * volume) OVER {_w(20)} AS dv FROM bars_s)"
_filter("liquidity_filter", lambda: fl.liquidity(top_n=10), f"SELECT symbol, ts, row_number() OVER (PARTITION BY ts ORDER BY dv DESC, symbol) <= 10 AS kept FROM {_DV}")
_filter("liquidity_min", lambda: fl.liquidity(least=40000.0), f"SELECT symbol, ts, dv >= 40000 AS kept FROM {_DV}")
_VOL = f"(SELECT symbol, ts, stddev_samp(r) OVER {_w(63)} * sqrt(252) AS v FROM rets_h)"
_filter("volatility_filter", lambda: fl.low_volatility(percentile=50), f"SELECT symbol, ts, coalesce(v <= quantile_cont(v, 0.5) OVER (PARTITION BY ts), false) AS kept FROM {_VOL}", bars_h)
_filter("filter_and_or_not", lambda: (fl.TopN(col("close"), 20) & fl.TopN(col("volume"), 20)) | ~fl.Compare(col("close"), least=1000.0), "(row_number() OVER (PARTITION BY ts ORDER BY close DESC, symbol) <= 20 AND row_number() OVER (PARTITION BY ts ORDER BY volume DESC, symbol) <= 20) OR NOT close >= 1000")


@query("pipeline_screen", f"SELECT symbol, ts, {R('mom')} AS mom, {R('vol')} AS vol, liquid, coalesce(liquid AND row_number() OVER (PARTITION BY ts ORDER BY mom DESC NULLS LAST, symbol) <= 3 AND mom IS NOT NULL, false) AS screen FROM (SELECT symbol, ts, close / lag(close, 10) OVER ({BY}) - 1 AS mom, stddev_samp(r) OVER {_w(20)} * sqrt(252) AS vol, row_number() OVER (PARTITION BY ts ORDER BY dv DESC, symbol) <= 4 AS liquid FROM (SELECT rets_h.*, avg(bars_h.close * volume) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS dv FROM rets_h JOIN bars_h USING (symbol, ts)))".replace("avg(bars_h.close", "avg(rets_h.close"))
def pipeline_screen(spark, sf_dir):
    p = Pipeline({"mom": fx.momentum(10), "vol": fx.volatility(20)}, {"liquid": fl.liquidity(top_n=4)}, fl.Both("liquid", fl.TopN("mom", 3)))
    return p.run(bars_h(spark, sf_dir)).select("symbol", "ts", r6("mom", "mom"), r6("vol", "vol"), "liquid", "screen")


@query("time_slice", f"SELECT symbol, ts, {R('close')} AS close FROM bars_h WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-10 12:00:00'")
def time_slice(spark, sf_dir):
    return pn.time_slice(bars_h(spark, sf_dir), "2024-01-05", "2024-01-10 12:00:00").select("symbol", "ts", r6("close", "close"))


# Signals.
_SMAS = f"(SELECT *, avg(close) OVER {_w(5)} AS a, avg(close) OVER {_w(20)} AS b FROM bars_h)"


def _averages(spark, sf_dir):
    return compile(bars_h(spark, sf_dir), {"close": col("close"), "a": fx.sma(5), "b": fx.sma(20)})


@query("cross_over", f"SELECT symbol, ts, coalesce(lag(a) OVER ({BY}) < lag(b) OVER ({BY}) AND a > b, false) AS cross_over, coalesce(lag(a) OVER ({BY}) > lag(b) OVER ({BY}) AND a < b, false) AS cross_under FROM {_SMAS}")
def cross_over(spark, sf_dir):
    df = signals.cross_under(signals.cross_over(_averages(spark, sf_dir), "a", "b"), "a", "b")
    return df.select("symbol", "ts", "cross_over", "cross_under")


@query("greater_less", f"SELECT symbol, ts, coalesce(close > b, false) AS above, coalesce(close < 100, false) AS below FROM {_SMAS}")
def greater_less(spark, sf_dir):
    return _averages(spark, sf_dir).select("symbol", "ts", signals.greater_than(F.col("close"), F.col("b")).alias("above"), signals.less_than(F.col("close"), 100).alias("below"))


@query("condition_streak", f"SELECT symbol, ts, CASE WHEN ok THEN sum(ok::INT) OVER (PARTITION BY symbol, island ORDER BY ts) ELSE 0 END::BIGINT AS streak FROM (SELECT symbol, ts, ok, sum((NOT ok)::INT) OVER ({BY}) AS island FROM (SELECT symbol, ts, close > b AS ok FROM {_SMAS}))")
def condition_streak(spark, sf_dir):
    return signals.streak(_averages(spark, sf_dir), F.col("close") > F.col("b")).select("symbol", "ts", "streak")


_SCHEDULE = {
    "day": ("ts::DATE", lambda: pn.first_in_period("1D")),
    "week": ("date_trunc('week', ts)", lambda: pn.first_in_period("1W")),
    "month": ("date_trunc('month', ts)", lambda: pn.first_in_period("1M")),
}


@query("schedule_every", "SELECT symbol, ts, " + ", ".join(f"coalesce(lag({k}) OVER ({BY}) <> {k}, true) AS first_of_{n}" for n, (k, _) in _SCHEDULE.items()) + " FROM bars_h")
def schedule_every(spark, sf_dir):
    return bars_h(spark, sf_dir).select("symbol", "ts", *[make().alias(f"first_of_{n}") for n, (_, make) in _SCHEDULE.items()])


@query("schedule_open_close", f"SELECT symbol, ts, coalesce(lag(ts::DATE) OVER ({BY}) <> ts::DATE, true) AS at_open, coalesce(lead(ts::DATE) OVER ({BY}) <> ts::DATE, true) AS at_close, hour(ts) >= 23 OR hour(ts) = 22 AND minute(ts) >= 30 AS late, hour(ts) = 9 AND minute(ts) = 0 AS at_nine FROM bars_h")
def schedule_open_close(spark, sf_dir):
    return bars_h(spark, sf_dir).select("symbol", "ts", pn.at_open().alias("at_open"), pn.at_close().alias("at_close"), pn.at_close(calendar=False).alias("late"), pn.at_time(9).alias("at_nine"))


@query("session_close", f"SELECT symbol, ts, coalesce(lead(date_trunc('day', ts)) OVER ({BY}) <> date_trunc('day', ts), true) AS day_ends FROM bars_h")
def session_close(spark, sf_dir):
    return bars_h(spark, sf_dir).select("symbol", "ts", pn.session_close("1D").alias("day_ends"))
