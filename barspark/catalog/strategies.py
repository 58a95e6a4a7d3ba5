"""Canonical strategies as target weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import strategies as st
from ..sources.bars import bars_d, bars_h, bars_o, bars_s
from . import R, query, r6

_BY = "PARTITION BY symbol ORDER BY ts"


def _w(n):
    return f"({_BY} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _held(enter, leave):
    return f"coalesce(last_value(CASE WHEN {enter} THEN 1.0 WHEN {leave} THEN 0.0 END IGNORE NULLS) OVER ({_BY}), 0)::DOUBLE"


def _weights(df):
    return df.select("symbol", "ts", r6("weight", "weight"))


@query("buy_and_hold", f"SELECT symbol, ts, {R('1.0 / count(*) OVER (PARTITION BY ts)')} AS weight FROM bars_h")
def buy_and_hold(spark, sf_dir):
    return _weights(st.buy_and_hold(bars_h(spark, sf_dir)))


@query("sma_crossover", f"SELECT symbol, ts, {_held('f > s', 'f < s')} AS weight FROM (SELECT *, avg(close) OVER {_w(10)} AS f, avg(close) OVER {_w(30)} AS s FROM bars_h)")
def sma_crossover(spark, sf_dir):
    return _weights(st.sma_crossover(bars_h(spark, sf_dir)))


@query("rsi_reversion", f"SELECT symbol, ts, {_held('r < 30', 'r > 70')} AS weight FROM (SELECT symbol, ts, CASE WHEN l = 0 THEN 0 ELSE 100 - 100 / (1 + g / l) END AS r FROM (SELECT symbol, ts, avg(CASE WHEN d > 0 THEN d ELSE 0 END) OVER w AS g, avg(CASE WHEN d < 0 THEN -d ELSE 0 END) OVER w AS l FROM (SELECT *, close - lag(close) OVER ({_BY}) AS d FROM bars_h) WINDOW w AS {_w(14)}))")
def rsi_reversion(spark, sf_dir):
    return _weights(st.rsi_reversion(bars_h(spark, sf_dir)))


@query("three_day_breakout", f"""WITH a AS (SELECT symbol, ts, close > avg(close) OVER {_w(20)} AS ok, row_number() OVER ({_BY}) AS n FROM bars_h),
i AS (SELECT *, sum((NOT ok)::INT) OVER ({_BY}) AS island FROM a),
k AS (SELECT *, CASE WHEN ok THEN sum(ok::INT) OVER (PARTITION BY symbol, island ORDER BY ts) ELSE 0 END AS streak FROM i)
SELECT symbol, ts, {R('coalesce((streak >= 3 AND n > 20)::INT / nullif(sum((streak >= 3 AND n > 20)::INT) OVER (PARTITION BY ts), 0), 0)')} AS weight FROM k""")
def three_day_breakout(spark, sf_dir):
    return _weights(st.breakout(bars_h(spark, sf_dir)))


@query("weekly_trend", f"SELECT d.symbol, d.ts, coalesce((d.close > w.week)::INT, 0)::DOUBLE AS weight FROM bars_d d ASOF LEFT JOIN (SELECT symbol, date_trunc('week', b.ts)::TIMESTAMP + INTERVAL 7 DAYS AS known, arg_max(close, b.ts) AS week FROM bars_d b GROUP BY 1, 2) w ON d.symbol = w.symbol AND d.ts >= w.known")
def weekly_trend(spark, sf_dir):
    return _weights(st.weekly_trend(bars_d(spark, sf_dir)))


@query("xs_momentum", f"""WITH m AS (SELECT symbol, ts, close / lag(close, 63) OVER ({_BY}) - 1 AS v FROM bars_s), s AS (SELECT min(ts) AS ts FROM bars_s GROUP BY date_trunc('month', ts)),
t AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY v DESC NULLS LAST, symbol) AS n FROM m SEMI JOIN s USING (ts)), u AS (SELECT * FROM t WHERE n <= 5 AND v IS NOT NULL)
SELECT symbol, ts, {R('CASE WHEN sum(greatest(v, 0)) OVER (PARTITION BY ts) > 0 THEN greatest(v, 0) / sum(greatest(v, 0)) OVER (PARTITION BY ts) ELSE 1.0 / count(*) OVER (PARTITION BY ts) END')} AS weight FROM u""")
def xs_momentum(spark, sf_dir):
    return _weights(st.top_momentum(bars_s(spark, sf_dir)))


@query("low_vol", f"SELECT symbol, ts, {R('coalesce(k / nullif(sum(k) OVER (PARTITION BY ts), 0), 0)')} AS weight FROM (SELECT symbol, ts, coalesce(v <= quantile_cont(v, 0.3) OVER (PARTITION BY ts), false)::INT AS k FROM (SELECT symbol, ts, stddev_samp(r) OVER {_w(63)} AS v FROM rets_o))")
def low_vol(spark, sf_dir):
    return _weights(st.low_volatility(bars_o(spark, sf_dir)))


_Z = lambda c: f"({c} - avg({c}) OVER (PARTITION BY ts)) / nullif(stddev_samp({c}) OVER (PARTITION BY ts), 0)"


@query("composite", f"""WITH r AS (SELECT symbol, ts, close, close / lag(close) OVER ({_BY}) - 1 AS r, ln(close) AS y, row_number() OVER ({_BY})::DOUBLE AS x FROM bars_h),
f AS (SELECT symbol, ts, close / lag(close, 20) OVER ({_BY}) - 1 AS m, CASE WHEN count(y) OVER w >= 2 THEN regr_slope(y, x) OVER w END AS t, stddev_samp(r) OVER w * sqrt(252) AS v FROM r WINDOW w AS {_w(20)})
SELECT symbol, ts, {R(f"0.4 * {_Z('m')} + 0.3 * {_Z('t')} - 0.3 * {_Z('v')}")} AS score FROM f""")
def composite(spark, sf_dir):
    return st.style_score(bars_h(spark, sf_dir)).select("symbol", "ts", r6("score", "score"))


@query("daily_signal_intraday", f"""WITH d AS (SELECT symbol, ts + INTERVAL 1 DAY AS known, avg(close) OVER w AS m, count(*) OVER w AS n FROM bars_d WINDOW w AS {_w(5)}),
h AS (SELECT symbol, ts, close, lead(open) OVER ({_BY}) AS fill_price, coalesce(lead(ts::DATE) OVER ({_BY}) <> ts::DATE, true) AS last FROM bars_h)
SELECT h.symbol, h.ts, (close > m)::INT::DOUBLE AS weight, {R('fill_price')} AS fill_price FROM h ASOF JOIN (SELECT symbol, known, CASE WHEN n = 5 THEN m END AS m FROM d) d ON h.symbol = d.symbol AND h.ts >= d.known WHERE last AND m IS NOT NULL""")
def daily_signal_intraday(spark, sf_dir):
    return st.daily_signal_intraday(bars_h(spark, sf_dir), 5).select("symbol", "ts", "weight", r6("fill_price", "fill_price"))


@query("regime_rotation", f"""WITH RECURSIVE a AS (SELECT symbol, ts, close, avg(close) OVER {_w(10)} AS f, avg(close) OVER {_w(250)} AS s, row_number() OVER ({_BY}) AS i FROM bars_o),
g AS (SELECT *, sum((NOT close > s)::INT) OVER ({_BY}) AS ups, sum((NOT close < s)::INT) OVER ({_BY}) AS downs FROM a),
n AS (SELECT *, count(*) FILTER (close > s) OVER (PARTITION BY symbol, ups ORDER BY ts) AS up, count(*) FILTER (close < s) OVER (PARTITION BY symbol, downs ORDER BY ts) AS down FROM g),
r(symbol, ts, i, w) AS (SELECT symbol, ts, i, 0.0::DOUBLE FROM n WHERE i = 1 UNION ALL SELECT n.symbol, n.ts, n.i, CASE WHEN w = 1 AND close < f OR w = -1 AND close > f THEN 0.0 WHEN up >= 3 AND close > f THEN 1.0 WHEN down >= 3 AND close < f THEN -1.0 ELSE w END::DOUBLE FROM r JOIN n ON n.symbol = r.symbol AND n.i = r.i + 1)
SELECT symbol, ts, w AS weight FROM r""")
def regime_rotation(spark, sf_dir):
    return st.regime_rotation(bars_o(spark, sf_dir))


@query("earnings_event", f"""WITH e AS (SELECT b.symbol, b.ts, EXISTS (SELECT 1 FROM events x WHERE x.event_type = b.symbol AND x.ts >= b.ts - INTERVAL 3 HOURS AND x.ts <= b.ts) AS seen, row_number() OVER ({_BY}) AS i FROM bars_h b)
SELECT symbol, ts, coalesce(i - max(CASE WHEN seen THEN i END) OVER ({_BY}) < 2, false)::INT::DOUBLE AS weight FROM e""")
def earnings_event(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", F.col("event_type").alias("type"), F.col("event_type").alias("symbol"))
    return st.event_hold(bars_h(spark, sf_dir), e, "3 HOURS")
