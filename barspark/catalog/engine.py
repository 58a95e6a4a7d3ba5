"""Execution models, order triggers, limits and backtests."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import execution as ex
from ..operators import results as rs
from ..plans import backtest as bt
from ..plans import strategies as st
from ..sources.bars import bars_d, bars_h, bars_o
from . import R, query, r6

_PRICES = {"midpoint": ("(high + low) / 2", ex.midpoint), "vwap": ("(open + high + low + close) / 4", ex.typical_vwap), "at_open": ("open", ex.open_price), "at_close": ("close", ex.close_price)}


@query("execution_prices", "SELECT symbol, ts, " + ", ".join(f"{R(s)} AS {n}" for n, (s, _) in _PRICES.items()) + " FROM bars_h")
def execution_prices(spark, sf_dir):
    return bars_h(spark, sf_dir).select("symbol", "ts", *[r6(m().expr(), n) for n, (_, m) in _PRICES.items()])


_SIZE = "((hour(ts) % 5 - 2) * 3)::DOUBLE"


@query("slippage_fees_volume", f"""SELECT symbol, ts, {R('close * (1 + (CASE WHEN z > 0 THEN 1 ELSE -1 END) * 0.0025)')} AS price, {R('abs(z) * 0.01')} AS per_share, {R('abs(z * close) * 0.001')} AS percentage,
{R('CASE WHEN volume > 0 THEN greatest(least(z, 0.5 * volume), -0.5 * volume) ELSE 0 END')} AS size FROM (SELECT *, {_SIZE} AS z FROM bars_h)""")
def slippage_fees_volume(spark, sf_dir):
    z, c = ((F.hour("ts") % 5 - 2) * 3).cast("double"), F.col("close")
    return bars_h(spark, sf_dir).select("symbol", "ts", r6(ex.bps_slippage(25).expr(z, c), "price"), r6(ex.per_share_fees(0.01).expr(z, c), "per_share"), r6(ex.percentage_fees(0.001).expr(z, c), "percentage"), r6(ex.volume_limit(0.5).expr(z, F.col("volume")), "size"))


@query("order_triggers", f"""WITH o AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS p, CASE WHEN day(ts) % 2 = 0 THEN 1.0 ELSE -1.0 END AS z FROM bars_h)
SELECT symbol, ts, coalesce(low <= p AND p <= high, false) AS limit_fills, coalesce(CASE WHEN z > 0 THEN high >= p * 1.1 ELSE low <= p * 1.1 END, false) AS stop_fills,
coalesce((CASE WHEN z > 0 THEN high >= p * 1.1 ELSE low <= p * 1.1 END) AND low <= p AND p <= high, false) AS stop_limit_fills FROM o""")
def order_triggers(spark, sf_dir):
    p = F.lag("close").over(W.partitionBy("symbol").orderBy("ts"))
    df = bars_h(spark, sf_dir).withColumn("p", p).withColumn("z", F.when(F.day("ts") % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0)))
    fills = lambda kind: ex.triggered(F.lit(kind), F.col("z"), F.col("p"), F.col("p") * 1.1)
    return df.select("symbol", "ts", fills("LIMIT").alias("limit_fills"), fills("STOP").alias("stop_fills"), fills("STOP_LIMIT").alias("stop_limit_fills"))


_CLIP = "greatest(least(close / 100, 0.4), -0.4)"


@query("target_clamp", f"SELECT symbol, ts, {R(f'{_CLIP} * least(1, 1 / nullif(sum(abs({_CLIP})) OVER (PARTITION BY ts), 0))')} AS weight FROM bars_h")
def target_clamp(spark, sf_dir):
    w = bars_h(spark, sf_dir).select("symbol", "ts", (F.col("close") / 100).alias("weight"))
    return bt.clamp_weights(w, 0.4, 1.0).select("symbol", "ts", r6("weight", "weight"))


_SMA = "(SELECT symbol, ts, close, avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS f, avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS s FROM bars_d)"
_HELD = f"(SELECT symbol, ts, close, coalesce(last_value(CASE WHEN f > s THEN 1.0 WHEN f < s THEN 0.0 END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts), 0) AS w FROM {_SMA})"
_GROWTH = f"(SELECT symbol, ts, 1 + coalesce(lag(w) OVER (PARTITION BY symbol ORDER BY ts) * (close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1), 0) AS g FROM {_HELD})"
LONG_FLAT = f"SELECT symbol, ts, {R('product(g) OVER (PARTITION BY symbol ORDER BY ts)')} AS growth FROM {_GROWTH}"


@query("long_flat_closed_form", LONG_FLAT)
def long_flat_closed_form(spark, sf_dir):
    b = bars_d(spark, sf_dir)
    held = b.join(st.sma_crossover(b, fast=5, slow=10), ["symbol", "ts"])
    return bt.long_flat(held, F.col("weight")).select("symbol", "ts", r6(F.col("equity") / 100_000, "growth"))


@query("backtest_fold", LONG_FLAT)
def backtest_fold(spark, sf_dir):
    """The same strategy, a run per symbol, through the fold of cash and positions."""
    b = bars_d(spark, sf_dir).withColumn("volume", F.lit(1e12))
    orders = bt.target_orders(st.sma_crossover(b, fast=5, slow=10).withColumn("run_id", F.col("symbol")))
    got = bt.equity(bt.run(b.withColumn("run_id", F.col("symbol")), orders))
    return got.select(F.col("run_id").alias("symbol"), "ts", r6(F.col("equity") / 100_000, "growth"))


_ORDERED = """(SELECT *, coalesce(CASE k WHEN 1 THEN true WHEN 2 THEN low <= p AND p <= high WHEN 3 THEN hit ELSE hit AND low <= p AND p <= high END, false) AS fires, CASE k WHEN 2 THEN p WHEN 3 THEN p * 1.02 WHEN 4 THEN p END AS given
FROM (SELECT *, CASE WHEN z > 0 THEN high >= p * 1.02 ELSE low <= p * 1.02 END AS hit FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS p, day(ts) % 4 + 1 AS k, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i,
greatest(least(CASE WHEN day(ts) % 3 = 0 THEN -5.0 ELSE 5.0 END, volume), -volume)::DOUBLE AS z, CASE WHEN symbol = '2-HIGH' AND month(ts) = 3 AND day(ts) = 15 THEN 2.0 ELSE 1.0 END::DOUBLE AS split FROM bars_o)))"""


@query("backtest_orders", f"""WITH RECURSIVE o AS (SELECT * FROM {_ORDERED}),
r(symbol, ts, i, cash, pos, size, price, fee, close) AS (SELECT DISTINCT symbol, NULL::TIMESTAMP, 0::BIGINT, 1000000.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM o
UNION ALL SELECT symbol, ts, i, CASE WHEN abs(size) > 1e-12 THEN cash - size * price - abs(size) * 0.01 ELSE cash END, CASE WHEN abs(size) <= 1e-12 THEN pos WHEN abs(pos + size) < 1e-10 THEN 0.0 ELSE pos + size END, size, price, abs(size) * 0.01, close
  FROM (SELECT *, coalesce(given, close * (1 + CASE WHEN size > 0 THEN 1.0 ELSE -1.0 END * 0.0025)) AS price FROM (SELECT o.symbol, o.ts, o.i, o.close, o.given, r.cash, r.pos * o.split AS pos, CASE WHEN NOT fires THEN 0.0 WHEN z > 0 THEN least(z, r.cash / o.close) ELSE greatest(z, -abs(r.pos * o.split)) END::DOUBLE AS size FROM r JOIN o ON o.symbol = r.symbol AND o.i = r.i + 1))),
e AS (SELECT *, cash + pos * close AS equity FROM r WHERE i > 0)
SELECT symbol AS run_id, 'fill' AS kind, ts, {R('size')} AS size, {R('price')} AS price, {R('fee')} AS fee, NULL::DOUBLE AS equity, NULL::DOUBLE AS cash, NULL::DOUBLE AS positions_value, NULL::DOUBLE AS pnl, NULL::DOUBLE AS drawdown FROM e WHERE abs(size) > 1e-12
UNION ALL SELECT symbol, 'equity', ts, NULL, NULL, NULL, {R('equity / 1e6')}, {R('cash / 1e6')}, {R('pos * close / 1e6')}, {R('(equity - coalesce(lag(equity) OVER w, 1000000)) / 1e6')}, {R('equity / greatest(max(equity) OVER w, 1000000) - 1')} FROM e WINDOW w AS (PARTITION BY symbol ORDER BY ts)""")
def backtest_orders(spark, sf_dir):
    """A run a symbol, with market, limit, stop and stop-limit orders, fees, slippage, volume limits and a split: fills and snapshots."""
    b = bars_o(spark, sf_dir)
    p = F.lag("close").over(W.partitionBy("symbol").orderBy("ts"))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("MARKET", "LIMIT", "STOP", "STOP_LIMIT")]), (F.dayofmonth("ts") % 4 + 1).cast("int"))
    orders = b.select(F.col("symbol").alias("run_id"), "ts", F.lit(0).alias("seq"), "symbol", kind.alias("order_type"), F.when(F.dayofmonth("ts") % 3 == 0, F.lit(-5.0)).otherwise(F.lit(5.0)).alias("size"), p.alias("limit_price"), (p * 1.02).alias("stop_price"))
    splits = b.where("symbol = '2-HIGH' and month(ts) = 3 and day(ts) = 15").select("symbol", F.to_date("ts").alias("date"), F.lit(2.0).alias("ratio"))
    rules = bt.Rules(capital=1_000_000.0, slippage=ex.bps_slippage(25), fees=ex.per_share_fees(0.01), volume=ex.volume_limit(1.0))
    got = bt.run(b.withColumn("run_id", F.col("symbol")), orders, rules, splits=splits)
    return got.select("run_id", "kind", "ts", *[r6(c, c) for c in ("size", "price", "fee", "drawdown")], *[r6(F.col(c) / 1e6, c) for c in ("equity", "cash", "positions_value", "pnl")])


@query("trade_at_next_open", f"SELECT symbol, ts, lag(w) OVER (PARTITION BY symbol ORDER BY ts)::DOUBLE AS weight, {R('open')} AS fill_price FROM (SELECT h.symbol, h.ts, w, open FROM {_HELD} h JOIN bars_d USING (symbol, ts))")
def trade_at_next_open(spark, sf_dir):
    b = bars_d(spark, sf_dir)
    w = W.partitionBy("symbol").orderBy("ts")
    held = st.sma_crossover(b, fast=5, slow=10).join(b, ["symbol", "ts"])
    return held.select("symbol", "ts", F.lag("weight").over(w).alias("weight"), r6(ex.open_price().expr(), "fill_price"))


@query("snapshot_metrics", f"SELECT symbol AS run_id, ts, {R('e - lag(e) OVER w')} AS pnl, {R('e / max(e) OVER w - 1')} AS drawdown FROM (SELECT symbol, ts, product(g) OVER (PARTITION BY symbol ORDER BY ts) AS e FROM {_GROWTH}) WINDOW w AS (PARTITION BY symbol ORDER BY ts)")
def snapshot_metrics(spark, sf_dir):
    b = bars_d(spark, sf_dir)
    held = b.join(st.sma_crossover(b, fast=5, slow=10), ["symbol", "ts"])
    e = bt.long_flat(held, F.col("weight"), 1.0).withColumnRenamed("symbol", "run_id")
    return bt.snapshot_metrics(e).select("run_id", "ts", r6("pnl", "pnl"), r6("drawdown", "drawdown"))


@query("position_value", f"SELECT ts, {R('sum(close * volume)')} AS value FROM bars_d GROUP BY ts")
def position_value(spark, sf_dir):
    return bars_d(spark, sf_dir).groupBy("ts").agg(F.sum(F.col("close") * F.col("volume")).alias("v")).select("ts", r6("v", "value"))


@query("split_cumulative", f"SELECT symbol, ts, {R('product(CASE WHEN day(ts) = 10 THEN 2.0 WHEN day(ts) = 20 THEN 0.5 ELSE 1.0 END) OVER (PARTITION BY symbol ORDER BY ts)')} AS factor FROM bars_d")
def split_cumulative(spark, sf_dir):
    ratio = F.when(F.day("ts") == 10, F.lit(2.0)).when(F.day("ts") == 20, F.lit(0.5)).otherwise(F.lit(1.0))
    w = W.partitionBy("symbol").orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    return bars_d(spark, sf_dir).select("symbol", "ts", r6(F.product(ratio).over(w), "factor"))


def _held_runs(spark, sf_dir):
    """The runs of backtest_fold, with what they hold."""
    b = bars_d(spark, sf_dir).withColumns({"volume": F.lit(1e12), "run_id": F.col("symbol")})
    orders = bt.target_orders(st.sma_crossover(b.drop("run_id"), fast=5, slow=10).withColumn("run_id", F.col("symbol")))
    return bt.run(b, orders, bt.Rules(fees=ex.no_fees()), positions=True)


@query("run_exposures", f"SELECT symbol AS run_id, ts, symbol, {R('w')} AS exposure FROM {_HELD} WHERE w > 0")
def run_exposures(spark, sf_dir):
    return rs.exposures(bt.snapshots(_held_runs(spark, sf_dir))).select("run_id", "ts", "symbol", r6("exposure", "exposure"))


@query("run_turnover", f"SELECT symbol AS run_id, ts, {R('0.5 * abs(w - coalesce(lag(w) OVER (PARTITION BY symbol ORDER BY ts), w))')} AS turnover FROM {_HELD} WHERE symbol IN (SELECT symbol FROM {_HELD} WHERE w > 0)")
def run_turnover(spark, sf_dir):
    shots = bt.snapshots(_held_runs(spark, sf_dir))
    return rs.weight_turnover(rs.exposures(shots), times=shots).select("run_id", "ts", r6("turnover", "turnover"))
