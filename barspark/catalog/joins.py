"""Calendars, alignment, as-of and range joins, corporate actions, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import factors as fx
from ..functions.expr import align, col, compile, row
from ..operators import actions
from ..operators import panel as pn
from ..sources import bars as bars_of
from ..sources.bars import bars_d, bars_h, bars_o, bars_s
from . import R, query, r6

_COMMON = "(SELECT ts FROM bars_h GROUP BY ts HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM bars_h))"


@query("calendar_intersect", f"SELECT ts FROM {_COMMON}")
def calendar_intersect(spark, sf_dir):
    return pn.common_calendar(bars_h(spark, sf_dir))


@query("align_to_calendar", f"SELECT symbol, ts, {R('close')} AS close FROM bars_h WHERE ts IN {_COMMON}")
def align_to_calendar(spark, sf_dir):
    b = bars_h(spark, sf_dir).select("symbol", "ts", "close")
    return pn.align_to_calendar(b, pn.common_calendar(b)).select("symbol", "ts", r6("close", "close"))


@query("align_union", f"SELECT symbol, ts, {R('close')} AS close FROM (SELECT DISTINCT ts FROM bars_h) CROSS JOIN (SELECT DISTINCT symbol FROM bars_h) LEFT JOIN bars_h USING (symbol, ts)")
def align_union(spark, sf_dir):
    return align(bars_h(spark, sf_dir)).select("symbol", "ts", r6("close", "close"))


@query("inner_align", f"SELECT symbol, ts, {R('h.close')} AS close, {R('d.close')} AS day_close FROM bars_h h JOIN bars_d d USING (symbol, ts)")
def inner_align(spark, sf_dir):
    h, d = bars_h(spark, sf_dir).select("symbol", "ts", "close"), bars_d(spark, sf_dir).select("symbol", "ts", F.col("close").alias("day_close"))
    return h.join(d, ["symbol", "ts"]).select("symbol", "ts", r6("close", "close"), r6("day_close", "day_close"))


@query("benchmark_join", f"SELECT a.symbol, a.ts, {R('a.r')} AS r, {R('b.r')} AS benchmark FROM rets_h a JOIN rets_h b ON a.ts = b.ts AND b.symbol = 'click' WHERE a.r IS NOT NULL AND b.r IS NOT NULL")
def benchmark_join(spark, sf_dir):
    df = compile(bars_h(spark, sf_dir), {"r": fx.returns(), "benchmark": fx.benchmark("click", fx.returns())}).na.drop()
    return df.select("symbol", "ts", r6("r", "r"), r6("benchmark", "benchmark"))


@query("fundamental_join", f"SELECT symbol, o.ts, {R('size_sum / close')} AS value FROM bars_o o JOIN (SELECT o_orderpriority AS symbol, o_orderdate AS ts, sum(o_custkey)::DOUBLE AS size_sum FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2) f USING (symbol, ts)")
def fundamental_join(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderstatus = 'F'")  # a book that lacks some days
    given = o.groupBy(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("ts")).agg(F.sum("o_custkey").cast("double").alias("book"))
    panel = bars_o(spark, sf_dir).join(given, ["symbol", "ts"])
    return compile(panel, {"value": fx.ratio_to_price(col("book"))}).select("symbol", "ts", r6("value", "value"))


@query("log_market_cap_external", f"SELECT symbol, ts, {R('ln(nullif(coalesce(cap, close * volume), 0))')} AS value FROM bars_o LEFT JOIN (SELECT o_orderpriority AS symbol, o_orderdate AS ts, sum(o_custkey)::DOUBLE AS cap FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2) USING (symbol, ts)")
def log_market_cap_external(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderstatus = 'F'")  # a book that lacks some days
    given = o.groupBy(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("ts")).agg(F.sum("o_custkey").cast("double").alias("cap"))
    return compile(bars_o(spark, sf_dir).join(given, ["symbol", "ts"], "left"), {"value": fx.log_market_cap(col("cap"))}).select("symbol", "ts", r6("value", "value"))


@query("regression_align", f"SELECT symbol, ts, {R('r')} AS y, {R('m')} AS x1, {R('v')} AS x2 FROM (SELECT symbol, ts, r, lag(r) OVER (PARTITION BY symbol ORDER BY ts) AS m, lag(r, 2) OVER (PARTITION BY symbol ORDER BY ts) AS v FROM rets_h) WHERE r IS NOT NULL AND m IS NOT NULL AND v IS NOT NULL")
def regression_align(spark, sf_dir):
    from ..functions.expr import lag

    y = fx.returns()
    df = compile(bars_h(spark, sf_dir), {"y": y, "x1": lag(y, 1), "x2": lag(y, 2)}).na.drop()
    return df.select("symbol", "ts", r6("y", "y"), r6("x1", "x1"), r6("x2", "x2"))


_WEEK = "(SELECT symbol, date_trunc('week', d.ts)::TIMESTAMP + INTERVAL 7 DAYS AS known, arg_max(close, d.ts) AS week_close FROM bars_d d GROUP BY 1, 2)"


@query("asof_backward", f"SELECT h.symbol, h.ts, {R('h.close')} AS close, {R('w.week_close')} AS week_close FROM bars_h h ASOF LEFT JOIN {_WEEK} w ON h.symbol = w.symbol AND h.ts >= w.known")
def asof_backward(spark, sf_dir):
    """Each hour with the last week that had ended."""
    weeks = bars_of.resample(bars_d(spark, sf_dir), "1W").select("symbol", (F.col("ts") + F.expr("INTERVAL 1 DAY")).cast("timestamp_ntz").alias("known"), F.col("close").alias("week_close"))
    got = pn.asof(bars_h(spark, sf_dir).select("symbol", "ts", "close"), weeks, ["symbol"], right_on="known")
    return got.select("symbol", "ts", r6("close", "close"), r6("week_close", "week_close"))


_EVENTS = "(SELECT ts, event_type AS type, CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_type END AS symbol, event_id FROM events)"


def _events(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("ts", F.col("event_type").alias("type"), F.when(F.col("event_id") % 10 != 0, F.col("event_type")).alias("symbol"), "event_id")


@query("events_window", f"SELECT b.symbol, b.ts, count(*) AS events, min(e.event_id) AS first_event FROM bars_d b JOIN {_EVENTS} e ON e.ts >= b.ts - INTERVAL 1 DAY AND e.ts <= b.ts AND (e.symbol IS NULL OR e.symbol = b.symbol) GROUP BY 1, 2")
def events_window(spark, sf_dir):
    got = pn.range_join(bars_d(spark, sf_dir).select("symbol", "ts"), _events(spark, sf_dir), "1 DAY")
    return got.groupBy("symbol", "ts").agg(F.count("*").alias("events"), F.min("event_event_id").alias("first_event"))


@query("has_event", f"SELECT b.symbol, b.ts FROM bars_h b WHERE EXISTS (SELECT 1 FROM {_EVENTS} e WHERE e.ts >= b.ts - INTERVAL 3 HOURS AND e.ts <= b.ts AND (e.symbol IS NULL OR e.symbol = b.symbol))")
def has_event(spark, sf_dir):
    b = bars_h(spark, sf_dir).select("symbol", "ts")
    return pn.has_event(b, _events(spark, sf_dir), "3 HOURS").where("has_event").select("symbol", "ts")


@query("events_between", f"SELECT event_id, ts, type, symbol FROM {_EVENTS} WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-09' AND type = 'click' AND symbol = 'click'")
def events_between(spark, sf_dir):
    return pn.events_between(_events(spark, sf_dir), "2024-01-05", "2024-01-09", "click", "click").select("event_id", "ts", "type", "symbol")


@query("events_at", f"SELECT b.event_id AS bar, e.event_id AS event FROM events b JOIN {_EVENTS} e ON b.ts::DATE = e.ts::DATE AND abs(epoch_us(b.ts) - epoch_us(e.ts)) < 1000000 AND (e.symbol IS NULL OR e.symbol = b.event_type)")
def events_at(spark, sf_dir):
    b = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", F.col("event_type").alias("symbol"), F.col("event_id").alias("bar"))
    return pn.events_at(b, _events(spark, sf_dir)).select("bar", F.col("event_event_id").alias("event"))


_ACTIONS = "(VALUES ('1-URGENT', DATE '1996-06-03', 2.0), ('2-HIGH', DATE '1997-03-10', 3.0), ('2-HIGH', DATE '1999-09-01', 0.5), ('5-LOW', DATE '1998-01-05', 4.0)) s(symbol, date, ratio)"


def _splits(spark):
    from datetime import date

    rows = [("1-URGENT", date(1996, 6, 3), 2.0), ("2-HIGH", date(1997, 3, 10), 3.0), ("2-HIGH", date(1999, 9, 1), 0.5), ("5-LOW", date(1998, 1, 5), 4.0)]
    return spark.createDataFrame(rows, "symbol string, date date, ratio double")


@query("actions_on_date", f"SELECT symbol, ts, {R('close')} AS close, ratio::DOUBLE AS ratio FROM bars_o JOIN {_ACTIONS} USING (symbol) WHERE ts::DATE = s.date")
def actions_on_date(spark, sf_dir):
    got = actions.on_date(bars_o(spark, sf_dir), _splits(spark))
    return got.select("symbol", "ts", r6("close", "close"), "ratio")


@query("split_probe", f"SELECT symbol, date, ratio::DOUBLE AS ratio, {R('arg_max(close, ts) FILTER (ts < date)')} AS before, {R('arg_min(close, ts) FILTER (ts >= date)')} AS after FROM {_ACTIONS} JOIN bars_o USING (symbol) WHERE ts >= date - INTERVAL 5 DAYS AND ts <= date + INTERVAL 5 DAYS GROUP BY ALL")
def split_probe(spark, sf_dir):
    return actions.split_probe(bars_o(spark, sf_dir), _splits(spark), 5).select("symbol", "date", "ratio", r6("before", "before"), r6("after", "after"))


@query("split_detection", f"""WITH p AS (SELECT symbol, date, ratio::DOUBLE AS ratio, arg_max(close, ts) FILTER (ts < date) AS before, arg_min(close, ts) FILTER (ts >= date) AS after FROM {_ACTIONS} JOIN bars_o USING (symbol) WHERE ts >= date - INTERVAL 5 DAYS AND ts <= date + INTERVAL 5 DAYS GROUP BY ALL),
v AS (SELECT symbol, count(*) FILTER (abs(before / after - ratio) / ratio <= 0.25) AS raw_votes, count(*) FILTER (abs(before / after - ratio) / ratio > 0.25 AND abs(before / after - 1) <= 0.25) AS adjusted_votes FROM p WHERE before > 0 AND after > 0 GROUP BY symbol)
SELECT symbol, raw_votes, adjusted_votes, adjusted_votes > raw_votes AS is_adjusted FROM v""")
def split_detection(spark, sf_dir):
    return actions.detect_adjusted(bars_o(spark, sf_dir), _splits(spark)).select("symbol", "raw_votes", "adjusted_votes", "is_adjusted")


@query("split_adjust_panel", f"SELECT symbol, ts, {R('close / coalesce((SELECT product(ratio) FROM ' + _ACTIONS + ' WHERE s.symbol = bars_o.symbol AND s.date > bars_o.ts::DATE), 1)')} AS close FROM bars_o")
def split_adjust_panel(spark, sf_dir):
    return actions.back_adjust(bars_o(spark, sf_dir), _splits(spark)).select("symbol", "ts", r6("close", "close"))


@query("set_operations", "SELECT symbol, ts FROM (SELECT symbol, ts FROM bars_h WHERE volume >= 2 INTERSECT SELECT symbol, ts FROM bars_h WHERE close >= 50) UNION SELECT symbol, ts FROM bars_d")
def set_operations(spark, sf_dir):
    h = bars_h(spark, sf_dir)
    return h.where("volume >= 2").select("symbol", "ts").intersect(h.where("close >= 50").select("symbol", "ts")).union(bars_d(spark, sf_dir).select("symbol", "ts")).distinct()


@query("positional_slice", f"SELECT symbol, ts, {R('close')} AS close FROM bars_o JOIN (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i FROM (SELECT DISTINCT ts FROM bars_o)) USING (ts) WHERE i BETWEEN 100 AND 199")
def positional_slice(spark, sf_dir):
    return pn.positional_slice(bars_o(spark, sf_dir), 100, 200).select("symbol", "ts", r6("close", "close"))


@query("top_n_by_score", f"SELECT symbol, {R('score')} AS score FROM (SELECT symbol, avg(close) AS score FROM bars_s GROUP BY symbol ORDER BY score DESC, symbol LIMIT 10)")
def top_n_by_score(spark, sf_dir):
    score = bars_s(spark, sf_dir).groupBy("symbol").agg(F.avg("close").alias("score"))
    return score.orderBy(F.desc("score"), "symbol").limit(10).select("symbol", r6("score", "score"))
