"""Bars (symbol, ts, open, high, low, close, volume) from ticks, and from finer bars."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ["symbol", "ts", "open", "high", "low", "close", "volume"]
_MICROS = {"min": 60_000_000, "H": 3_600_000_000, "D": 86_400_000_000}
_UNITS = {"t": "min", "min": "min", "h": "H", "d": "D", "w": "W", "m": "M"}


def parse_rule(rule: str) -> tuple[int, str]:
    """'15min', '2H', '1D', 'W', '1M' -> count and unit."""
    m = re.fullmatch(r"\s*(\d*)\s*(min|[tThHdDwWmM])\s*", rule)
    if not m or m[1] == "0":
        raise ValueError(f"unknown rule {rule!r}")
    return int(m[1] or 1), _UNITS[m[2].lower()]


def bucket(ts: Column, rule: str) -> Column:
    """The label of the bucket that holds ts: its start, for weeks their Sunday, for months their last day."""
    n, unit = parse_rule(rule)
    ntz = "timestamp_ntz"
    if unit == "W":
        if n != 1:
            raise ValueError("weeks come one at a time")
        return (F.date_trunc("week", ts).cast(ntz) + F.expr("INTERVAL 6 DAYS")).cast(ntz)
    if unit == "M":
        if n != 1:
            raise ValueError("months come one at a time")
        return F.last_day(ts).cast(ntz)
    if n == 1:
        return F.date_trunc({"min": "minute", "H": "hour", "D": "day"}[unit], ts).cast(ntz)
    step = n * _MICROS[unit]
    micros = F.unix_micros(ts.cast("timestamp"))
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(step))).cast(ntz)


def from_ticks(ticks: DataFrame, rule: str | None, price: Column, symbol: Column, ts: Column, order: Column, volume: Column) -> DataFrame:
    """One bar per symbol and bucket; ticks in a bucket are in the order of `order`. Without rule the ticks' own times are the buckets."""
    at = bucket(ts, rule) if rule else ts.cast("timestamp_ntz")
    rows = ticks.select(symbol.cast("string").alias("symbol"), at.alias("ts"), price.cast("double").alias("p"), order.alias("o"), volume.cast("double").alias("v"))
    return rows.groupBy("symbol", "ts").agg(F.min_by("p", "o").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "o").alias("close"), F.sum("v").alias("volume"))


def resample(bars: DataFrame, rule: str, fill_gaps: bool = False) -> DataFrame:
    """Coarser bars. fill_gaps adds the empty buckets between a symbol's first and last (volume 0, no prices)."""
    out = from_bars(bars, rule)
    if not fill_gaps:
        return out
    n, unit = parse_rule(rule)
    step = {"min": f"INTERVAL {n} MINUTES", "H": f"INTERVAL {n} HOURS", "D": f"INTERVAL {n} DAYS", "W": "INTERVAL 7 DAYS", "M": "INTERVAL 1 MONTH"}[unit]
    ends = out.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    every = ends.select("symbol", F.explode(F.sequence("a", "b", F.expr(step))).alias("ts"))
    every = every.withColumn("ts", F.last_day("ts").cast("timestamp_ntz")) if unit == "M" else every
    return every.join(out, ["symbol", "ts"], "left").withColumn("volume", F.coalesce("volume", F.lit(0.0)))


def from_bars(bars: DataFrame, rule: str) -> DataFrame:
    rows = bars.withColumn("_at", bucket(F.col("ts"), rule))
    agg = [F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume")]
    return rows.groupBy("symbol", F.col("_at").alias("_ts")).agg(*agg).withColumnRenamed("_ts", "ts").select(COLUMNS)


def bars_h(spark, sf_dir: str) -> DataFrame:
    """Hourly bars of the event stream, a symbol per event type."""
    return _events(spark, sf_dir, "H")


def bars_d(spark, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, "D")


def _events(spark, sf_dir: str, rule: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return from_ticks(e, rule, F.col("value"), F.col("event_type"), F.col("ts"), F.col("ts"), F.lit(1.0))


def bars_o(spark, sf_dir: str) -> DataFrame:
    """Daily bars of order prices, a symbol per priority."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return from_ticks(o, None, F.col("o_totalprice"), F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_orderkey"), F.lit(1.0))


def bars_s(spark, sf_dir: str) -> DataFrame:
    """Daily bars of unit prices, a symbol per supplier."""
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return from_ticks(x, None, price, F.col("l_suppkey"), F.col("l_shipdate"), F.struct("l_orderkey", "l_linenumber", "l_partkey", price), F.col("l_quantity"))
