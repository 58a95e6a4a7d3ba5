"""Normalisation, symbols, time zones, events and resampling."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import panel as pn
from ..session import work_dir
from ..sources import bars as bars_of
from ..sources import readers
from ..sources.bars import bars_d, bars_h, bars_o, bars_s
from . import R, query, r6

_OHLCV = ", ".join(f"{R(c)} AS {c}" for c in ("open", "high", "low", "close", "volume"))


#: Unit prices end within 7 decimals, so that 8 never round a tie.
_OHLCV8 = _OHLCV.replace(", 6)", ", 8)")


def _rounded(df, places: int = 6):
    return df.select("symbol", "ts", *[(F.round(c, places) + F.lit(0.0)).alias(c) for c in ("open", "high", "low", "close", "volume")])


for _name, _make in (("bars_h", bars_h), ("bars_d", bars_d), ("bars_o", bars_o), ("bars_s", bars_s)):
    query(f"resample_ticks_{_name}", f"SELECT symbol, ts, {_OHLCV8} FROM {_name}")(lambda spark, sf_dir, make=_make: _rounded(make(spark, sf_dir), 8))


@query("resample_ohlcv", f"SELECT symbol, ts, {_OHLCV} FROM (SELECT symbol, date_trunc('week', ts)::TIMESTAMP + INTERVAL 6 DAYS AS ts, arg_min(open, b.ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, b.ts) AS close, sum(volume) AS volume FROM bars_d b GROUP BY symbol, 2)")
def resample_ohlcv(spark, sf_dir):
    return _rounded(bars_of.resample(bars_d(spark, sf_dir), "1W"))


@query("resample_4h_filled", f"""WITH b AS (SELECT symbol, time_bucket(INTERVAL 4 HOURS, h.ts, TIMESTAMP '2000-01-01') AS ts, arg_min(open, h.ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, h.ts) AS close, sum(volume) AS volume FROM bars_h h GROUP BY symbol, 2),
g AS (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 4 HOURS)) AS ts FROM b GROUP BY symbol)
SELECT symbol, ts, {R('open')} AS open, {R('high')} AS high, {R('low')} AS low, {R('close')} AS close, {R('coalesce(volume, 0)')} AS volume FROM g LEFT JOIN b USING (symbol, ts)""")
def resample_4h_filled(spark, sf_dir):
    return _rounded(bars_of.resample(bars_h(spark, sf_dir), "4H", fill_gaps=True))


@query("resample_monthly", f"SELECT symbol, ts, {_OHLCV} FROM (SELECT symbol, last_day(o.ts)::TIMESTAMP AS ts, arg_min(open, o.ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, o.ts) AS close, sum(volume) AS volume FROM bars_o o GROUP BY symbol, 2)")
def resample_monthly(spark, sf_dir):
    return _rounded(bars_of.resample(bars_o(spark, sf_dir), "1M"))


@query("normalize_ohlcv", f"SELECT upper(event_type) AS symbol, ts, {R('value')} AS open, {R('value + 1')} AS high, {R('value - 1')} AS low, {R('value * 0.5')} AS close, {R('10')} AS volume, {R('value')} AS close_raw FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0")
def normalize_ohlcv(spark, sf_dir):
    """Text columns under other names; every seventh price and every eleventh time cannot be read."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    v = F.col("value")
    raw = e.select(
        F.upper("event_type").alias("Ticker"), F.when(F.col("event_id") % 11 == 0, F.lit("n/a")).otherwise(F.col("ts").cast("string")).alias("Datetime"),
        v.cast("string").alias("Opening"), (v + 1).cast("string").alias("H"), (v - 1).cast("string").alias("l"),
        F.when(F.col("event_id") % 7 == 0, F.lit("-")).otherwise(v.cast("string")).alias("Last"), F.lit("10").alias("Volumne"), (v * 0.5).cast("string").alias("Adj Close"),
    )
    return readers.normalize(raw).select("symbol", "ts", *[r6(c, c) for c in ("open", "high", "low", "close", "volume", "close_raw")])


@query("infer_symbol", "SELECT DISTINCT event_type AS name, upper(regexp_split_to_array(event_type || '_daily.csv', '[_\\-.]')[1]) AS symbol FROM events")
def infer_symbol(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type").distinct()
    return e.select(F.col("event_type").alias("name"), readers.infer_symbol(F.concat(F.lit("data/"), F.col("event_type"), F.lit("_daily.csv"))).alias("symbol"))


@query("attach_symbol", "SELECT 'SPY' AS symbol, count(*) AS bars FROM bars_d")
def attach_symbol(spark, sf_dir):
    return bars_d(spark, sf_dir).withColumn("symbol", F.lit("SPY")).groupBy("symbol").agg(F.count("*").alias("bars"))


@query("tz_to_utc", "SELECT event_id, timezone('UTC', timezone('America/New_York', ts))::TIMESTAMP AS ts FROM events")
def tz_to_utc(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", readers.timestamp(F.col("ts").cast("string"), "America/New_York").alias("ts"))


@query("load_events_payload", "SELECT ts, event_type AS type, 'U' || user_id AS symbol, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value::DECIMAL(18,2)::VARCHAR END AS payload_value, (event_id % 3 <> 0)::INT + 1 AS keys FROM events")
def load_events_payload(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    raw = e.select(F.col("ts").cast("string").alias("timestamp"), F.col("event_type").alias("type"), F.concat(F.lit("u"), F.col("user_id")).alias("symbol"), F.when(F.col("event_id") % 3 != 0, F.col("value").cast("decimal(18,2)").cast("string")).alias("value"), F.col("event_id").cast("string").alias("id"))
    return readers.events(raw).select("ts", "type", "symbol", F.col("payload")["value"].alias("payload_value"), F.size("payload").alias("keys"))


@query("dedupe", "SELECT symbol, count(*) AS n, " + R("sum(close)") + " AS total FROM bars_d GROUP BY symbol")
def dedupe(spark, sf_dir):
    b = bars_d(spark, sf_dir)
    return pn.dedupe(b.unionByName(b)).groupBy("symbol").agg(F.count("*").alias("n"), r6(F.sum("close"), "total"))


# Files: the panel's own symbols are written, each to one file, and read back.


def _write(df, folder: str, name: str) -> str:
    """Writes df as the one CSV or Parquet file folder/name."""
    spark, kind = df.sparkSession, name.rsplit(".", 1)[1]
    raw = f"{folder}-raw-{name}"
    df.coalesce(1).write.option("header", True).format(kind).save(raw)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(raw).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in fs.listStatus(path(raw)) if f.getPath().getName().startswith("part-"))
    fs.mkdirs(path(folder))
    fs.rename(part, path(f"{folder}/{name}"))
    fs.delete(path(raw), True)
    return f"{folder}/{name}"


def _folder(spark) -> str:
    return f"{work_dir(spark)}/files-{uuid.uuid4().hex[:12]}"


def _of(bars, symbol: str):
    return bars.where(F.col("symbol") == symbol).drop("symbol")


@query("load_csv", f"SELECT upper(symbol) AS symbol, ts, {_OHLCV} FROM bars_h WHERE symbol = 'click'")
def load_csv(spark, sf_dir):
    return _rounded(readers.load_csv(spark, _write(_of(bars_h(spark, sf_dir), "click"), _folder(spark), "click_hourly.csv")))


@query("load_parquet", f"SELECT 'VIEWS' AS symbol, ts, {_OHLCV} FROM bars_h WHERE symbol = 'view'")
def load_parquet(spark, sf_dir):
    return _rounded(readers.load_parquet(spark, _write(_of(bars_h(spark, sf_dir), "view"), _folder(spark), "v.parquet"), symbol="views"))


@query("load_directory", f"SELECT upper(symbol) AS symbol, ts, {_OHLCV}, {R("CASE WHEN symbol = 'click' THEN close * 2 END")} AS close_raw FROM bars_d")
def load_directory(spark, sf_dir):
    """A file a symbol: CSV files with three headers, and Parquet."""
    b, folder = bars_d(spark, sf_dir).cache(), _folder(spark)
    for k, symbol in enumerate(sorted(r["symbol"] for r in b.select("symbol").distinct().collect())):
        own = _of(b, symbol)
        if symbol == "click":
            own = own.select(F.col("close").alias("Adj Close"), "volume", (F.col("close") * 2).alias("Close"), F.lit("x").alias("note"), "low", "high", "open", F.col("ts").alias("Datetime"))
        elif k % 2:
            own = own.select(F.col("ts").alias("Date"), F.col("close").alias("Last"), F.col("volume").alias("Vol"), F.col("low").alias("L"), F.col("high").alias("H"), F.col("open").alias("O"))
        _write(own, folder, f"{symbol}_daily.{'parquet' if k == 2 else 'csv'}")
    b.unpersist()
    got = readers.load_directory(spark, folder)
    return got.select("symbol", "ts", *[r6(c, c) for c in ("open", "high", "low", "close", "volume", "close_raw")])


@query("load_splits", "SELECT 'C' || c_custkey AS symbol, (DATE '2020-01-01' + (c_custkey % 900)::INT) AS date, (1 + c_custkey % 4)::DOUBLE AS ratio FROM customer")
def load_splits(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    rows = c.select(F.concat(F.lit("c"), F.col("c_custkey")).alias("Ticker"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("c_custkey") % 900).cast("int")).alias("date"), (F.col("c_custkey") % 4 + 1).alias("split"))
    return readers.load_splits(spark, _write(rows, _folder(spark), "splits.csv")).select("symbol", "date", "ratio")


@query("load_dividends", f"SELECT 'DIV' AS symbol, o_orderdate::DATE AS date, {R('sum(o_totalprice)')} AS amount FROM orders GROUP BY 2")
def load_dividends(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = o.groupBy(F.to_date("o_orderdate").alias("Date")).agg(F.sum("o_totalprice").alias("Dividend"))
    return readers.load_dividends(spark, _write(rows, _folder(spark), "div_all.csv")).select("symbol", "date", r6("amount", "amount"))


@query("load_events_csv", "SELECT ts, event_type AS type, 'U' || user_id AS symbol, event_id::VARCHAR AS payload_id FROM events")
def load_events_csv(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = e.select(F.col("ts").cast("string").alias("Timestamp"), F.col("event_type").alias("Event"), F.concat(F.lit("u"), F.col("user_id")).alias("Sym"), F.col("event_id").alias("id"))
    got = readers.load_events(spark, _write(rows, _folder(spark), "events.csv"))
    return got.select("ts", "type", "symbol", F.col("payload")["id"].alias("payload_id"))
