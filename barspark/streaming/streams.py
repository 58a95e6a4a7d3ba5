"""Streams of ticks and bars: windows with watermarks, sessions, and state per symbol or run.

The stateful steps are the batch ones: a stream that has read all its input ends at the batch result.
"""

from __future__ import annotations

import json
import threading
import time
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.recursive import Ema
from ..plans import backtest as bt
from ..session import ship, work_dir


def ticks(spark: SparkSession, sf_dir: str, symbol: str = "event_type", files_per_batch: int = 1) -> DataFrame:
    """The event table as a stream: symbol, ts (with zone, as watermarks need), price."""
    path = f"{sf_dir}/events.parquet"
    raw = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path}*")  # a pattern, as the table may be one file
    return raw.select(F.col(symbol).cast("string").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"))


def bars(stream: DataFrame, width: str, delay: str = "1 hour") -> DataFrame:
    """OHLCV of tumbling windows; ticks later than `delay` are dropped once their window is closed."""
    w = F.window("ts", width)
    agg = stream.withWatermark("ts", delay).groupBy("symbol", w.alias("w")).agg(F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.count("*").cast("double").alias("volume"))
    return agg.select("symbol", F.col("w.start").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume")


def counts(stream: DataFrame, width: str, slide: str, delay: str = "1 hour") -> DataFrame:
    """Ticks in sliding windows."""
    agg = stream.withWatermark("ts", delay).groupBy("symbol", F.window("ts", width, slide).alias("w")).agg(F.count("*").alias("n"))
    return agg.select("symbol", F.col("w.start").cast("timestamp_ntz").alias("ts"), "n")


def sessions(stream: DataFrame, gap: str, delay: str = "1 hour") -> DataFrame:
    """Ticks of runs without a gap that long."""
    agg = stream.withWatermark("ts", delay).groupBy("symbol", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return agg.select("symbol", F.col("w.start").cast("timestamp_ntz").alias("ts"), "n")


#: Rows of a symbol and batch that a task gives out at once.
PIECE = 1 << 14


def _averaged(span: float):
    def step(key, frames, state):
        ts, price = (np.concatenate(c) for c in zip(*((f["ts"].to_numpy(), f["price"].to_numpy(float)) for f in frames)))
        order = np.argsort(ts, kind="stable")
        ts, price = ts[order], price[order]
        del order
        kernel, now = Ema(span), np.array(state.get) if state.exists else None
        for i in range(0, len(ts), PIECE):
            out, now = kernel.step(price[i : i + PIECE], now)
            if i + PIECE >= len(ts) and now is not None:
                state.update((float(now[0]),))
            yield pd.DataFrame({"symbol": key[0], "ts": ts[i : i + PIECE], "ema": np.asarray(out)})

    return step


def ema(stream: DataFrame, span: float) -> DataFrame:
    """The exponential average of each symbol's prices; its state is one number.

    Rows of a batch are put in time order: of a symbol's share a task holds two numbers a row, and gives it out in pieces.
    """
    ship(stream.sparkSession)

    got = stream.select("symbol", "ts", "price").groupBy("symbol").applyInPandasWithState(_averaged(span), "symbol string, ts timestamp, ema double", "y double", "append", GroupStateTimeout.NoTimeout)
    return got.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


#: Where typed state with timers and expiry is kept.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ACCOUNT = "cash double, equity double, peak double, fills long"
POSITION = "size double, average double"


class RunProcessor(StatefulProcessor):
    """A backtest run's state in the state store: its account as a value, its positions as a map by symbol, and orders that wait for the next bar as a list. With ttl_ms all of it expires that long after it was last written."""

    def __init__(self, rules: bt.Rules, ttl_ms: int | None = None):
        self.rules, self.ttl_ms = rules, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.account = handle.getValueState("account", ACCOUNT, self.ttl_ms)
        self.positions = handle.getMapState("positions", "symbol string", POSITION, self.ttl_ms)
        self.pending = handle.getListState("pending", bt.ORDER, self.ttl_ms)

    def _load(self) -> bt.State:
        if not self.account.exists():
            return bt.new_state(self.rules)
        cash, equity, peak, fills = self.account.get()
        run = bt.State(cash, equity, peak, fills=fills)
        for (symbol,), (size, average) in self.positions.iterator():
            run.positions[symbol] = size
            if average is not None:
                run.average[symbol] = average
        names = [c.split(" ")[0] for c in bt.ORDER.split(", ")]
        run.pending = [dict(zip(names, o)) for o in self.pending.get()] if self.pending.exists() else []
        return run

    def _keep(self, run: bt.State) -> None:
        self.account.update((run.cash, run.equity, run.peak, run.fills))
        for (symbol,) in list(self.positions.keys()):
            if symbol not in run.positions:
                self.positions.removeKey((symbol,))
        for symbol, size in run.positions.items():
            self.positions.updateValue((symbol,), (size, run.average.get(symbol)))
        if run.pending:
            self.pending.put([tuple(o.get(c.split(" ")[0]) for c in bt.ORDER.split(", ")) for o in run.pending])
        else:
            self.pending.clear()

    def handleInputRows(self, key, rows, timerValues):
        run, out = self._load(), []
        lines = pd.concat(list(rows)).sort_values("ts")
        for ts, bars_, orders in zip(lines["ts"], lines["bars"], lines["orders"]):
            fills, shot = bt.step(run, {b["symbol"]: b for b in json.loads(bars_)}, json.loads(orders) if orders else [], self.rules)
            out += [{"ts": ts, "kind": "fill", **f} for f in fills] + [{"ts": ts, "kind": "equity", **shot}]
        self._keep(run)
        table = pd.DataFrame(out).assign(run_id=key[0]).reindex(columns=[c.split(" ")[0] for c in LINES.split(", ")])
        yield table.astype({c: object for c in ("run_id", "kind", "symbol")})

    def close(self) -> None:
        pass


LINES = "run_id string, ts timestamp, kind string, symbol string, size double, price double, equity double, cash double"


def as_text(lines: DataFrame) -> DataFrame:
    """by_time() rows with bars and orders as JSON, as they travel."""
    return lines.select("run_id", F.col("ts").cast("timestamp").alias("ts"), *[F.to_json(c, {"ignoreNullFields": "false"}).alias(c) for c in ("bars", "orders")])


def backtest(lines: DataFrame, rules: bt.Rules | None = None, ttl_ms: int | None = None) -> DataFrame:
    """The backtest fold over a stream of by_time() rows (run_id, ts, bars, orders; as such or as_text()), each batch later than the one before.

    A run that sees no row for ttl_ms (of processing time) is forgotten, and begins anew if it comes back.
    """
    ship(lines.sparkSession)
    lines.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    text = lines if dict(lines.dtypes)["bars"] == "string" else as_text(lines)
    return text.groupBy("run_id").transformWithStateInPandas(RunProcessor(rules or bt.Rules(), ttl_ms), LINES, "Append", "ProcessingTime" if ttl_ms else "None")


class Monitor(StreamingQueryListener):
    """Writes what a stream observes, a line a batch: stream, batch, rows read and the metrics by name, in the folder `path`."""

    def __init__(self, spark: SparkSession, name: str, path: str):
        self.spark, self.name, self.path, self.ended = spark, name, path, threading.Event()

    def onQueryStarted(self, event):
        pass

    def onQueryIdle(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        if self.name in p.observedMetrics and p.numInputRows:
            seen = {k: None if v is None else str(v) for k, v in p.observedMetrics[self.name].asDict().items()}
            line = self.spark.createDataFrame([(self.name, p.batchId, p.numInputRows, seen)], MONITORED)
            line.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={p.batchId}")  # one that runs again replaces its line

    def onQueryTerminated(self, event):
        self.ended.set()


MONITORED = "stream string, batch long, rows long, metrics map<string,string>"


def watched(stream: DataFrame, name: str, **metrics: Column) -> DataFrame:
    """The stream with aggregates that are observed as its batches pass (see monitored_drain)."""
    return stream.observe(name, *[c.alias(n) for n, c in metrics.items()])


def drain(stream: DataFrame, mode: str, base: str | None = None, at_once: bool = True, once: bool = False) -> DataFrame:
    """Runs a stream over all input there is, and its result as a table.

    A batch has a folder of its own, so one that runs again after a failure replaces its rows; in mode complete each batch
    replaces the whole. base: the folder of result and checkpoint; a stream that is drained again into it goes on where it
    stood. at_once: False for sources that do not say what is available now. once: one batch, for state with timers or expiry,
    whose streams go on with empty batches.
    """
    spark = stream.sparkSession
    base = base or f"{work_dir(spark)}/barspark/stream-{uuid.uuid4().hex[:12]}"

    ran: list[int] = []

    def sink(df, batch):
        df.write.mode("overwrite").parquet(f"{base}/out" if mode == "complete" else f"{base}/out/batch={batch}")
        ran.append(batch)

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").foreachBatch(sink)
    if once:
        writer.trigger(once=True).start().awaitTermination()
    elif at_once:
        writer.trigger(availableNow=True).start().awaitTermination()
    else:
        q = writer.start()
        try:
            q.processAllAvailable()
            begun = time.monotonic()  # the last batch is reported after it has ended, and a stop would come before that
            while ran and time.monotonic() - begun < REPORTED_S and not any(p.batchId == ran[-1] for p in q.recentProgress):
                time.sleep(0.05)
        finally:
            q.stop()
    return _table(spark, f"{base}/out", stream.schema).select(stream.columns)


#: Seconds that a batch's report is waited for.
REPORTED_S = 30


def _table(spark: SparkSession, path: str, schema) -> DataFrame:
    """What was written in a folder; no rows if nothing was."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def monitored_drain(stream: DataFrame, mode: str, name: str, **kwargs) -> tuple[DataFrame, DataFrame]:
    """drain() and the monitor's table (stream, batch, rows, metrics) of a stream that is watched() under that name."""
    spark = stream.sparkSession
    path = f"{work_dir(spark)}/barspark/monitor-{uuid.uuid4().hex[:12]}"
    monitor = Monitor(spark, name, path)
    spark.streams.addListener(monitor)
    try:
        out = drain(stream, mode, **kwargs)
        monitor.ended.wait(60)
    finally:
        spark.streams.removeListener(monitor)
    return out, _table(spark, path, MONITORED).select("stream", "batch", "rows", "metrics")
