"""Readers of market files: OHLCV bars in CSV or Parquet, splits, dividends and events.

Everything is lazy: columns are renamed by synonym, parsed with try_cast, and rows that cannot be
read are filtered; sorting is left to the sink. Missing is NULL.
"""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Accepted names of each column.
SYNONYMS = {
    "ts": ["datetime", "date", "timestamp", "time", "ts"],
    "open": ["open", "o", "opening"],
    "high": ["high", "h"],
    "low": ["low", "l"],
    "close": ["close", "c", "last", "closing"],
    "volume": ["volume", "v", "vol", "volumne"],
    "adj_close": ["adj_close", "adj close", "adjclose", "adjusted_close", "adjusted close"],
    "symbol": ["symbol", "sym", "ticker"],
}
SPLIT_SYNONYMS = {"symbol": SYNONYMS["symbol"], "date": ["date", "datetime", "timestamp"], "ratio": ["ratio", "split_ratio", "split"]}
DIVIDEND_SYNONYMS = {"symbol": SYNONYMS["symbol"], "date": ["date", "datetime", "timestamp"], "amount": ["amount", "dividend", "div", "dividend_per_share"]}
EVENT_SYNONYMS = {"ts": ["timestamp", "ts", "datetime", "date", "time"], "type": ["type", "event_type", "event"], "symbol": SYNONYMS["symbol"]}
PRICES = ("open", "high", "low", "close")


def renamed(df: DataFrame, synonyms: dict[str, list[str]], required: tuple[str, ...]) -> dict[str, Column]:
    """canonical name -> column, for those that df has under any of their names; of several names the first that is not null."""
    have = {c.strip().lower(): c for c in df.columns}
    found = {}
    for name, others in synonyms.items():
        match = [F.col("`" + have[o].replace("`", "``") + "`") for o in others if o in have]
        if match:
            found[name] = match[0] if len(match) == 1 else F.coalesce(*[m.cast("string") for m in match])
    missing = [r for r in required if r not in found]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return found


def number(c: Column) -> Column:
    """A double; what does not parse, and NaN, is null."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def timestamp(c: Column, tz: str | None = None) -> Column:
    """A timestamp without zone; with tz the wall clock of that zone, turned to UTC."""
    x = c.try_cast("timestamp_ntz")
    return F.convert_timezone(F.lit(tz), F.lit("UTC"), x) if tz else x


def normalize(df: DataFrame, tz: str | None = None, volume_required: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Canonical bars, and the columns to keep. Rows without a time or with a missing number go; adj_close, where present, becomes close and the quoted price close_raw."""
    cols = renamed(df, SYNONYMS, ("ts", *PRICES, *(("volume",) if volume_required else ())))
    fields = {n: number(cols[n]) for n in ("open", "high", "low", "close", "volume", "adj_close") if n in cols}
    if "adj_close" in fields:
        fields["close_raw"] = fields["close"]
        fields["close"] = fields.pop("adj_close")
    own = [cols["symbol"].alias("symbol")] if "symbol" in cols else []
    out = df.select(*own, *keep, timestamp(cols["ts"], tz).alias("ts"), *[c.alias(n) for n, c in fields.items()])
    return out.na.drop(subset=["ts", *fields])


def infer_symbol(name: Column) -> Column:
    """The part of a file's name before the first of _ - . in upper case."""
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    return F.upper(F.split(base, r"[_\-.]")[0])


def symbol_of(path: str) -> str:
    return re.split(r"[_\-.]", re.split(r"[/\\]", path)[-1])[0].upper()


def load_csv(spark: SparkSession, path: str, symbol: str | None = None, tz: str | None = None) -> DataFrame:
    """Bars of one CSV with a header; a vendor's row of symbols under it has no time and goes."""
    raw = spark.read.option("header", True).csv(path)
    return normalize(raw, tz).withColumn("symbol", F.lit((symbol or symbol_of(path)).upper()))


def load_parquet(spark: SparkSession, path: str, symbol: str | None = None, tz: str | None = None) -> DataFrame:
    return normalize(spark.read.parquet(path), tz).withColumn("symbol", F.lit((symbol or symbol_of(path)).upper()))


def _files(spark: SparkSession, path: str) -> list[str]:
    """Paths of a folder's CSV and Parquet files (whatever the case of their ends), as Spark lists them; no content is read."""
    listed = spark.read.format("binaryFile").load(path).select("path").where(F.lower("path").rlike(r"\.(csv|parquet)$"))
    return sorted(r["path"] for r in listed.collect())


#: Files whose first lines are asked for at once.
OPENED = 32


def first_line(spark: SparkSession, file: str) -> str:
    """A file's first line, from whatever store Spark reads: the file is opened and read no further than a buffer."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(file)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where), "UTF-8"))
    try:
        return (reader.readLine() or "").removeprefix("\ufeff")
    finally:
        reader.close()


def _by_header(spark: SparkSession, files: list[str]) -> list[list[str]]:
    """CSV files in groups of one first line each. The lines (one a file, as its path is) come to the driver, many at a time."""
    groups: dict[str, list[str]] = {}
    with ThreadPoolExecutor(OPENED) as pool:
        for file, line in zip(files, pool.map(lambda f: first_line(spark, f), files)):
            groups.setdefault(line, []).append(file)
    return [sorted(g) for _, g in sorted(groups.items())]


def load_directory(spark: SparkSession, path: str, kind: str | None = None, symbols: list[str] | None = None, tz: str | None = None, start=None, end=None) -> DataFrame:
    """Bars of every CSV and Parquet file of a folder (of one kind, if named), the symbol from the file's name. Of two files of one symbol the last name wins.

    symbols leave out files before any is opened; start and end bound the times of rows, both included. Each CSV file is read
    by its own header: files with one header make a scan, and the scans are united by name. Parquet files are one scan by
    column names. A column's type may differ between Parquet files as far as Spark merges it.
    """
    ends = lambda f, k: f.lower().endswith(f".{k}")
    chosen = {symbol_of(f): f for f in _files(spark, path) if kind is None or ends(f, kind.lower())}
    wanted = None if symbols is None else {s.upper() for s in symbols}
    files = sorted(f for s, f in chosen.items() if wanted is None or s in wanted)
    tables, parquet = [f for f in files if ends(f, "csv")], [f for f in files if ends(f, "parquet")]
    parts = [_bars_of_files(spark.read.option("header", True).csv(group), tz) for group in (_by_header(spark, tables) if tables else [])]
    if parquet:
        parts.append(_bars_of_files(spark.read.option("mergeSchema", True).parquet(*parquet), tz))
    if not parts:
        raise ValueError(f"no bars in {path}")
    out = reduce(lambda a, b: a.unionByName(b), parts)
    bounds = [F.col("ts") >= F.lit(start).cast("timestamp_ntz")] * (start is not None) + [F.col("ts") <= F.lit(end).cast("timestamp_ntz")] * (end is not None)
    return reduce(DataFrame.where, bounds, out)


def _bars_of_files(raw: DataFrame, tz: str | None) -> DataFrame:
    """Canonical bars with close_raw (the quoted price, where it is not the close) and the symbol of their file."""
    named = raw.select(*[F.col(f"`{c}`") for c in raw.columns if c.strip().lower() not in SYNONYMS["symbol"]], F.col("_metadata.file_name").alias("_file"))
    bars = normalize(named, tz, keep=("_file",))
    quoted = F.col("close_raw") if "close_raw" in bars.columns else F.lit(None).cast("double")
    return bars.select(infer_symbol(F.col("_file")).alias("symbol"), "ts", *PRICES, "volume", quoted.alias("close_raw"))


def load_splits(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    """symbol, date, ratio. Running it fails on a ratio that is not above 0."""
    raw = spark.read.option("header", True).csv(path)
    cols = renamed(raw, SPLIT_SYNONYMS, ("date", "ratio"))
    who = F.upper(cols["symbol"]) if "symbol" in cols else F.lit((symbol or symbol_of(path)).upper())
    out = raw.select(who.alias("symbol"), F.to_date(timestamp(cols["date"])).alias("date"), number(cols["ratio"]).alias("ratio")).na.drop()
    return out.withColumn("ratio", F.when(F.col("ratio") > 0, F.col("ratio")).otherwise(F.raise_error(F.lit("split ratio must be above 0")).cast("double")))


def load_dividends(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    cols = renamed(raw, DIVIDEND_SYNONYMS, ("date", "amount"))
    who = F.upper(cols["symbol"]) if "symbol" in cols else F.lit((symbol or symbol_of(path)).upper())
    return raw.select(who.alias("symbol"), F.to_date(timestamp(cols["date"])).alias("date"), number(cols["amount"]).alias("amount")).na.drop()


def events(raw: DataFrame, tz: str | None = None) -> DataFrame:
    """ts, type, symbol, payload: a map of the other columns' values without nulls, or null if there are none."""
    cols = renamed(raw, EVENT_SYNONYMS, ("ts", "type"))
    used = {o for v in EVENT_SYNONYMS.values() for o in v}
    others = [c for c in raw.columns if c.strip().lower() not in used]
    pairs = [x for c in others for x in (F.lit(c.strip().lower()), F.col(f"`{c}`").cast("string"))]
    payload = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.lit(None).cast("map<string,string>")
    payload = F.when(F.size(payload) > 0, payload) if pairs else payload
    who = F.upper(F.nullif(F.trim(cols["symbol"]), F.lit(""))) if "symbol" in cols else F.lit(None).cast("string")
    return raw.select(timestamp(cols["ts"], tz).alias("ts"), cols["type"].alias("type"), who.alias("symbol"), payload.alias("payload")).where("ts is not null and type is not null")


def load_events(spark: SparkSession, path: str, tz: str | None = None) -> DataFrame:
    return events(spark.read.option("header", True).csv(path), tz)


def from_pandas(spark: SparkSession, frame, symbol: str) -> DataFrame:
    """A pandas frame whose times are its index or a column."""
    if frame.index.name or frame.index.dtype.kind == "M":
        frame = frame.rename_axis(frame.index.name or "datetime").reset_index()
    return normalize(spark.createDataFrame(frame), volume_required=False).withColumn("symbol", F.lit(symbol.upper()))


def from_arrow(spark: SparkSession, table, symbol: str) -> DataFrame:
    """An Arrow table, or a frame that gives one (to_arrow(), as polars' do, or the Arrow stream protocol), with a column of times."""
    import pyarrow as pa

    if not isinstance(table, pa.Table):
        table = table.to_arrow() if hasattr(table, "to_arrow") else pa.table(table)
    return normalize(spark.createDataFrame(table), volume_required=False).withColumn("symbol", F.lit(symbol.upper()))
