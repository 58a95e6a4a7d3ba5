"""Splits and dividends against bars. Actions are sparse beside bars; Spark broadcasts them where they are small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def on_date(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Bars on an action's date, with its columns."""
    return bars.withColumn("date", F.to_date("ts")).join(actions, ["symbol", "date"])


def split_probe(bars: DataFrame, splits: DataFrame, window_days: int = 5) -> DataFrame:
    """symbol, date, ratio, before: the last close in the days before, after: the first from the date on.

    Each split is laid out over its days, which makes the range join an equi-join on the date.
    """
    days = splits.withColumn("_day", F.explode(F.sequence(F.date_sub("date", window_days), F.date_add("date", window_days))))
    near = bars.select("symbol", "ts", "close", F.to_date("ts").alias("_day")).join(days, ["symbol", "_day"])
    near = near.where((F.col("ts") <= F.date_add("date", window_days).cast("timestamp_ntz")))
    early = F.col("_day") < F.col("date")
    return near.groupBy("symbol", "date", "ratio").agg(F.max_by("close", F.when(early, F.col("ts"))).alias("before"), F.min_by("close", F.when(~early, F.col("ts"))).alias("after"))


def detect_adjusted(bars: DataFrame, splits: DataFrame, window_days: int = 5, tolerance: float = 0.25) -> DataFrame:
    """symbol, raw_votes, adjusted_votes, is_adjusted: whether prices jump by the ratio at splits, or do not move."""
    p = split_probe(bars, splits, window_days).where("before > 0 and after > 0").withColumn("_q", F.col("before") / F.col("after"))
    raw = F.abs(F.col("_q") - F.col("ratio")) / F.col("ratio") <= tolerance
    still = F.abs(F.col("_q") - 1) <= tolerance
    votes = p.groupBy("symbol").agg(F.count(F.when(raw, 1)).alias("raw_votes"), F.count(F.when(~raw & still, 1)).alias("adjusted_votes"))
    return votes.withColumn("is_adjusted", F.col("adjusted_votes") > F.col("raw_votes"))


def drop_adjusted(bars: DataFrame, splits: DataFrame, **kwargs) -> DataFrame:
    """Splits of symbols whose prices are not adjusted for them already."""
    done = detect_adjusted(bars, splits, **kwargs).where("is_adjusted").select("symbol")
    return splits.join(done, "symbol", "left_anti")


def back_adjust(bars: DataFrame, splits: DataFrame, columns: tuple[str, ...] = ("open", "high", "low", "close")) -> DataFrame:
    """Prices over the product of all later splits. Bars and splits pass a symbol's time line together once, from its end."""
    s = splits.select("symbol", F.col("date").cast("timestamp_ntz").alias("ts"), F.col("ratio").alias("_ratio"), F.lit(0).alias("_bar"))
    both = bars.withColumn("_bar", F.lit(1)).withColumn("_day", F.to_date("ts").cast("timestamp_ntz"))
    both = both.unionByName(s.withColumn("_day", F.col("ts")), allowMissingColumns=True)
    w = W.partitionBy("symbol").orderBy(F.desc("_day")).rangeBetween(W.unboundedPreceding, W.currentRow)
    # Splits of the same day count in the frame; a bar of that day is already at the new price, so they are taken out.
    day = W.partitionBy("symbol", "_day")
    later = F.coalesce(F.product(F.coalesce("_ratio", F.lit(1.0))).over(w) / F.product(F.coalesce("_ratio", F.lit(1.0))).over(day), F.lit(1.0))
    out = both.withColumn("_later", later).where("_bar = 1")
    return out.select(*[(F.col(c) / F.col("_later")).alias(c) if c in columns else F.col(c) for c in bars.columns])
