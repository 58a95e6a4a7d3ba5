"""Signals as Columns over a panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _by_time():
    return W.partitionBy("symbol").orderBy("ts")


def greater_than(a: Column, b) -> Column:
    return F.coalesce(a > b, F.lit(False))


def less_than(a: Column, b) -> Column:
    return F.coalesce(a < b, F.lit(False))


def cross_over(df: DataFrame, a: str, b: str, name: str = "cross_over") -> DataFrame:
    """True where a was below b at the bar before and is above it now."""
    was = F.lag(F.col(a)).over(_by_time()) < F.lag(F.col(b)).over(_by_time())
    return df.withColumn(name, F.coalesce(was & (F.col(a) > F.col(b)), F.lit(False)))


def cross_under(df: DataFrame, a: str, b: str, name: str = "cross_under") -> DataFrame:
    return cross_over(df, b, a, name)


def streak(df: DataFrame, condition: Column, name: str = "streak") -> DataFrame:
    """How many bars in a row the condition has held; 0 where it does not. Bars that break it number the islands."""
    ok = F.coalesce(condition, F.lit(False))
    island = df.withColumn("_ok", ok).withColumn("_island", F.sum((~F.col("_ok")).cast("long")).over(_by_time().rowsBetween(W.unboundedPreceding, 0)))
    held = F.sum(F.col("_ok").cast("long")).over(W.partitionBy("symbol", "_island").orderBy("ts").rowsBetween(W.unboundedPreceding, 0))
    return island.withColumn(name, F.when(F.col("_ok"), held).otherwise(F.lit(0)).cast("long")).drop("_ok", "_island")


def hold(enter: Column, leave: Column, along=None) -> Column:
    """1.0 from a bar that enters until one that leaves, else 0.0; along: the window of a history, a symbol's by time where not given."""
    return F.coalesce(F.last(F.when(enter, F.lit(1.0)).when(leave, F.lit(0.0)), True).over(along or _by_time()), F.lit(0.0))
