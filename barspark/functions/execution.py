"""Execution models: a Column over bars, and the same as a function of one bar for the fold.

A model is a pair (expr, scalar). Bars are given as columns or as a dict of open, high, low, close, volume; size is signed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PriceModel:
    expr: Callable[[], Column]
    scalar: Callable[[dict], float]


def close_price() -> PriceModel:
    return PriceModel(lambda: F.col("close"), lambda b: b["close"])


def open_price() -> PriceModel:
    return PriceModel(lambda: F.col("open"), lambda b: b["open"])


def midpoint() -> PriceModel:
    """Half of high and low, or of open and close where they are missing."""

    def scalar(b):
        return (b["high"] + b["low"]) / 2 if b["high"] is not None and b["low"] is not None else (b["open"] + b["close"]) / 2

    return PriceModel(lambda: F.coalesce((F.col("high") + F.col("low")) / 2, (F.col("open") + F.col("close")) / 2), scalar)


def typical_vwap(column: str | None = None) -> PriceModel:
    """A quarter of open, high, low and close; with column that price where it is given."""

    def scalar(b):
        given = b.get(column) if column else None
        return given if given is not None else (b["open"] + b["high"] + b["low"] + b["close"]) / 4

    mean = lambda: (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4
    return PriceModel(lambda: F.coalesce(F.col(column), mean()) if column else mean(), scalar)


@dataclass(frozen=True)
class SizedModel:
    """A model of size and another number: price for slippage and fees, volume for limits."""

    expr: Callable[[Column, Column], Column]
    scalar: Callable[[float, float | None], float]
    array: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None  # the same over arrays (NaN: missing); without it scalar() is called for each

    def vector(self, size: np.ndarray, other: np.ndarray) -> np.ndarray:
        if self.array is not None:
            return self.array(size, other)
        return np.array([self.scalar(a, None if b != b else b) for a, b in zip(size.tolist(), other.tolist())], float)


def no_slippage() -> SizedModel:
    return SizedModel(lambda size, close: close, lambda size, close: close, lambda size, close: close)


def bps_slippage(bps: float) -> SizedModel:
    """The close, worse by so many hundredths of a per cent."""
    return SizedModel(lambda size, close: close * (1 + F.when(size > 0, F.lit(1.0)).otherwise(F.lit(-1.0)) * (bps / 1e4)), lambda size, close: close * (1 + (1.0 if size > 0 else -1.0) * bps / 1e4), lambda size, close: close * (1 + np.where(size > 0, 1.0, -1.0) * bps / 1e4))


def no_fees() -> SizedModel:
    return SizedModel(lambda size, price: F.lit(0.0), lambda size, price: 0.0, lambda size, price: np.zeros(len(size)))


def per_share_fees(rate: float) -> SizedModel:
    return SizedModel(lambda size, price: F.abs(size) * rate, lambda size, price: abs(size) * rate, lambda size, price: np.abs(size) * rate)


def percentage_fees(rate: float) -> SizedModel:
    return SizedModel(lambda size, price: F.abs(size * price) * rate, lambda size, price: abs(size * price) * rate, lambda size, price: np.abs(size * price) * rate)


def volume_limit(share: float = 1.0) -> SizedModel:
    """At most a share of the bar's volume; nothing without volume."""

    def scalar(size, volume):
        if not volume or volume <= 0:
            return 0.0
        return max(-share * volume, min(share * volume, size))

    return SizedModel(lambda size, volume: F.when(volume > 0, F.greatest(F.least(size, share * volume), -share * volume)).otherwise(F.lit(0.0)), scalar, lambda size, volume: np.where(volume > 0, np.clip(size, -share * volume, share * volume), 0.0))


def triggered(kind: Column, size: Column, limit: Column, stop: Column) -> Column:
    """Whether an order fills on a bar of high and low, and orders that are not triggered lapse."""
    inside = (F.col("low") <= limit) & (limit <= F.col("high"))
    hit = F.when(size > 0, F.col("high") >= stop).when(size < 0, F.col("low") <= stop)
    return F.coalesce(F.when(kind == "MARKET", F.lit(True)).when(kind == "LIMIT", inside).when(kind == "STOP", hit).when(kind == "STOP_LIMIT", hit & inside), F.lit(False))


def trigger_price(kind: Column, limit: Column, stop: Column) -> Column:
    return F.when(kind.isin("LIMIT", "STOP_LIMIT"), limit).when(kind == "STOP", stop).otherwise(F.col("close"))
