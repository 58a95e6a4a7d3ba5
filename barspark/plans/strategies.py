"""Strategies as target weights of a panel: symbol, ts, weight. Only fills are left to a fold."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import factors as fx
from ..functions.expr import Expr, col, compile
from ..operators import filters, signals
from ..operators import panel as pn
from ..sources import bars as bars_of
from . import custom


def _cross() -> W:
    return W.partitionBy("ts")


def buy_and_hold(panel: DataFrame) -> DataFrame:
    """An equal share of every symbol there is at a time."""
    return panel.select("symbol", "ts", (F.lit(1.0) / F.count("*").over(_cross())).alias("weight"))


@dataclass(frozen=True)
class Rule:
    """A strategy of symbols by themselves, in two parts, so that a sweep evaluates any number of parameter sets in one scan.

    features: parameters -> expressions by name. decide: the window of a history (a symbol's rows in time order), the
    features' Columns and the parameters that features() does not name as `values` -> the target weight.
    """

    features: Callable[..., dict[str, Expr]]
    decide: Callable[..., Column]
    values: Callable[..., dict[str, float]] = lambda **_: {}

    def __call__(self, panel: DataFrame, **parameters) -> DataFrame:
        df = compile(panel, self.features(**parameters))
        held = {n: F.col(n) for n in df.columns[2:]} | {n: F.lit(float(v)) for n, v in self.values(**parameters).items()}
        return df.select("symbol", "ts", self.decide(W.partitionBy("symbol").orderBy("ts"), **held).alias("weight"))

    def each(self, panel: DataFrame, combos: list[dict]) -> DataFrame:
        """The panel's rows once for each combination, with its number, `combo`, and its target weight.

        Equal features of several combinations are computed once; the combinations are rows of an array that is exploded.
        """
        names, exprs, lines = {}, {}, []
        for k, combo in enumerate(combos):
            of = self.features(**combo)
            for e in of.values():
                exprs.setdefault(names.setdefault(e.key, f"_f{len(names)}"), e)
            values = {n: F.lit(float(v)) for n, v in self.values(**combo).items()}
            lines.append(F.struct(F.lit(k).alias("combo"), *[F.col(names[e.key]).cast("double").alias(n) for n, e in of.items()], *[v.alias(n) for n, v in values.items()]))
        df = compile(panel, exprs, keep=panel.columns).withColumn("_c", F.explode(F.array(*lines))).drop(*exprs)
        held = [n for n in df.schema["_c"].dataType.names if n != "combo"]
        df = df.select(*panel.columns, "_c.combo", *[F.col(f"_c.{n}").alias(f"_v_{n}") for n in held])
        weight = self.decide(W.partitionBy("combo", "symbol").orderBy("ts"), **{n: F.col(f"_v_{n}") for n in held})
        return df.withColumn("weight", weight).drop(*[f"_v_{n}" for n in held])


#: Parameters: fast and slow, widths of two averages.
sma_crossover = Rule(
    lambda fast=10, slow=30: {"f": fx.sma(fast), "s": fx.sma(slow)},
    lambda along, f, s: signals.hold(f > s, f < s, along),
)

#: Parameters: n, and the levels below which it enters and above which it leaves.
rsi_reversion = Rule(
    lambda n=14, enter=30, leave=70: {"r": fx.rsi(n)},
    lambda along, r, enter, leave: signals.hold(r < enter, r > leave, along),
    lambda n=14, enter=30, leave=70: {"enter": enter, "leave": leave},
)


def breakout(panel: DataFrame, period: int = 20, bars: int = 3) -> DataFrame:
    """Equal weights of symbols whose close has been above its average for `bars` bars; none in a symbol's first `period` bars."""
    df = compile(panel, {"close": col("close"), "m": fx.sma(period)})
    df = signals.streak(df, F.col("close") > F.col("m"))
    place = F.row_number().over(W.partitionBy("symbol").orderBy("ts"))
    df = df.withColumn("active", ((F.col("streak") >= bars) & (place > period)).cast("double"))
    return df.select("symbol", "ts", F.coalesce(F.try_divide(F.col("active"), F.sum("active").over(_cross())), F.lit(0.0)).alias("weight"))


def weekly_trend(daily: DataFrame) -> DataFrame:
    """1 while the close is above the close of the last week that has ended."""
    weeks = bars_of.resample(daily, "1W").select("symbol", (F.col("ts") + F.expr("INTERVAL 1 DAY")).cast("timestamp_ntz").alias("known"), F.col("close").alias("week"))
    got = pn.asof(daily.select("symbol", "ts", "close"), weeks, ["symbol"], right_on="known")
    return got.select("symbol", "ts", F.coalesce((F.col("close") > F.col("week")).cast("double"), F.lit(0.0)).alias("weight"))


def top_momentum(panel: DataFrame, lookback: int = 63, n: int = 5, period: str = "1M") -> DataFrame:
    """At the first bar of each period, weights in proportion to the positive momentum of the n strongest (equal if none is positive)."""
    df = compile(panel, {"v": fx.momentum(lookback)})
    order = F.row_number().over(_cross().orderBy(F.col("v").desc_nulls_last(), "symbol"))
    days = panel.select("ts").distinct().withColumn("p", {"1M": F.date_trunc("month", "ts"), "1W": F.date_trunc("week", "ts"), "1D": F.date_trunc("day", "ts")}[period])
    starts = days.groupBy("p").agg(F.min("ts").alias("ts")).select("ts")
    df = df.join(starts, "ts", "left_semi").withColumn("_n", order).where((F.col("_n") <= n) & F.col("v").isNotNull())
    score = F.greatest("v", F.lit(0.0))
    total, k = F.sum(score).over(_cross()), F.count("*").over(_cross())
    return df.select("symbol", "ts", F.when(total > 0, score / total).otherwise(F.lit(1.0) / k).alias("weight"))


def low_volatility(panel: DataFrame, n: int = 63, percent: float = 30.0) -> DataFrame:
    """Equal weights of the quietest per cent at each time."""
    screen = filters.low_volatility(percentile=percent, window=n)
    key = next(iter(screen.needs()))
    df = compile(panel, {"v": screen.needs()[key]}).withColumn("on", screen.mask({key: "v"}).cast("double"))
    return df.select("symbol", "ts", F.coalesce(F.try_divide(F.col("on"), F.sum("on").over(_cross())), F.lit(0.0)).alias("weight"))


def composite(parts: dict[str, tuple[float, Expr]]) -> Expr:
    """A weighted sum of cross-sectional z-scores."""
    total = None
    for weight, e in parts.values():
        total = weight * e.zscore() if total is None else total + weight * e.zscore()
    return total


def style_score(panel: DataFrame, n: int = 20) -> DataFrame:
    """0.4 momentum + 0.3 trend - 0.2 volatility + 0.1 low volatility, each as a z-score."""
    e = composite({"m": (0.4, fx.momentum(n)), "t": (0.3, fx.trend_slope(n)), "v": (-0.2, fx.volatility(n)), "l": (0.1, fx.low_volatility(n))})
    return compile(panel, {"score": e})


def daily_signal_intraday(intraday: DataFrame, n: int = 20) -> DataFrame:
    """Decided at a day's last bar against the average of n daily closes, filled at the next bar's open: symbol, ts of the decision, weight, fill_price."""
    daily = bars_of.resample(intraday, "1D")
    full = F.count("close").over(W.partitionBy("symbol").orderBy("ts").rowsBetween(-(n - 1), 0)) == n
    average = compile(daily, {"m": fx.sma(n), "close": col("close")}).withColumn("m", F.when(full, F.col("m")))
    average = average.select("symbol", (F.col("ts") + F.expr("INTERVAL 1 DAY")).cast("timestamp_ntz").alias("known"), "m")
    w = W.partitionBy("symbol").orderBy("ts")
    df = intraday.select("symbol", "ts", "close", F.lead("open").over(w).alias("fill_price"), pn.at_close().alias("last"))
    df = pn.asof(df, average, ["symbol"], right_on="known")
    return df.where("last and m is not null").select("symbol", "ts", (F.col("close") > F.col("m")).cast("double").alias("weight"), "fill_price")


def regime_rotation(panel: DataFrame, fast: int = 10, slow: int = 250, bars: int = 3) -> DataFrame:
    """A three-state automaton per symbol, see custom.RegimeRotation."""
    df = compile(panel, {"close": col("close"), "f": fx.sma(fast), "s": fx.sma(slow)})
    return custom.weights(df, custom.RegimeRotation, bars=bars)


def event_hold(panel: DataFrame, events: DataFrame, look_back: str = "3 DAYS", bars: int = 2) -> DataFrame:
    """1 from a bar that sees an event in the look-back until `bars` bars later; see custom.EventHold."""
    df = pn.has_event(panel.select("symbol", "ts"), events, look_back).withColumnRenamed("has_event", "seen")
    return custom.weights(df, custom.EventHold, bars=bars)
