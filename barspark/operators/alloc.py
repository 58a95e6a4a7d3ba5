"""Portfolio construction: weights, costs, turnover and optimisers.

Tables of weights are (ts, symbol, weight), or without ts for one portfolio. Optimisers solve a portfolio of
one rebalance in one task: its symbols and their covariance, which is what one problem is.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ship
from .prefix import carried


@dataclass(frozen=True)
class Bounds:
    """Weight limits per symbol, with defaults of [0, 1] (or [-1, 1] unless long_only)."""

    long_only: bool = True
    low: float | None = None
    high: float | None = None
    by_symbol: dict[str, tuple[float, float]] = field(default_factory=dict)

    def __post_init__(self):
        for lo, hi in [self._default(), *self.by_symbol.values()]:
            if lo > hi:
                raise ValueError("a lower bound is above its upper bound")

    def _default(self) -> tuple[float, float]:
        lo, hi = (0.0, 1.0) if self.long_only else (-1.0, 1.0)
        return (lo if self.low is None else self.low, hi if self.high is None else self.high)

    def of(self, symbols: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = [self.by_symbol.get(s, self._default()) for s in symbols]
        return np.array([x[0] for x in each]), np.array([x[1] for x in each])


def with_totals(df: DataFrame, **totals: Column) -> DataFrame:
    """df with aggregates by name: over the rows of each time, or over the whole table (one line, joined to all) where it has no ts."""
    if "ts" in df.columns:
        return df.withColumns({n: c.over(W.partitionBy("ts")) for n, c in totals.items()})
    return df.crossJoin(F.broadcast(df.agg(*[c.alias(n) for n, c in totals.items()])))


def equal_weight(universe: DataFrame, gross: float = 1.0, high: float | None = None) -> DataFrame:
    """gross over the number of symbols; with a limit clipped and scaled back to gross."""
    w = F.lit(gross) / F.col("_n")
    df = with_totals(universe, _n=F.count("*")).withColumn("weight", F.least(w, F.lit(high)) if high is not None else w).drop("_n")
    df = with_totals(df, _total=F.sum("weight"))
    total = F.col("_total")
    return df.withColumn("weight", F.when(total > 0, F.col("weight") * gross / total).otherwise(F.col("weight"))).drop("_total")


def scores_to_weights(scores: DataFrame, column: str = "score") -> DataFrame:
    """Scores above 0 over their sum; equal weights if there are none."""
    v = F.greatest(F.coalesce(column, F.lit(0.0)), F.lit(0.0))
    df = with_totals(scores, _total=F.sum(v), _n=F.count("*"))
    return df.withColumn("weight", F.when(F.col("_total") > 0, v / F.col("_total")).otherwise(F.lit(1.0) / F.col("_n"))).drop("_total", "_n")


def changes(previous: DataFrame, target: DataFrame) -> DataFrame:
    """symbol (and ts), w_prev, w_target, d: a symbol that one side lacks weighs 0 there."""
    key = [c for c in ("ts", "symbol") if c in previous.columns and c in target.columns]
    both = previous.select(*key, F.col("weight").alias("w_prev")).join(target.select(*key, F.col("weight").alias("w_target")), key, "full")
    return both.na.fill(0.0, ["w_prev", "w_target"]).withColumn("d", F.abs(F.col("w_target") - F.col("w_prev")))


def proportional_cost(d: Column, per_dollar: Column | float) -> Column:
    return d * per_dollar


def spread_cost(d: Column, bps: Column | float, participation: float = 1.0) -> Column:
    return d * (0.5 * participation / 1e4) * bps


def impact_cost(d: Column, adv: Column, coefficient: float = 0.1) -> Column:
    """The square root of the change over the volume, times the change. A volume that is not above 0 fails."""
    adv = F.when(adv > 0, adv).otherwise(F.raise_error(F.lit("average daily volume must be above 0")).cast("double"))
    return F.lit(coefficient) * F.sqrt(d / adv) * d


def filled(df: DataFrame, column: str) -> DataFrame:
    """Missing values take the last known one by symbol order, those at the begin the first."""
    known = carried(df, ["symbol"], column, "_known")
    first = df.agg(F.min_by(column, F.when(F.col(column).isNotNull(), F.struct("symbol"))).alias("_first"))
    return known.crossJoin(F.broadcast(first)).withColumn(column, F.coalesce("_known", "_first")).select(*df.columns)  # one line


def turnover(change: DataFrame) -> DataFrame:
    """Sum of absolute changes."""
    return change.groupBy(*[c for c in ("ts",) if c in change.columns]).agg(F.sum("d").alias("turnover"))


def limit_turnover(change: DataFrame, total: float | None = None, each: float | None = None) -> DataFrame:
    """w_prev plus changes clipped per symbol, then scaled to the total."""
    d = F.col("w_target") - F.col("w_prev")
    d = F.greatest(F.least(d, F.lit(each)), F.lit(-each)) if each is not None else d
    df = change.withColumn("_d", d)
    if total is not None:
        df = with_totals(df, _s=F.sum(F.abs("_d")))
        df = df.withColumn("_d", F.when(F.col("_s") > total, F.col("_d") * total / F.col("_s")).otherwise(F.col("_d"))).drop("_s")
    return df.withColumn("weight", F.col("w_prev") + F.col("_d")).drop("_d")


def rebalance_penalty(change: DataFrame, strength: float) -> DataFrame:
    """The target's share is 1 / (1 + strength)."""
    a = 1.0 / (1.0 + strength)
    return change.withColumn("weight", F.col("w_prev") * (1 - a) + F.col("w_target") * a)


def finalize(change: DataFrame, penalty: float | None = None, total: float | None = None, each: float | None = None) -> DataFrame:
    """Penalty, then turnover limits; scaled to sum to 1 only where neither is given."""
    df = change.withColumn("weight", F.col("w_target"))
    if penalty is not None:
        df = rebalance_penalty(df, penalty).withColumn("w_target", F.col("weight"))
    if total is not None or each is not None:
        return limit_turnover(df, total, each)
    if penalty is None:
        df = with_totals(df, _s=F.sum("weight"))
        df = df.withColumn("weight", F.when(F.col("_s") != 0, F.col("weight") / F.col("_s")).otherwise(F.col("weight"))).drop("_s")
    return df


def target_volatility(weights: DataFrame, cov: DataFrame, target: float, max_leverage: float = 1.0) -> DataFrame:
    """Weights times target over their volatility, within max_leverage. cov: a, b, cov (yearly, both halves), with ts where the weights have it."""
    key = [c for c in ("ts",) if c in weights.columns and c in cov.columns]
    a, b = weights.select(*key, F.col("symbol").alias("a"), F.col("weight").alias("wa")), weights.select(*key, F.col("symbol").alias("b"), F.col("weight").alias("wb"))
    var = cov.join(a, [*key, "a"]).join(b, [*key, "b"]).groupBy(*key).agg(F.sum(F.col("wa") * F.col("wb") * F.col("cov")).alias("_var"))
    df = weights.join(var, key) if key else weights.crossJoin(F.broadcast(var))  # one line
    df = with_totals(df, _gross=F.sum(F.abs("weight")))
    scale = F.coalesce(F.try_divide(F.lit(target), F.sqrt("_var")), F.lit(1.0))
    return df.withColumn("_s", F.least(scale, F.coalesce(F.try_divide(F.lit(max_leverage), F.col("_gross")), scale))).withColumn("weight", F.col("weight") * F.col("_s")).drop("_s", "_var", "_gross")


#: Beyond any width of bounds, and small enough to leave weights their digits.
FAR_APART = 1e6


def project(v: np.ndarray, lo: np.ndarray, hi: np.ndarray, total: float = 1.0) -> np.ndarray:
    """The nearest point within bounds whose sum is total: v less a shift found by bisection. Only differences matter, and none beyond FAR_APART does."""
    v = np.clip(v - v.max(), -FAR_APART, 0.0)
    a, b = float((v - hi).min()) - 1, float((v - lo).max()) + 1
    for _ in range(100):
        mid = (a + b) / 2
        if np.clip(v - mid, lo, hi).sum() > total:
            a = mid
        else:
            b = mid
    return np.clip(v - (a + b) / 2, lo, hi)


def _descend(value, slope, lo, hi, start, steps: int = 3000) -> np.ndarray:
    """Projected gradient descent with backtracking."""
    w, size = project(start, lo, hi), 1.0
    now = value(w)
    for _ in range(steps):
        g = slope(w)
        while size > 1e-14:
            new = project(w - size * g, lo, hi)
            then = value(new)
            if then <= now - 1e-4 / max(size, 1e-12) * float(((new - w) ** 2).sum()):
                break
            size /= 2
        if size <= 1e-14 or np.abs(new - w).max() < 1e-12:
            break
        w, now, size = new, then, size * 2
    return w


def deviation(w: np.ndarray, cov: np.ndarray) -> float:
    """The root of w'Cw; 0 where a covariance from few common times makes that negative."""
    return max(float(w @ cov @ w), 0.0) ** 0.5


def min_variance(cov: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    scale = max(float(np.trace(cov)) / len(cov), 1e-300)
    c = cov / scale
    w = _descend(lambda w: float(w @ c @ w), lambda w: 2 * c @ w, lo, hi, np.full(len(cov), 1 / len(cov)))
    for edge in (1e-3, 1e-5, 1e-8):  # then exactly, with the weights at their bounds held there
        free = (w > lo + edge) & (w < hi - edge)
        k = int(free.sum())
        if k:
            held = np.where(w <= lo + edge, lo, hi)[~free]
            system = np.block([[c[np.ix_(free, free)], np.ones((k, 1))], [np.ones((1, k)), np.zeros((1, 1))]])
            right = np.concatenate([-c[np.ix_(free, ~free)] @ held, [1 - held.sum()]])
            new = w.copy()
            new[~free], new[free] = held, np.linalg.lstsq(system, right, rcond=None)[0][:k]
            if (new >= lo - 1e-12).all() and (new <= hi + 1e-12).all() and new @ c @ new <= w @ c @ w + 1e-15:
                w = np.clip(new, lo, hi)
    return w


def max_sharpe(mu: np.ndarray, cov: np.ndarray, lo: np.ndarray, hi: np.ndarray, previous: np.ndarray | None = None, cost: float = 0.0, rf: float = 0.0) -> np.ndarray:
    """Mean less costs over deviation; equal weights if nothing earns more than rf."""
    n = len(mu)
    prev = np.zeros(n) if previous is None else previous

    def value(w):
        earned = float(w @ mu) - rf - cost * float(np.abs(w - prev).sum() if previous is not None else 0.0)
        return -earned / max(deviation(w, cov), 1e-12)

    def slope(w):
        s = max(deviation(w, cov), 1e-12)
        turn = cost * np.sign(w - prev) if previous is not None else 0.0
        earned = float(w @ mu) - rf - cost * float(np.abs(w - prev).sum() if previous is not None else 0.0)
        return -(mu - turn) / s + earned * (cov @ w) / s**3

    start = np.full(n, 1 / n)
    best = _descend(value, slope, lo, hi, start)
    return best if value(best) < 0 else project(start, lo, hi)


def risk_parity(cov: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Equal shares of the variance, by cyclical descent on w'Cw/2 - sum(ln w)/n; where a bound binds, shares as equal as the bounds allow (least squares)."""
    n = len(cov)
    cov = cov + np.diag(np.where(np.diag(cov) > 0, 0.0, 1e-12))
    w = 1 / np.sqrt(np.diag(cov))
    definite = float(np.linalg.eigvalsh((cov + cov.T) / 2).min()) > 0  # else (few common times) the descent has no floor
    for _ in range(500 if definite else 0):
        old = w.copy()
        for i in range(n):
            c = float(cov[i] @ w) - cov[i, i] * w[i]
            w[i] = (-c + (c * c + 4 * cov[i, i] / n) ** 0.5) / (2 * cov[i, i])
        if np.abs(w - old).max() < 1e-12:
            break
    w = w / w.sum()
    start = project(w, lo, hi)
    if definite and np.abs(start - w).max() < 1e-9:
        return w

    def shares(w):
        return w * (cov @ w) / max(float(w @ cov @ w), 1e-300)

    def slope(w):
        c = cov @ w
        v = max(float(w @ c), 1e-300)
        jacobian = (np.diag(c) + w[:, None] * cov) / v - 2 * np.outer(w * c, c) / v**2
        return 2 * jacobian.T @ (shares(w) - 1 / n)

    return _descend(lambda w: float(((shares(w) - 1 / n) ** 2).sum()), slope, lo, hi, start)


def optimise(cov: DataFrame, method: str, bounds: Bounds | None = None, mu: DataFrame | None = None, **options) -> DataFrame:
    """ts, symbol, weight, objective for each rebalance of cov (ts, a, b, cov; both halves). method: min_variance, max_sharpe (needs mu: ts, symbol, mu) or risk_parity."""
    bounds = bounds or Bounds()
    ship(cov.sparkSession)
    rows = cov.select("ts", "a", "b", "cov").where("cov is not null")
    rows = rows.join(mu.select("ts", F.col("symbol").alias("a"), "mu"), ["ts", "a"], "left") if mu is not None else rows.withColumn("mu", F.lit(0.0))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(pdf["a"].unique())
        c = pdf.pivot_table(index="a", columns="b", values="cov").reindex(index=names, columns=names).to_numpy()
        while np.isnan(c).any():  # a symbol whose covariances are not all known cannot be placed
            worst = int(np.isnan(c).sum(1).argmax())
            names.pop(worst)
            c = np.delete(np.delete(c, worst, 0), worst, 1)
        lo, hi = bounds.of(names)
        m = pdf.groupby("a")["mu"].first().reindex(names).fillna(0.0).to_numpy()
        w = {"min_variance": lambda: min_variance(c, lo, hi), "max_sharpe": lambda: max_sharpe(m, c, lo, hi, **options), "risk_parity": lambda: risk_parity(c, lo, hi)}[method]()
        return pd.DataFrame({"ts": pdf["ts"].iloc[0], "symbol": names, "weight": w, "objective": deviation(w, c)})

    return rows.groupBy("ts").applyInPandas(solve, "ts timestamp_ntz, symbol string, weight double, objective double")
