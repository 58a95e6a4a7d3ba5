"""Sweeps, walk-forward studies, time splits, bootstrap and search.

A run is a value of a key column, not a process: windows, folds and parameter sets become part of the key that
strategies partition by, so one plan with one scan of the panel evaluates all of them (for a strategy that is a Rule; any
other callable is planned once for each parameter set).
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import results as rs
from ..operators.panel import ordinals
from ..operators.prefix import running
from ..session import saved, ship
from . import backtest as bt
from .strategies import Rule

Strategy = Callable[..., DataFrame]  # (panel, **parameters) -> symbol, ts, weight; a Rule is one too


@dataclass(frozen=True)
class Continuous:
    """A range to draw from, uniformly or in the logarithm."""

    low: float
    high: float
    log: bool = False

    def __post_init__(self):
        if self.low >= self.high or self.log and self.low <= 0:
            raise ValueError("low must be below high, and above 0 in the logarithm")

    def sample(self, rng: np.random.Generator) -> float:
        return float(math.exp(rng.uniform(math.log(self.low), math.log(self.high)))) if self.log else float(rng.uniform(self.low, self.high))


@dataclass
class SearchSpace:
    parameters: dict[str, Sequence | Continuous] = field(default_factory=dict)

    @property
    def size(self) -> int | None:
        """The number of combinations; None if a parameter is continuous."""
        if any(isinstance(v, Continuous) for v in self.parameters.values()):
            return None
        return math.prod(len(v) for v in self.parameters.values())

    def grid(self) -> list[dict]:
        if self.size is None:
            raise ValueError("a continuous parameter has no grid")
        return [dict(zip(self.parameters, c)) for c in itertools.product(*self.parameters.values())]

    def random(self, n: int, seed: int | None = None) -> list[dict]:
        rng = np.random.default_rng(seed)
        return [{k: v.sample(rng) if isinstance(v, Continuous) else v[int(rng.integers(len(v)))] for k, v in self.parameters.items()} for _ in range(n)]


def grid_frame(spark: SparkSession, parameters: dict[str, Sequence]) -> DataFrame:
    """The combinations as a table with a number each, by cross joins of the parameters' values (a line per combination, as asked for)."""
    df = spark.range(1).select()
    df = spark.range(1).drop("id") if not parameters else df
    for name, values in parameters.items():
        df = df.crossJoin(spark.createDataFrame([(v,) for v in values], [name]))
    return df


def runs(rows: DataFrame, strategy: Strategy, combos: list[dict]) -> DataFrame:
    """rows (symbol, ts, close, ...), once for each combination: combo (its number), weight and the equity of the symbol's own long-or-flat run from 1."""
    if not combos:
        raise ValueError("no combination of parameters")
    if isinstance(strategy, Rule):
        held = strategy.each(rows, combos)
    else:
        rows = saved(rows, "sweep-rows")
        parts = [rows.join(strategy(rows, **c), ["symbol", "ts"]).withColumn("combo", F.lit(k)) for k, c in enumerate(combos)]
        held = reduce(DataFrame.unionByName, parts)
    return bt.long_flat(held.withColumnRenamed("weight", "_held"), F.col("_held"), 1.0, ["combo"]).drop("_held")


def portfolio_equity(held: DataFrame, by: list[str]) -> DataFrame:
    """by, ts, equity: the mean of symbols' runs; and trades: how many of them went in or out of their position at that time."""
    w = W.partitionBy("combo", "symbol").orderBy("ts")
    went = (F.col("weight") > 0) != (F.coalesce(F.lag("weight").over(w), F.lit(0.0)) > 0)
    return held.withColumn("_went", went.cast("int")).groupBy(*by, "ts").agg(F.avg("equity").alias("equity"), F.sum("_went").alias("trades"))


@dataclass(frozen=True)
class Metric:
    """value: of a run, from the columns of summary(); score: what is best where it is highest."""

    value: Callable[[], Column]
    score: Callable[[Column], Column] = lambda c: c


#: Metrics by name.
METRICS = {n: Metric(lambda n=n: F.col(n)) for n in ("sharpe", "total_return", "cagr", "sortino", "final_equity")} | {"max_drawdown": Metric(lambda: F.col("max_drawdown"), lambda c: -F.abs(c))}


def metric(name: str | Metric | Callable[[], Column]) -> tuple[Column, Column]:
    """Value and score (more is better) of summary()'s columns; name: one of METRICS, a Metric, or a function that gives the value as a Column."""
    if isinstance(name, str) and name not in METRICS:
        raise ValueError(f"unknown metric {name!r}")
    m = METRICS[name] if isinstance(name, str) else name if isinstance(name, Metric) else Metric(name)
    value = m.value()
    return value, m.score(value)


def sweep(panel: DataFrame, strategy: Strategy, combos: list[dict]) -> DataFrame:
    """combo (number), and summary()'s columns of each combination over the whole panel."""
    return rs.summary(portfolio_equity(runs(panel, strategy, combos), ["combo"]), ["combo"])


def best(results: DataFrame, name: str = "sharpe", key: str = "combo", by: list[str] | None = None) -> DataFrame:
    """The line with the best score; of equals the first combination."""
    _, score = metric(name)
    order = F.max_by(F.struct(*results.columns), F.struct(score.alias("s"), (-F.col(key)).alias("k"))).alias("b")
    return (results.groupBy(*by) if by else results).agg(order).select("b.*")


def windows(panel: DataFrame, train: int, test: int, step: int | None = None) -> DataFrame:
    """The panel's rows once for each window that holds them: window, phase (train or test), and symbol with both before it.

    A window begins every `step` times of the calendar and lies wholly within it; a time's windows follow from its number, so nothing is joined but the calendar.
    """
    if train <= 0 or test <= 0 or step is not None and step <= 0:
        raise ValueError("train, test and step must be above 0")
    step = step or test
    cal = saved(ordinals(panel), "calendar")
    n = cal.count()
    last = (n - train - test) // step
    o = F.col("ordinal")
    first_of = F.greatest(F.ceil((o - (train + test) + 1) / step), F.lit(0)).cast("int")
    last_of = F.least(F.floor(o / step), F.lit(last)).cast("int")
    seq = F.when(first_of <= last_of, F.sequence(first_of, last_of)).otherwise(F.array().cast("array<int>"))
    rows = panel.join(cal, "ts").withColumn("window", F.explode(seq))
    place = F.col("ordinal") - F.col("window") * step
    rows = rows.withColumn("phase", F.when(place < train, F.lit("train")).otherwise(F.lit("test")))
    return rows.withColumn("symbol", F.concat_ws("|", F.col("window").cast("string"), "phase", "symbol")).drop("ordinal")


def walk_forward(panel: DataFrame, strategy: Strategy, combos: list[dict], train: int, test: int, step: int | None = None, name: str | Metric = "sharpe") -> tuple[DataFrame, DataFrame]:
    """(windows, equity): window, combo, metric_value, test_return, test_max_drawdown; and the out-of-sample equity of each window (window, ts, equity).

    Every combination runs on each window's training rows and, apart from them, on its test rows, all in one pass whose
    equity is written once. The first best in training is judged on its test rows.
    """
    value, score = metric(name)
    key = ["window", "phase", "combo"]
    curves = saved(portfolio_equity(runs(windows(panel, train, test, step), strategy, combos), key), "walk-forward")
    of = saved(rs.summary(curves, key), "walk-forward-summary")
    judged = of.where("phase = 'train'").select("window", "combo", value.alias("metric_value"), score.alias("score"))
    chosen = judged.groupBy("window").agg(F.max_by(F.struct("combo", "metric_value"), F.struct("score", (-F.col("combo")).alias("k"))).alias("b")).select("window", "b.*")
    tested = of.where("phase = 'test'").select("window", "combo", F.col("total_return").alias("test_return"), F.col("max_drawdown").alias("test_max_drawdown"))
    equity = curves.where("phase = 'test'").join(chosen.select("window", "combo"), ["window", "combo"], "left_semi").select("window", "ts", "equity")
    return chosen.join(tested, ["window", "combo"], "left"), equity


def chained_equity(out_of_sample: DataFrame) -> DataFrame:
    """The segments of all windows, one after another."""
    return out_of_sample.select("window", "ts", "equity")


def time_splits(panel: DataFrame, folds: int) -> DataFrame:
    """fold, ts, phase: one fold is 70 to 30; k folds train on the first i * (n // (k + 1)) times and test on the next."""
    cal = saved(ordinals(panel), "calendar")
    n = cal.count()
    if folds == 1:
        cut = int(n * 0.7)
        return cal.select(F.lit(0).alias("fold"), "ts", F.when(F.col("ordinal") < cut, "train").otherwise("test").alias("phase"))
    size = n // (folds + 1)
    rows = cal.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    end = (F.col("fold") + 1) * size
    return rows.where(F.col("ordinal") < end + size).select("fold", "ts", F.when(F.col("ordinal") < end, "train").otherwise("test").alias("phase"))


def overfit_penalty(inside: Column, outside: Column, parameters: int | Column, observations: Column) -> Column:
    gap = F.greatest(inside - outside, F.lit(0.0)) / 2
    count = parameters if isinstance(parameters, Column) else F.lit(float(parameters))
    return gap + F.coalesce(F.when(observations > 0, count * F.ln(observations) / (2 * observations)), F.lit(0.0))


def stability_penalty(score: Column) -> Column:
    """An aggregate over folds: a tenth of deviation (population) over the mean's size."""
    std, mean = F.stddev_pop(score), F.avg(score)
    return F.coalesce(F.when((F.count(score) >= 2) & (F.abs(mean) >= 1e-8), 0.1 * std / F.abs(mean)), F.lit(0.0))


@dataclass(frozen=True)
class Evaluation:
    """How candidates are judged: the metric, the folds (expanding splits of time), the fewest trades a fold's test rows must have, and which penalties count."""

    name: str | Metric = "sharpe"
    folds: int = 3
    min_trades: int = 0
    overfit: bool = True
    stability: bool = True


def evaluate(panel: DataFrame, strategy: Strategy, combos: list[dict], how: Evaluation | None = None, parameters: int | None = None) -> DataFrame:
    """combo, in_sample, out_of_sample, overfit, stability, score, trades, folds: means over the folds that have min_trades, less penalties.

    A combination without such a fold scores minus infinity and has null means; penalties that are switched off are 0. folds
    counts those that have the trades, trades is the sum over all. parameters: how many the overfit penalty counts, by default the combination's.
    """
    how = how or Evaluation()
    split = time_splits(panel, how.folds)
    rows = panel.join(split, "ts").withColumn("symbol", F.concat_ws("|", F.col("fold").cast("string"), "phase", "symbol"))
    _, score = metric(how.name)
    key = ["combo", "fold", "phase"]
    curves = portfolio_equity(runs(rows, strategy, combos), key)
    of = rs.summary(curves, key, also=[F.sum("trades").alias("trades")]).withColumn("v", score)
    at = lambda phase, c: F.max(F.when(F.col("phase") == phase, F.col(c)))
    per = of.groupBy("combo", "fold").agg(at("train", "v").alias("i"), at("test", "v").alias("o"), at("test", "bars").alias("bars"), at("test", "trades").alias("t"))
    enough = F.col("t") >= how.min_trades
    judged = lambda c: F.when(enough, F.col(c))
    all_ = per.groupBy("combo").agg(F.avg(judged("i")).alias("in_sample"), F.avg(judged("o")).alias("out_of_sample"), F.sum("bars").alias("n"), stability_penalty(judged("o")).alias("stability"), F.sum("t").alias("trades"), F.count(F.when(enough, 1)).alias("folds"))
    sizes = F.get(F.array(*[F.lit(float(len(c) if parameters is None else parameters)) for c in combos]), F.col("combo"))
    none = F.lit(0.0)
    all_ = all_.withColumn("overfit", overfit_penalty(F.col("in_sample"), F.col("out_of_sample"), sizes, F.col("n")) if how.overfit else none)
    all_ = all_.withColumn("stability", F.col("stability") if how.stability else none)
    total = F.coalesce(F.col("out_of_sample") - F.col("overfit") - F.col("stability"), F.lit(float("-inf")))
    return all_.withColumn("score", total).select("combo", "in_sample", "out_of_sample", "overfit", "stability", "score", "trades", "folds")


def ranked(evaluated: DataFrame) -> DataFrame:
    return evaluated.orderBy(F.desc("score"), "combo")


def grid_search(panel: DataFrame, strategy: Strategy, space: SearchSpace, how: Evaluation | None = None) -> DataFrame:
    """evaluate() of every combination of the space and its parameters (a column each, as text), best first."""
    return _searched(panel, strategy, space.grid(), how)


def random_search(panel: DataFrame, strategy: Strategy, space: SearchSpace, n: int, seed: int | None = None, how: Evaluation | None = None) -> DataFrame:
    """evaluate() of n combinations drawn from the space, best first."""
    return _searched(panel, strategy, space.random(n, seed), how)


def _searched(panel: DataFrame, strategy: Strategy, combos: list[dict], how: Evaluation | None) -> DataFrame:
    found = evaluate(panel, strategy, combos, how)
    own = [F.get(F.array(*[F.lit(str(c[p])) for c in combos]), F.col("combo")).alias(p) for p in combos[0]]
    return ranked(found.select("*", *own))


#: Returns that are sent whole to every task (8 bytes each); a longer curve's are joined instead.
SENT = 1 << 21


def bootstrap(equity: DataFrame, samples: int, seed: int = 0, sent: int = SENT) -> DataFrame:
    """sample, total_return, max_drawdown of equity curves whose returns are drawn with replacement.

    A draw's place comes from an MD5 of seed, sample and position, so any executor repeats it. Of a curve of up to `sent` returns
    every task draws its samples from a copy; the draws of a longer one meet the numbered returns in an equi-join.
    """
    spark = equity.sparkSession
    ship(spark)
    at = saved(equity.select("ts", "equity").join(ordinals(equity), "ts").select(F.col("ordinal").cast("long").alias("i"), "equity"), "bootstrap-curve")
    before = at.select((F.col("i") + 1).alias("i"), F.col("equity").alias("_b"))
    r = at.join(before, "i").select((F.col("i") - 1).alias("i"), (F.try_divide("equity", "_b") - 1).alias("r"))
    if r.where("r is null").isEmpty():
        numbered = saved(r, "bootstrap-returns")
    else:  # what is missing takes no number
        numbered = saved(running(r.where("r is not null"), "i", [], {"_n": F.lit(1)}).select((F.col("_n") - 1).cast("long").alias("i"), "r"), "bootstrap-returns")
    n = numbered.count()
    if n <= sent:
        drawn = spark.sparkContext.broadcast(np.array([x["r"] for x in numbered.orderBy("i").collect()], float))  # `sent` at most
        return spark.range(0, samples, 1, max(1, min(samples, spark.sparkContext.defaultParallelism * 4))).mapInArrow(_draws(drawn, n, seed), "sample long, total_return double, max_drawdown double")
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), "sample", "position"))
    u = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    draws = spark.range(samples * n).select(F.floor(F.col("id") / n).alias("sample"), (F.col("id") % n).alias("position"))
    draws = draws.withColumn("i", F.floor(u * n)).join(numbered, "i")
    w = W.partitionBy("sample").orderBy("position").rowsBetween(W.unboundedPreceding, 0)
    e = draws.withColumn("e", F.product(F.lit(1.0) + F.col("r")).over(w))
    e = e.withColumn("d", F.col("e") / F.greatest(F.max("e").over(w), F.lit(1.0)) - 1)
    return e.groupBy("sample").agg((F.max_by("e", "position") - 1).alias("total_return"), F.min("d").alias("max_drawdown"))


def _draws(returns, n: int, seed: int):
    def run(batches):
        r = returns.value
        for batch in batches:
            out = []
            for s in batch.column(0).to_pylist() if n else ():
                head = f"{seed}|{s}|".encode()
                u = np.array([int(hashlib.md5(head + str(p).encode()).hexdigest()[:13], 16) for p in range(n)], np.float64) / (1 << 52)
                e = np.cumprod(1.0 + r[np.floor(u * n).astype(np.int64)])
                out.append((s, e[-1] - 1, (e / np.maximum(np.maximum.accumulate(e), 1.0) - 1).min()))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.float64(), pa.float64()))], names=["sample", "total_return", "max_drawdown"])

    return run


def multi_start(panel: DataFrame, strategy: Strategy, times: int, **parameters) -> DataFrame:
    """Equal runs, `times` of them: their number, mean and best final equity. An equal run is a combination of equal parameters."""
    s = sweep(panel, strategy, [parameters] * times)
    return s.agg(F.count("*").alias("runs"), F.avg("final_equity").alias("mean_final"), F.max("final_equity").alias("best_final"))
