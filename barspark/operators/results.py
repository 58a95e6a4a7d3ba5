"""Analytics of backtest results: equity curves (ts, equity), fills and round-trip trades.

An equity curve belongs to one run; where several are in a table, `run` names the column that tells them apart.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from ..functions.expr import quotient
from ..session import saved
from .prefix import carried, running
from .quantiles import quantiles

YEAR = 252


def _order(run: str | None):
    return W.partitionBy(run).orderBy("ts") if run else W.partitionBy(F.lit(0)).orderBy("ts")


def with_returns(equity: DataFrame, run: str | None = None) -> DataFrame:
    before = F.lag("equity").over(_order(run))
    return equity.withColumn("r", F.try_divide(F.col("equity"), before) - 1)


def drawdown(equity: DataFrame, run: str | None = None) -> DataFrame:
    """drawdown: equity over its maximum so far, less 1; 0 where that is 0."""
    peak = F.max("equity").over(_order(run).rowsBetween(W.unboundedPreceding, 0))
    return equity.withColumn("drawdown", F.coalesce(F.try_divide(F.col("equity"), peak) - 1, F.lit(0.0)))


def summary(equity: DataFrame, run: str | list[str] | None = None, rf: float = 0.0, also: list[Column] | None = None) -> DataFrame:
    """final_equity, total_return, max_drawdown, sharpe, cagr, sortino, bars, and the aggregates of `also`; a line per run (told apart by a column or several)."""
    df = drawdown(with_returns(equity, run), run)
    excess = F.col("r") - rf / YEAR
    first, last, n = F.min_by("equity", "ts"), F.max_by("equity", "ts"), F.count("*")
    std, down = F.stddev_samp(excess), F.stddev_samp(F.when(F.col("r") < 0, F.col("r")))
    root = math.sqrt(YEAR)
    aggs = [
        last.alias("final_equity"),
        F.when(first == 0, F.lit(0.0)).otherwise(F.try_divide(last, first) - 1).alias("total_return"),
        F.min("drawdown").alias("max_drawdown"),
        F.coalesce(F.when(std > 0, F.avg(excess) / std * root), F.lit(0.0)).alias("sharpe"),
        F.coalesce(F.when(first > 0, F.pow(F.try_divide(last, first), F.lit(YEAR) / n) - 1), F.lit(0.0)).alias("cagr"),
        F.coalesce(F.when(down > 0, F.avg(excess) / down * root), F.lit(0.0)).alias("sortino"),
        n.alias("bars"),
        *(also or []),
    ]
    return df.groupBy(run).agg(*aggs) if run else df.agg(*aggs)


def rolling(equity: DataFrame, n: int, run: str | None = None, rf: float = 0.0) -> DataFrame:
    """Over the last n rows, null before there are n returns: rolling_return, rolling_vol, rolling_sharpe; and rolling_drawdown over at most n rows."""
    df = with_returns(equity, run)
    w = _order(run).rowsBetween(-(n - 1), 0)
    full = F.count("r").over(w) == n
    std, root = F.stddev_samp("r").over(w), math.sqrt(YEAR)
    return df.withColumns(
        {
            "rolling_return": F.when(full, F.product(F.lit(1.0) + F.col("r")).over(w) - 1),
            "rolling_vol": F.when(full, std * root),
            "rolling_sharpe": F.when(full, F.try_divide(F.avg("r").over(w) - rf / YEAR, std) * root),
            "rolling_drawdown": F.try_divide(F.col("equity"), F.max("equity").over(w)) - 1,
        }
    )


def rolling_calendar(equity: DataFrame, days: int, run: str | None = None, rf: float = 0.0) -> DataFrame:
    """The same over the last `days` days (begin excluded), from the first return on; volatility is scaled by 252 / days * 252."""
    df = with_returns(equity, run).withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp")))
    key = W.partitionBy(run) if run else W.partitionBy(F.lit(0))
    w = key.orderBy("_us").rangeBetween(-(days * 86_400_000_000 - 1), 0)
    return df.withColumns(
        {
            "rolling_return": F.when(F.count("r").over(w) > 0, F.product(F.lit(1.0) + F.col("r")).over(w) - 1),
            "rolling_vol": F.stddev_samp("r").over(w) * math.sqrt(YEAR / days * YEAR),
            "rolling_sharpe": F.try_divide(F.avg("r").over(w) - rf / YEAR, F.stddev_samp("r").over(w)) * math.sqrt(YEAR),
            "rolling_drawdown": F.try_divide(F.col("equity"), F.max("equity").over(w)) - 1,
        }
    ).drop("_us")


def fill_order() -> list[Column]:
    """The order of a symbol's fills."""
    return [F.col("ts").asc_nulls_last(), F.col("order_id").asc_nulls_last()]


def fifo_trades(fills: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Round trips by first-in-first-out lots, long and short: symbol, entry_time, exit_time, entry_price, exit_price, size, pnl, pnl_pct, duration, direction.

    Fills are intervals on the line of traded quantity. An entry extends the position's absolute quantity and an exit takes
    from the queue's head, so lots are the overlaps of the entries' and the exits' intervals of one side; a fill that
    turns the position round is both. The cost is two sorts of each symbol's fills. Unknown times come last, as in SQL.
    """
    key = [*(by or []), "symbol"]
    upto = W.partitionBy(*key).orderBy(*fill_order()).rowsBetween(W.unboundedPreceding, 0)
    f = fills.where("size <> 0").select(*key, "ts", "order_id", "price", "size")
    f = f.withColumn("_after", F.sum("size").over(upto)).withColumn("_before", F.col("_after") - F.col("size"))
    moves = {}
    for side, sign in (("long", 1), ("short", -1)):
        before, after = F.greatest(F.col("_before") * sign, F.lit(0.0)), F.greatest(F.col("_after") * sign, F.lit(0.0))
        moves |= {f"_in_{side}": F.greatest(after - before, F.lit(0.0)), f"_out_{side}": F.greatest(before - after, F.lit(0.0))}
    f = f.withColumns(moves).withColumns({f"{c}_end": F.sum(c).over(upto) for c in moves})
    # Both kinds of intervals begin at 0 and follow one another without a gap: along the line, each stretch between two beginnings has one entry and one exit.
    stretch = lambda c: F.struct(F.lit(c.endswith("_long")).alias("_long"), F.lit(c.startswith("_in")).alias("_in"), (F.col(f"{c}_end") - F.col(c)).alias("_p"), F.col(f"{c}_end").alias("_end"), F.col(c).alias("_len"))
    starts = f.select(*key, "ts", "price", F.explode(F.filter(F.array(*[stretch(c) for c in moves]), lambda s: s["_len"] > 1e-12)).alias("_s"))
    starts = starts.select(*key, "ts", "price", *[f"_s.{c}" for c in ("_long", "_in", "_p", "_end")])
    cut = W.partitionBy(*key, "_long").orderBy("_p")
    so_far = cut.rowsBetween(W.unboundedPreceding, 0)
    last = lambda own: F.last(F.when(own, F.struct(F.col("ts").alias("t"), F.col("price").alias("p"), F.col("_end").alias("end"))), True).over(so_far)
    lots = starts.select(*key, "_long", "_p", last(F.col("_in")).alias("_e"), last(~F.col("_in")).alias("_x"), F.lead("_p").over(cut).alias("_q"))
    lots = lots.withColumn("size", F.least("_q", "_e.end", "_x.end") - F.col("_p")).where("_e is not null and _x is not null and size > 1e-12")
    lots = lots.select(*key, "_long", F.col("_e.t").alias("entry_time"), F.col("_e.p").alias("entry_price"), F.col("_x.t").alias("exit_time"), F.col("_x.p").alias("exit_price"), "size")
    sign = F.when(F.col("_long"), F.lit(1.0)).otherwise(F.lit(-1.0))
    pnl = (F.col("exit_price") - F.col("entry_price")) * F.col("size") * sign
    growth = (quotient(F.col("exit_price"), F.col("entry_price")) - 1) * sign
    if isinstance(f.schema["ts"].dataType, TimestampNTZType):  # an hour that the session's time zone skips or repeats does not count
        micros = (F.expr("CAST(CAST(exit_time - entry_time AS INTERVAL SECOND) AS DECIMAL(18, 6))") * 1_000_000).cast("long")
    else:
        micros = F.unix_micros(F.col("exit_time").cast("timestamp")) - F.unix_micros(F.col("entry_time").cast("timestamp"))
    days = micros / 86_400_000_000
    side = F.when(F.col("_long"), F.lit("long")).otherwise(F.lit("short"))
    return lots.select(*key, "entry_time", "exit_time", "entry_price", "exit_price", "size", pnl.alias("pnl"), days.alias("duration"), side.alias("direction"), growth.alias("pnl_pct"))


def alternating_trades(fills: DataFrame) -> DataFrame:
    """Round trips of fills that alternate between opening and closing: each closes at the next one."""
    w = W.partitionBy("symbol").orderBy(*fill_order())
    f = fills.withColumns({"_n": F.row_number().over(w), "exit_time": F.lead("ts").over(w), "exit_price": F.lead("price").over(w)})
    return f.where("_n % 2 = 1 and exit_time is not null").select("symbol", F.col("ts").alias("entry_time"), "exit_time", F.col("price").alias("entry_price"), "exit_price", F.abs("size").alias("size"), ((F.col("exit_price") - F.col("price")) * F.col("size")).alias("pnl"))


def by_symbol(trades: DataFrame) -> DataFrame:
    return trades.groupBy("symbol").agg(*_group_aggs())


def by_month(trades: DataFrame) -> DataFrame:
    return trades.groupBy(F.date_trunc("month", "entry_time").cast("timestamp_ntz").alias("month")).agg(*_group_aggs())


def _group_aggs() -> list[Column]:
    return [F.count("*").alias("trades"), F.sum("pnl").alias("total_pnl"), F.avg("pnl").alias("avg_pnl"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"), F.avg("pnl_pct").alias("avg_pnl_pct"), F.avg("duration").alias("avg_duration")]


def trade_summary(trades: DataFrame) -> DataFrame:
    """One line: counts, win rate, averages, expectancy, longest streaks (trades without result neither add nor break), median duration."""
    trades = saved(trades, "trades")
    told = trades.where("pnl <> 0").withColumn("_win", F.col("pnl") > 0)
    told = running(told, "exit_time", ["entry_time", "symbol", "pnl"], {"_won": F.col("_win").cast("long"), "_lost": (~F.col("_win")).cast("long")})
    told = told.withColumn("_island", F.when(F.col("_win"), F.col("_lost")).otherwise(F.col("_won")))  # a streak ends where the other count moves
    runs = told.groupBy("_win", "_island").agg(F.count("*").alias("n"))
    runs = runs.agg(F.coalesce(F.max(F.when(F.col("_win"), F.col("n"))), F.lit(0)).alias("max_wins"), F.coalesce(F.max(F.when(~F.col("_win"), F.col("n"))), F.lit(0)).alias("max_losses"))
    win, loss = F.col("pnl") > 0, F.col("pnl") < 0
    rate = F.avg(win.cast("double"))
    avg_win, avg_loss = F.coalesce(F.avg(F.when(win, F.col("pnl"))), F.lit(0.0)), F.coalesce(F.avg(F.when(loss, F.col("pnl"))), F.lit(0.0))
    whole = trades.agg(F.count("*").alias("trades"), rate.alias("win_rate"), avg_win.alias("avg_win"), avg_loss.alias("avg_loss"), (rate * avg_win + (1 - rate) * avg_loss).alias("expectancy"))
    median = quantiles(trades, [], "duration", [0.5]).select(F.get("q", F.lit(0)).alias("median_duration"))
    return whole.crossJoin(F.broadcast(median)).crossJoin(F.broadcast(runs))  # one line each


def trade_distribution(trades: DataFrame, column: str = "pnl") -> DataFrame:
    """quantile, value at .1 .25 .5 .75 .9, interpolated linearly."""
    points = [0.1, 0.25, 0.5, 0.75, 0.9]
    q = quantiles(saved(trades.select(column), "trades"), [], column, points)
    return q.select(F.posexplode("q").alias("i", "value")).select(F.element_at(F.array(*[F.lit(p) for p in points]), F.col("i") + 1).alias("quantile"), "value")


def size_turnover(trades: DataFrame, unit: str = "month") -> DataFrame:
    """Half the absolute sizes entered in each period, with a line of 0 for empty ones in between."""
    at = F.date_trunc(unit, "entry_time").cast("timestamp_ntz")
    per = trades.groupBy(at.alias("period")).agg((F.sum(F.abs("size")) * 0.5).alias("turnover"))
    ends = per.agg(F.min("period").alias("a"), F.max("period").alias("b"))
    every = ends.where("a is not null").select(F.explode(F.sequence("a", "b", F.expr(f"INTERVAL 1 {unit}"))).alias("period"))
    return every.join(per, "period", "left").select("period", F.coalesce("turnover", F.lit(0.0)).alias("turnover"))


def costs(trades: DataFrame) -> DataFrame:
    """slippage_per_share and cost_per_turnover (fees and slippage over half the sizes); 0 without sizes."""
    shares = F.sum(F.abs("size"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return trades.agg(zero(F.try_divide(F.sum("slippage"), shares)).alias("slippage_per_share"), zero(F.try_divide(F.sum(F.col("fees") + F.col("slippage")), shares * 0.5)).alias("cost_per_turnover"))


def cumulative(trades: DataFrame, columns: tuple[str, ...] = ("pnl",), at: str = "exit_time") -> DataFrame:
    """Running sums along the exits."""
    return running(trades, at, ["symbol", "entry_time"], {f"cum_{c}": F.col(c) for c in columns})


def exposures(snapshots: DataFrame) -> DataFrame:
    """ts (and run_id), symbol, exposure = size * price / equity, from maps of positions and prices."""
    key = [c for c in ("run_id", "ts") if c in snapshots.columns]
    value = F.map_zip_with("positions", "prices", lambda _, q, p: F.coalesce(q * p, F.lit(0.0)))
    return snapshots.select(*key, "equity", F.explode(value).alias("symbol", "value")).select(*key, "symbol", F.coalesce(F.try_divide(F.col("value"), F.col("equity")), F.lit(0.0)).alias("exposure"))


def weight_turnover(weights: DataFrame, value: str = "exposure", times: DataFrame | None = None) -> DataFrame:
    """ts (and run_id), turnover: half the absolute changes of weights from one time to the next; an absent symbol weighs 0. At a symbol's first time nothing changes.

    times: the times there are (and runs), by default those of the weights.
    """
    run = [c for c in ("run_id",) if c in weights.columns]
    every = (times if times is not None else weights).select(*run, "ts").distinct()
    symbols = weights.select(*run, "symbol").distinct()
    grid = every.join(symbols, run) if run else every.crossJoin(symbols)
    w = grid.join(weights, [*run, "ts", "symbol"], "left").withColumn("_w", F.coalesce(value, F.lit(0.0)))
    d = F.abs(F.col("_w") - F.coalesce(F.lag("_w").over(W.partitionBy(*run, "symbol").orderBy("ts")), F.col("_w")))
    return w.withColumn("_d", d).groupBy(*run, "ts").agg((F.sum("_d") * 0.5).alias("turnover"))


def costs_over_time(fills: DataFrame, unit: str = "month") -> DataFrame:
    """run_id, period, fees, traded (absolute value bought and sold) and fee_rate of a run's fills (fee, size, price)."""
    key = [c for c in ("run_id",) if c in fills.columns]
    traded = F.sum(F.abs(F.col("size") * F.col("price")))
    per = fills.groupBy(*key, F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("period")).agg(F.sum("fee").alias("fees"), traded.alias("traded"))
    return per.withColumn("fee_rate", F.coalesce(F.try_divide("fees", "traded"), F.lit(0.0)))


def drift(live: DataFrame, backtest: DataFrame) -> DataFrame:
    """ts, drift: live equity over the backtest's last known (at the same time or before), less 1; 0 where that is 0."""
    both = live.select("ts", "equity", F.lit(None).cast("double").alias("_e"), F.lit(1).alias("_live"))
    both = both.unionByName(backtest.select("ts", F.lit(None).cast("double").alias("equity"), F.col("equity").alias("_e"), F.lit(0).alias("_live")))
    known = carried(both, ["ts", "_live"], "_e", "expected").where("_live = 1")
    return known.select("ts", F.coalesce(F.try_divide(F.col("equity") - F.col("expected"), F.col("expected")), F.lit(0.0)).alias("drift"))
