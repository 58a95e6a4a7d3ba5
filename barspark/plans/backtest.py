"""Backtests: a fold of cash and positions over bars and orders, many runs at a time.

Orders are made declaratively, as a table; what is left to fold is cash, positions and fills.
Bars and orders of one time come together as one row. In a stream a run's rows pass through
step(), one by one, with state in the state store; the batch runner folds many runs in
lockstep (module lockstep), a batch and the state of a lane of runs at a time.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import execution as ex
from ..session import ship

TINY = 1e-12
OUTPUT = "run_id string, ts timestamp_ntz, kind string, symbol string, order_id long, size double, price double, fee double, equity double, cash double, positions_value double, leverage double, pnl double, drawdown double"


@dataclass(frozen=True)
class Rules:
    """How orders become fills. A price model, if given, replaces slippage."""

    capital: float = 100_000.0
    max_symbol_weight: float = 1.0
    max_gross_leverage: float = 1.0
    price: ex.PriceModel | None = None
    slippage: ex.SizedModel = field(default_factory=ex.no_slippage)
    fees: ex.SizedModel = field(default_factory=ex.no_fees)
    volume: ex.SizedModel = field(default_factory=ex.volume_limit)
    next_open: bool = False  # orders wait for the next bar


@dataclass
class State:
    cash: float
    equity: float
    peak: float
    positions: dict[str, float] = field(default_factory=dict)
    average: dict[str, float] = field(default_factory=dict)
    pending: list[dict] = field(default_factory=list)
    fills: int = 0


def new_state(rules: Rules) -> State:
    return State(rules.capital, rules.capital, rules.capital)


def clamp_targets(weights: dict[str, float], rules: Rules) -> dict[str, float]:
    """Each weight within the symbol's limit, then all scaled to the gross limit."""
    w = max(rules.max_symbol_weight, 0.0)
    out = {s: max(-w, min(w, x)) if w > 0 else x for s, x in weights.items()}
    gross, most = sum(abs(x) for x in out.values()), max(rules.max_gross_leverage, 0.0)
    return {s: x * most / gross for s, x in out.items()} if 0 < most < gross else out


def apply_fill(state: State, symbol: str, size: float, price: float, fee: float) -> None:
    """Cash and position after a fill: purchases average the price, sales keep it, a position of nothing goes."""
    held = state.positions.get(symbol, 0.0)
    now = held + size
    if size > 0 and now != 0:
        state.average[symbol] = (held * state.average.get(symbol, 0.0) + size * price) / now
    state.positions[symbol] = now
    if abs(now) < 1e-10:
        state.positions.pop(symbol)
        state.average.pop(symbol, None)
    state.cash -= size * price + fee


def step(state: State, bars: dict[str, dict], orders: list[dict], rules: Rules) -> tuple[list[dict], dict]:
    """One time: corporate actions, orders in turn (target weights first), then the mark to market. Changes state; gives fills and the snapshot."""
    for s, b in bars.items():
        if b.get("split") and s in state.positions:
            state.positions[s] *= b["split"]
            state.average[s] = state.average.get(s, 0.0) / b["split"]
        if b.get("dividend") and s in state.positions:
            state.cash += state.positions[s] * b["dividend"]
    if rules.next_open:
        orders, state.pending = state.pending, orders
    close = {s: b["close"] for s, b in bars.items()}
    fills: list[dict] = []

    def allowed(s: str, size: float) -> float:
        size = rules.volume.scalar(size, bars[s].get("volume"))
        if size > 0:
            return min(size, state.cash / close[s])
        return max(size, -abs(state.positions.get(s, 0.0)))

    def fill(s: str, size: float, price: float | None) -> None:
        if abs(size) <= TINY:
            return
        if price is None:
            price = rules.price.scalar(bars[s]) if rules.price else rules.slippage.scalar(size, close[s])
        fee = rules.fees.scalar(size, price)
        apply_fill(state, s, size, price, fee)
        state.fills += 1
        fills.append({"symbol": s, "order_id": state.fills, "size": size, "price": price, "fee": fee})

    worth = state.cash + sum(q * close.get(s, 0.0) for s, q in state.positions.items())
    targets = {o["symbol"]: o["target_percent"] for o in orders if o["order_type"] == "TARGET_PERCENT" and o["target_percent"] is not None}
    if targets and worth > 0:
        for s, w in clamp_targets(targets, rules).items():
            if close.get(s):
                fill(s, allowed(s, w * worth / close[s] - state.positions.get(s, 0.0)), None)
    for o in orders:
        s, kind, size, limit, stop = o["symbol"], o["order_type"], o["size"], o["limit_price"], o["stop_price"]
        if kind == "TARGET_PERCENT" or size is None:
            continue
        if s not in bars and len(bars) == 1:
            s = next(iter(bars))
        if not close.get(s):
            continue
        low, high = bars[s]["low"], bars[s]["high"]
        known = low is not None and high is not None
        inside = known and limit is not None and low <= limit <= high
        hit = known and stop is not None and (high >= stop if size > 0 else low <= stop if size < 0 else False)
        if kind == "MARKET":
            fill(s, allowed(s, size), None)
        elif kind == "LIMIT" and inside:
            fill(s, allowed(s, size), limit)
        elif kind == "STOP" and hit:
            fill(s, allowed(s, size), stop)
        elif kind == "STOP_LIMIT" and hit and inside:
            fill(s, allowed(s, size), limit)
    value = sum(q * close.get(s, 0.0) for s, q in state.positions.items())
    gross = sum(abs(q * close.get(s, 0.0)) for s, q in state.positions.items())
    equity = state.cash + value
    state.peak = max(state.peak, equity)
    shot = {"equity": equity, "cash": state.cash, "positions_value": value, "leverage": gross / equity if equity else None, "pnl": equity - state.equity, "drawdown": equity / state.peak - 1.0 if state.peak > 0 else 0.0}
    state.equity = equity
    return fills, shot


ORDER = "symbol string, order_type string, size double, limit_price double, stop_price double, target_percent double"


def by_time(bars: DataFrame, orders: DataFrame, splits: DataFrame | None = None, dividends: DataFrame | None = None, universe: dict[str, int] | None = None) -> DataFrame:
    """run_id, ts, bars and orders (arrays in the universe's order, or by symbol): one row for each time of a run. Bars without run_id serve every run of the orders."""
    b = bars
    day = F.to_date("ts")
    for name, actions, value, combine in (("split", splits, "ratio", F.product), ("dividend", dividends, "amount", F.sum)):
        if actions is not None:
            per = actions.groupBy("symbol", "date").agg(combine(value).alias(name))
            b = b.withColumn("date", day).join(per, ["symbol", "date"], "left").drop("date")
        else:
            b = b.withColumn(name, F.lit(None).cast("double"))
    rank = F.col("symbol")
    if universe:
        rank = F.coalesce(F.element_at(F.create_map(*[x for s, i in universe.items() for x in (F.lit(s), F.lit(i))]), F.col("symbol")), F.lit(len(universe)))
    columns = ["symbol", *[c for c in ("open", "high", "low", "close", "volume", "exec_price") if c in b.columns], "split", "dividend"]
    key = [c for c in ("run_id", "ts") if c in b.columns]
    lines = b.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(rank.alias("_k"), *columns))).alias("bars"))
    o = orders.select("run_id", "ts", "seq", *[F.col(c) if c in orders.columns else F.lit(None).cast(t).alias(c) for c, t in (x.split(" ") for x in ORDER.split(", "))])
    given = o.groupBy("run_id", "ts").agg(F.array_sort(F.collect_list(F.struct("seq", rank.alias("_k"), *[x.split(" ")[0] for x in ORDER.split(", ")]))).alias("orders"))
    if "run_id" not in b.columns:
        lines = lines.crossJoin(o.select("run_id").distinct())  # a line per time and run: what the runs fold
    return lines.join(given, ["run_id", "ts"], "left").select("run_id", "ts", "bars", "orders")


def run(bars: DataFrame, orders: DataFrame, rules: Rules | None = None, positions: bool = False, lane: int | None = None, **kwargs) -> DataFrame:
    """Fills and snapshots of every run, told apart by kind; with positions also what each run holds at each time (kind position: symbol, size and the close, null without a bar).

    Runs are dealt to lanes by hash, and a lane's runs are folded in lockstep (see lockstep). A price model is a column of the bars before that.
    """
    from . import lockstep

    rules = rules or Rules()
    ship(bars.sparkSession)
    if rules.price:
        bars = bars.withColumn("exec_price", rules.price.expr().cast("double"))
    runs = orders.agg(F.approx_count_distinct("run_id").alias("n")).first()["n"]
    lanes = max(1, -(-runs // (lane or lockstep.LANE)))
    lanes = max(lanes, min(runs, bars.sparkSession.sparkContext.defaultParallelism))  # a cluster's cores have a lane each where there are runs enough
    lines = by_time(bars, orders, **kwargs).select(F.pmod(F.xxhash64("run_id"), F.lit(max(1, lanes))).cast("int").alias("_lane"), "run_id", "ts", "bars", "orders")
    lines = lines.repartition(max(1, lanes), "_lane").sortWithinPartitions("_lane", "ts", "run_id")
    kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "timestamp_ntz": pa.timestamp("us")}
    output = [(c, kinds[t]) for c, t in (x.split(" ") for x in OUTPUT.split(", "))]
    return lines.mapInArrow(lambda batches: lockstep.fold(batches, rules, output, positions), OUTPUT)


def snapshots(result: DataFrame) -> DataFrame:
    """The equity lines of a run with positions, and maps of positions and prices by symbol (empty where nothing is held)."""
    held = result.where("kind = 'position'").groupBy("run_id", "ts").agg(F.map_from_entries(F.collect_list(F.struct("symbol", "size"))).alias("positions"), F.map_from_entries(F.collect_list(F.struct("symbol", "price"))).alias("prices"))  # a line a symbol held
    none = F.create_map().cast("map<string,double>")
    return equity(result).join(held, ["run_id", "ts"], "left").withColumns({c: F.coalesce(c, none) for c in ("positions", "prices")})


def equity(result: DataFrame) -> DataFrame:
    return result.where("kind = 'equity'").select("run_id", "ts", "equity", "cash", "positions_value", "leverage", "pnl", "drawdown")


def fills(result: DataFrame) -> DataFrame:
    return result.where("kind = 'fill'").select("run_id", "order_id", "symbol", "size", "price", "ts", "fee")


def target_orders(weights: DataFrame, run_id: str = "run") -> DataFrame:
    """Orders to hold the weights (symbol, ts, weight) at each time."""
    seq = F.row_number().over(W.partitionBy("ts").orderBy("symbol"))
    return weights.select(F.lit(run_id).alias("run_id") if "run_id" not in weights.columns else F.col("run_id"), "ts", seq.alias("seq"), "symbol", F.lit("TARGET_PERCENT").alias("order_type"), F.col("weight").alias("target_percent"))


def long_flat(panel: DataFrame, weight: Column, capital: float = 100_000.0, by: list[str] | None = None) -> DataFrame:
    """Equity of each symbol's own run that holds `weight` (0 to 1) of it, with fills at the close, no costs and volume enough: no fold is needed."""
    w = W.partitionBy(*(by or []), "symbol").orderBy("ts")
    r = F.try_divide(F.col("close"), F.lag("close").over(w)) - 1
    df = panel.withColumn("_w", weight).withColumn("_g", F.coalesce(F.lag("_w").over(w) * r, F.lit(0.0)) + 1)
    return df.withColumn("equity", F.lit(capital) * F.product("_g").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_g").withColumnRenamed("_w", "weight")


def snapshot_metrics(equity: DataFrame) -> DataFrame:
    """pnl and drawdown of each run from equity alone."""
    w = W.partitionBy("run_id").orderBy("ts")
    peak = F.max("equity").over(w.rowsBetween(W.unboundedPreceding, 0))
    return equity.withColumns({"pnl": F.col("equity") - F.lag("equity").over(w), "drawdown": F.try_divide(F.col("equity"), peak) - 1})


def clamp_weights(weights: DataFrame, max_symbol: float = 1.0, max_gross: float = 1.0) -> DataFrame:
    """clamp_targets as Columns, per time (and run); a limit that is not above 0 is none, as there."""
    key = [c for c in ("run_id", "ts") if c in weights.columns]
    w = F.greatest(F.least("weight", F.lit(max_symbol)), F.lit(-max_symbol)) if max_symbol > 0 else F.col("weight")
    gross = F.sum(F.abs("weight")).over(W.partitionBy(*key))
    if max_gross <= 0:
        return weights.withColumn("weight", w)
    return weights.withColumn("weight", w).withColumn("weight", F.when(gross > max_gross, F.col("weight") * max_gross / gross).otherwise(F.col("weight")))
