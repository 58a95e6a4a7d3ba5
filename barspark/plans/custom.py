"""Strategies of one's own: a class with init() and next(), run over any number of runs by a polymorphic table function.

The panel's rows are partitioned by run and ordered by time in the function's own analyze
step; each run's instance sees one time after another, with the bars of all its symbols, and
its order helpers make the rows of an order table, which the backtest folds. State is what
the instance keeps; a run's rows stream through it, so only the bars of one time are held.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from ..session import ship

ORDERS = T.StructType(
    [
        *(T.StructField("run_id", T.StringType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("seq", T.IntegerType())),
        *(T.StructField(n, T.StringType()) for n in ("symbol", "order_type")),
        *(T.StructField(n, T.DoubleType()) for n in ("size", "limit_price", "stop_price", "target_percent")),
    ]
)


class Strategy:
    """Subclasses override next(), and init() if they keep state. Parameters are attributes."""

    def __init__(self, **parameters):
        self.__dict__.update(parameters)
        self.orders: list[tuple] = []
        self.ts = None

    def init(self) -> None:
        """Once, before a run's first time."""

    def next(self, bars: dict) -> None:
        """At each time: bars gives each symbol's row. self.ts is the time."""
        raise NotImplementedError("a strategy needs next()")

    def now(self):
        return self.ts

    def _order(self, symbol, kind, size=None, limit=None, stop=None, target=None) -> None:
        number = lambda x: None if x is None else float(x)
        self.orders.append((symbol, kind, number(size), number(limit), number(stop), number(target)))

    def order_market(self, symbol: str, size: float) -> None:
        self._order(symbol, "MARKET", size)

    def order_limit(self, symbol: str, size: float, limit_price: float) -> None:
        self._order(symbol, "LIMIT", size, limit=limit_price)

    def order_stop(self, symbol: str, size: float, stop_price: float) -> None:
        self._order(symbol, "STOP", size, stop=stop_price)

    def order_stop_limit(self, symbol: str, size: float, stop_price: float, limit_price: float) -> None:
        self._order(symbol, "STOP_LIMIT", size, limit_price, stop_price)

    def order_target_percent(self, symbol: str, target: float) -> None:
        self._order(symbol, "TARGET_PERCENT", target=target)


def table_function(strategy: type[Strategy], parameters: dict):
    """A table function over TABLE(panel), whatever columns the panel has besides run_id, symbol and ts."""

    class Orders:
        @staticmethod
        def analyze(panel: AnalyzeArgument) -> AnalyzeResult:
            if not panel.isTable:
                raise ValueError("a strategy runs over a table")
            names = panel.dataType.names
            missing = [c for c in ("run_id", "symbol", "ts") if c not in names]
            if missing:
                raise ValueError(f"the panel lacks {', '.join(missing)}")
            return AnalyzeResult(ORDERS, partitionBy=[PartitioningColumn("run_id")], orderBy=[OrderingColumn("ts"), OrderingColumn("symbol")])

        def __init__(self):
            self.run = None
            self.bars: dict = {}

        def _at(self):
            """What the strategy orders at the time whose bars are in."""
            self.run.next(self.bars)
            made, self.run.orders, self.bars = self.run.orders, [], {}
            for i, order in enumerate(made):
                yield (self.run_id, self.run.ts, i, *order)

        def eval(self, row):
            if self.run is None:
                self.run, self.run_id = strategy(**parameters), row["run_id"]
                self.run.init()
                self.run.ts = row["ts"]
            elif row["ts"] != self.run.ts:
                yield from self._at()
                self.run.ts = row["ts"]
            self.bars[row["symbol"]] = row

        def terminate(self):
            if self.run is not None:
                yield from self._at()

    return F.udtf(Orders)


def orders(panel: DataFrame, strategy: type[Strategy], **parameters) -> DataFrame:
    """The orders (see ORDERS) of the strategy in each run of the panel. Without run_id every symbol is a run of its own."""
    ship(panel.sparkSession)
    if "run_id" not in panel.columns:
        panel = panel.withColumn("run_id", F.col("symbol"))
    return table_function(strategy, parameters)(panel.asTable())


def weights(panel: DataFrame, strategy: type[Strategy], **parameters) -> DataFrame:
    """symbol, ts, weight of a strategy that orders target weights, each symbol by itself."""
    return orders(panel.drop("run_id"), strategy, **parameters).where("order_type = 'TARGET_PERCENT'").select("symbol", "ts", F.col("target_percent").alias("weight"))


class RegimeRotation(Strategy):
    """1 after `bars` closes above the slow average `s`, -1 after as many below, 0 when the close breaks the fast average `f` against the state."""

    def init(self):
        self.state, self.up, self.down = 0.0, 0, 0

    def next(self, bars):
        for symbol, b in bars.items():
            close, f, s = b["close"], b["f"], b["s"]
            self.up = self.up + 1 if close > s else 0
            self.down = self.down + 1 if close < s else 0
            if self.state == 1.0 and close < f or self.state == -1.0 and close > f:
                self.state = 0.0
            elif self.up >= self.bars and close > f:
                self.state = 1.0
            elif self.down >= self.bars and close < f:
                self.state = -1.0
            self.order_target_percent(symbol, self.state)


class EventHold(Strategy):
    """1 from a bar that sees an event (`seen`) until `bars` bars later; a visible event starts the count again."""

    def init(self):
        self.left = 0

    def next(self, bars):
        for symbol, b in bars.items():
            self.left = self.bars if b["seen"] else max(self.left - 1, 0)
            self.order_target_percent(symbol, 1.0 if self.left > 0 else 0.0)
