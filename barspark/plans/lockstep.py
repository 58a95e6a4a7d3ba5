"""The backtest fold of many runs at once: cash is a vector over runs, positions a matrix of runs and symbols.

A lane holds up to about LANE runs in one task. Its lines (run_id, ts, bars, orders) come
sorted by time; the lines of one time are folded together, with one numpy step for the k-th
order of every run, as orders of one run follow one another and those of others do not
matter to it. Numbers agree with backtest.step() up to the order of sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .backtest import TINY, Rules

#: Runs of a lane, about.
LANE = 1000
NOTHING = 1e-10  # a position this small is none
BAR = ("open", "high", "low", "close", "volume", "split", "dividend", "exec_price")
ORDER = ("size", "limit_price", "stop_price", "target_percent")
KINDS = {"MARKET": 0, "LIMIT": 1, "STOP": 2, "STOP_LIMIT": 3, "TARGET_PERCENT": 4}


def _numbers(column) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False) if not pa.types.is_null(column.type) else np.full(len(column), np.nan)


def _flat(column) -> tuple[np.ndarray, pa.StructArray]:
    """Of a list column: each value's line, and the values."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(column)), sizes), column.flatten()


class Lane:
    def __init__(self, rules: Rules):
        self.rules = rules
        self.runs: dict = {}
        self.symbols: dict = {}
        self.names: list = []
        self.cash = self.equity = self.peak = np.empty(0)
        self.fills = np.empty(0, np.int64)
        self.position = self.average = np.zeros((0, 0))
        self.bar = np.zeros((0, 0), np.int64)  # the bar of each run and symbol at this time, or -1
        self.pending: dict | None = None

    def _numbered(self, known: dict, values: list) -> np.ndarray:
        return np.array([known.setdefault(v, len(known)) for v in values], np.int64)

    def _codes(self, known: dict, column) -> np.ndarray:
        """The numbers of a column's values."""
        coded = column.dictionary_encode()
        table = self._numbered(known, coded.dictionary.to_pylist())
        return table[coded.indices.to_numpy(zero_copy_only=False)] if len(column) else np.empty(0, np.int64)

    def _grow(self) -> None:
        rows, columns = len(self.runs), len(self.symbols)
        if rows > len(self.cash):
            more = np.full(rows - len(self.cash), float(self.rules.capital))
            self.cash, self.equity, self.peak = (np.concatenate([x, more]) for x in (self.cash, self.equity, self.peak))
            self.fills = np.concatenate([self.fills, np.zeros(len(more), np.int64)])
        if (rows, columns) != self.position.shape:
            add = [(0, rows - self.position.shape[0]), (0, columns - self.position.shape[1])]
            self.position, self.average = np.pad(self.position, add), np.pad(self.average, add)
            self.bar = np.pad(self.bar, add, constant_values=-1)
        self.names = list(self.symbols)

    def step(self, run_ids, bars, orders) -> tuple[tuple, dict, np.ndarray]:
        """Lines of one time, a line a run. Gives fills (run, symbol, number, size, price, fee), snapshots by name, and the runs' numbers."""
        of, b = _flat(bars)
        at, o = _flat(orders)
        run = self._codes(self.runs, run_ids)
        symbol = self._codes(self.symbols, b.field("symbol"))
        given = {"run": run[at], "symbol": self._codes(self.symbols, o.field("symbol")), "kind": np.array([KINDS.get(k, -1) for k in o.field("order_type").to_pylist()], np.int64)}
        given |= {n: _numbers(o.field(n)) for n in ORDER}
        self._grow()
        fields = {t.name for t in b.type}
        x = {n: _numbers(b.field(n)) if n in fields else np.full(len(symbol), np.nan) for n in BAR}
        r, price = run[of], np.nan_to_num(x["close"])  # what has no close is worth nothing now
        self.bar[r, symbol] = np.arange(len(r))
        held = self.position[r, symbol]
        split = np.where((x["split"] == x["split"]) & (x["split"] != 0) & (held != 0), x["split"], 1.0)
        self.position[r, symbol] = held * split
        self.average[r, symbol] /= split
        paid = np.where((x["dividend"] == x["dividend"]) & (held != 0), self.position[r, symbol] * x["dividend"], 0.0)
        self.cash += np.bincount(r, paid, len(self.cash))
        if self.rules.next_open:
            given = self._wait(given, run)
        out: list[tuple] = []
        worth = self.cash + np.bincount(r, self.position[r, symbol] * price, len(self.cash))
        for k in self._turns(*self._targets(given, worth)):
            j = self.bar[k[0], k[1]]
            k = tuple(v[j >= 0] for v in k)
            j = j[j >= 0]
            close = x["close"][j]
            good = (close == close) & (close != 0)
            k, j, close = tuple(v[good] for v in k), j[good], close[good]
            want = k[2] * worth[k[0]] / close - self.position[k[0], k[1]]
            self._fill(out, k[0], k[1], self._allowed(k[0], k[1], want, x, j), None, x, j)
        self._orders(out, given, r, symbol, x)
        value = np.bincount(r, self.position[r, symbol] * price, len(self.cash))
        gross = np.bincount(r, np.abs(self.position[r, symbol] * price), len(self.cash))
        self.bar[r, symbol] = -1
        cash, value, gross = self.cash[run], value[run], gross[run]
        equity = cash + value
        self.peak[run] = np.maximum(self.peak[run], equity)
        peak = self.peak[run]
        with np.errstate(divide="ignore", invalid="ignore"):
            shot = {"equity": equity, "cash": cash, "positions_value": value, "leverage": np.where(equity != 0, gross / equity, np.nan), "pnl": equity - self.equity[run], "drawdown": np.where(peak > 0, equity / peak - 1.0, 0.0)}
        self.equity[run] = equity
        fills = tuple(np.concatenate(c) for c in zip(*out)) if out else tuple(np.empty(0, np.int64) if i < 3 else np.empty(0) for i in range(6))
        return fills, shot, run

    def _wait(self, given: dict, run: np.ndarray) -> dict:
        """Of the runs that have a line now: the orders of their line before; the new ones wait."""
        if self.pending is None:
            self.pending = {n: v[:0] for n, v in given.items()}
        now = np.isin(self.pending["run"], run)
        due = {n: v[now] for n, v in self.pending.items()}
        self.pending = {n: np.concatenate([v[~now], given[n]]) for n, v in self.pending.items()}
        return due

    def _targets(self, given: dict, worth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Run, symbol and weight of the target orders: of several for one symbol the last counts, at the place of the first."""
        sel = np.flatnonzero((given["kind"] == KINDS["TARGET_PERCENT"]) & ~np.isnan(given["target_percent"]))
        sel = sel[worth[given["run"][sel]] > 0]
        key = given["run"][sel] * max(1, len(self.symbols)) + given["symbol"][sel]
        _, first = np.unique(key, return_index=True)
        uniq, last = np.unique(key[::-1], return_index=True)
        weight = given["target_percent"][sel[::-1]][last]
        order = np.lexsort((first, uniq // max(1, len(self.symbols))))
        first, weight = first[order], weight[order]
        run, symbol = given["run"][sel][first], given["symbol"][sel][first]
        w, most = max(self.rules.max_symbol_weight, 0.0), max(self.rules.max_gross_leverage, 0.0)
        weight = np.clip(weight, -w, w) if w > 0 else weight
        gross = np.bincount(run, np.abs(weight), len(self.cash))[run]
        return run, symbol, np.where((0 < most) & (most < gross), weight * most / np.where(gross > 0, gross, 1.0), weight)

    @staticmethod
    def _turns(run: np.ndarray, *columns: np.ndarray):
        """The first of each run, then the second, and so on; run is sorted so that a run's rows are together."""
        if not len(run):
            return
        first = np.concatenate([[True], run[1:] != run[:-1]])
        place = np.arange(len(run)) - np.maximum.accumulate(np.where(first, np.arange(len(run)), 0))
        order = np.argsort(place, kind="stable")
        for part in np.split(order, np.cumsum(np.bincount(place))[:-1]):
            yield (run[part], *(c[part] for c in columns))

    def _allowed(self, run, symbol, size, x, j) -> np.ndarray:
        size = self.rules.volume.vector(size, x["volume"][j])
        return np.where(size > 0, np.minimum(size, self.cash[run] / x["close"][j]), np.maximum(size, -np.abs(self.position[run, symbol])))

    def _fill(self, out: list, run, symbol, size, price, x, j) -> None:
        go = np.abs(size) > TINY
        run, symbol, size, j = run[go], symbol[go], size[go], j[go]
        if not len(run):
            return
        if price is None:
            model = x["exec_price"][j] if self.rules.price else self.rules.slippage.vector(size, x["close"][j])
            price = model
        else:
            price = price[go]
            market = np.isnan(price)
            if market.any():
                price = np.where(market, x["exec_price"][j] if self.rules.price else self.rules.slippage.vector(size, x["close"][j]), price)
        fee = self.rules.fees.vector(size, price)
        held, average = self.position[run, symbol], self.average[run, symbol]
        now = held + size
        grown = (size > 0) & (now != 0)
        average = np.where(grown, (held * average + size * price) / np.where(grown, now, 1.0), average)
        gone = np.abs(now) < NOTHING
        self.position[run, symbol] = np.where(gone, 0.0, now)
        self.average[run, symbol] = np.where(gone, 0.0, average)
        self.cash[run] -= size * price + fee
        self.fills[run] += 1
        out.append((run, symbol, self.fills[run], size, price, fee))

    def _orders(self, out: list, given: dict, r: np.ndarray, bar_symbol: np.ndarray, x: dict) -> None:
        own = np.flatnonzero((given["kind"] >= 0) & (given["kind"] != KINDS["TARGET_PERCENT"]) & ~np.isnan(given["size"]))
        own = own[np.argsort(given["run"][own], kind="stable")]
        count = np.bincount(r, minlength=len(self.cash))
        only = np.zeros(len(self.cash), np.int64)
        only[r] = bar_symbol
        for run, i in self._turns(given["run"][own], own):
            symbol = given["symbol"][i]
            symbol = np.where((self.bar[run, symbol] < 0) & (count[run] == 1), only[run], symbol)  # a run of one bar takes orders for any symbol
            j = self.bar[run, symbol]
            go = j >= 0
            run, i, symbol, j = run[go], i[go], symbol[go], j[go]
            close, low, high = x["close"][j], x["low"][j], x["high"][j]
            kind, size, limit, stop = (given[n][i] for n in ("kind", "size", "limit_price", "stop_price"))
            inside = (low <= limit) & (limit <= high)
            hit = ~np.isnan(low) & ~np.isnan(high) & np.where(size > 0, high >= stop, (size < 0) & (low <= stop))
            go = np.select([kind == 0, kind == 1, kind == 2, kind == 3], [True, inside, hit, hit & inside], False) & (close == close) & (close != 0)
            price = np.select([kind == 0, kind == 2], [np.nan, stop], limit)
            run, symbol, size, price, j = run[go], symbol[go], size[go], price[go], j[go]
            self._fill(out, run, symbol, self._allowed(run, symbol, size, x, j), price, x, j)


def fold(batches, rules: Rules, output: list[tuple[str, pa.DataType]], positions: bool):
    """Arrow batches (_lane, run_id, ts, bars, orders), sorted by the first, ts and run, to batches of the output's columns."""
    now, lane = None, None
    names = [n for n, _ in output]
    for batch in batches:
        lanes, ts = batch.column(0).to_numpy(), batch.column(2)
        time = ts.cast(pa.int64()).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero((lanes[1:] != lanes[:-1]) | (time[1:] != time[:-1])) + 1
        made: dict[str, list] = {n: [] for n in names}

        def put(n: int, at: int, **columns) -> None:
            for name, kind in output:
                v = columns.get(name)
                made[name].append(pa.nulls(n, kind) if v is None else v if isinstance(v, pa.Array) else pa.array(v, kind, from_pandas=True))
            made["ts"][-1] = pa.repeat(ts[at], n).cast(dict(output)["ts"])  # noqa: B023

        for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(lanes)]):
            if i == j:
                continue
            if lanes[i] != now:
                now, lane = lanes[i], Lane(rules)
            part = batch.slice(i, j - i)
            fills, shot, run = lane.step(part.column(1), part.column(3), part.column(4))
            ids, symbols = np.array(list(lane.runs), object), np.array(lane.names, object)
            n = len(fills[0])
            put(n, i, run_id=ids[fills[0]], kind=np.full(n, "fill", object), symbol=symbols[fills[1]] if n else np.empty(0, object), order_id=fills[2], size=fills[3], price=fills[4], fee=fills[5])
            put(j - i, i, run_id=part.column(1), kind=np.full(j - i, "equity", object), **shot)
            if positions:
                a, s = np.nonzero(lane.position[run])
                of, b = _flat(part.column(3))
                close = np.full((len(lane.cash), len(symbols)), np.nan)
                close[run[of], lane._codes(lane.symbols, b.field("symbol"))] = _numbers(b.field("close"))
                put(len(a), i, run_id=ids[run[a]], kind=np.full(len(a), "position", object), symbol=symbols[s], size=lane.position[run[a], s], price=close[run[a], s])
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in made[n]]) if made[n] else pa.nulls(0, k) for n, k in output], names=names)
