"""Exponential averages of histories of any length, by a parallel scan.

An average of averages is an affine map of its state: state after n values = decay(n) @ state
before + what the values add. A long history is cut by time into chunks of about CHUNK rows.
Each chunk's task first gives what its values add to a zero state (and where they lead from
no state at all); these few lines are folded by symbol into the state that each chunk begins
with; then each chunk's values are computed from it. Both passes read one shuffle by symbol
and chunk. Inside a chunk the recurrence runs over whole blocks in numpy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship

#: Rows of a history in one task, about.
CHUNK = 1 << 20
#: A block's decays stay above this, so that dividing by them keeps the digits.
LEAST_DECAY = 1e-12


def ema_step(x: np.ndarray, alpha: float, start: float | None) -> np.ndarray:
    """y = y + alpha * (x - y), from start (none: the first x); missing x keep y.

    In blocks: with q = 1 - alpha, y[t] = q^(t+1) * y before + alpha * sum of q^(t-k) * x[k], a running sum of x[k] / q^k.
    """
    have = x == x
    v = x[have]
    if not len(v):
        return np.full(len(x), np.nan if start is None else start)
    q, y = 1.0 - alpha, v[0] if start is None else start
    if q <= 0:
        out = v.astype(float)
    else:
        n = max(1, min(len(v), int(np.log(LEAST_DECAY) / np.log(q)) if q < 1 else len(v)))
        rows = -(-len(v) // n)
        padded = np.zeros(rows * n)
        padded[: len(v)] = v
        power = q ** np.arange(n)
        own = np.cumsum(alpha * padded.reshape(rows, n) / power, 1) * power
        begin = np.empty(rows)
        for i in range(rows):
            begin[i] = y
            y = q**n * y + own[i, -1]
        out = (own + begin[:, None] * (q * power)).ravel()[: len(v)]
    seen = np.cumsum(have)
    return np.where(seen > 0, out[np.maximum(seen - 1, 0)], np.nan if start is None else start)


class Kernel:
    """A recurrence over a history. step(): from a state (None: none yet) over values (NaN: missing) to outputs and the state after.

    A kernel whose state after n values is decay(n) @ state before + something of the values alone gives decay(); the
    history of one that does not stays in one task.
    """

    def step(self, x: np.ndarray, state: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
        raise NotImplementedError

    def decay(self, n: int) -> np.ndarray | None:
        return None


class Ema(Kernel):
    """span -> alpha = 2 / (span + 1)."""

    def __init__(self, span: float):
        self.alpha = 2.0 / (span + 1.0)

    def step(self, x, state):
        out = ema_step(x, self.alpha, None if state is None else state[0])
        return out, out[-1:] if len(out) and out[-1] == out[-1] else state

    def decay(self, n):
        return np.array([[(1.0 - self.alpha) ** n]])


class Macd(Kernel):
    """The signal line: an average (signal) of the difference of two averages (fast, slow)."""

    def __init__(self, fast: int = 12, slow: int = 26, signal: int = 9):
        self.fast, self.slow, self.signal = (2.0 / (s + 1.0) for s in (fast, slow, signal))

    def step(self, x, state):
        f0, s0, g0 = (None, None, None) if state is None else state
        f, s = ema_step(x, self.fast, f0), ema_step(x, self.slow, s0)
        g = ema_step(np.where(x == x, f - s, np.nan), self.signal, g0)
        return g, np.array([f[-1], s[-1], g[-1]]) if len(x) and g[-1] == g[-1] else state

    def decay(self, n):
        f, s, g, w = 1 - self.fast, 1 - self.slow, 1 - self.signal, self.signal
        return np.linalg.matrix_power(np.array([[f, 0, 0], [0, s, 0], [w * f, -w * s, g]]), n)


def _values(column) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy()


def _repeated(group: pa.Table, name: str, n: int) -> pa.ChunkedArray:
    return pa.chunked_array([group.column(name).slice(0, 1).combine_chunks()] * n)


def _sums(kernels: list, inputs: list[str], key: str, order: str):
    """Of a chunk and kernel: the number of values, what they add to a zero state, and where they lead from none."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by(order)
        rows = []
        for i, (c, make) in enumerate(zip(inputs, kernels)):
            k, x = make(), _values(group.column(c))
            n = int((x == x).sum())
            zero = np.zeros(len(k.decay(1)))
            rows.append((i, n, (k.step(x, zero)[1] if n else zero).tolist(), (k.step(x, None)[1] if n else zero).tolist()))
        own = [_repeated(group, n, len(rows)) for n in (key, "_chunk")]
        return pa.table([*own, *(pa.array(c) for c in zip(*rows))], names=[key, "_chunk", "kernel", "n", "added", "fresh"])

    return run


def _carried(kernels: list, key: str):
    """A symbol's chunks in order -> each chunk's state before it, of every kernel (an empty list: none yet)."""

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(zip(*(group.column(n).to_pylist() for n in ("kernel", "_chunk", "n", "added", "fresh"))))
        states: dict[int, list] = {}
        state, last = None, None
        for i, chunk, n, added, fresh in rows:
            state = None if i != last else state
            last = i
            states.setdefault(chunk, [None] * len(kernels))[i] = [] if state is None else state.tolist()
            if n:
                state = np.array(fresh) if state is None else kernels[i]().decay(n) @ state + np.array(added)
        chunks = sorted(states)
        return pa.table([_repeated(group, key, len(chunks)), pa.array(chunks, pa.int32()), pa.array([states[c] for c in chunks], pa.list_(pa.list_(pa.float64())))], names=[key, "_chunk", "_states"])

    return run


def _stepped(kernels: list, inputs: list[str], names: list[str], order: str):
    def run(group: pa.Table, states: list | None) -> pa.Table:
        group = group.sort_by(order)
        for i, (c, make) in enumerate(zip(inputs, kernels)):
            state = np.array(states[i]) if states and states[i] else None
            out, _ = make().step(_values(group.column(c)), state)
            group = group.append_column(f"_out{i}", pa.array(out, from_pandas=True))
        return group.drop_columns([c for c in ("_chunk",) if c in group.column_names]).rename_columns(names)

    return run


def along(df: DataFrame, outputs: dict[str, tuple[str, object]], key: str = "symbol", order: str = "ts", chunk: int = CHUNK) -> DataFrame:
    """df with columns name -> kernel over the input column in the order of `order`; outputs gives (input, a function that makes a kernel)."""
    ship(df.sparkSession)
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.DoubleType()) for n in outputs)])
    inputs, kernels = [c for c, _ in outputs.values()], [m for _, m in outputs.values()]
    stepped = _stepped(kernels, inputs, schema.names, order)
    whole = any(m().decay(1) is None for m in kernels)
    sizes = df.groupBy(F.col(key).alias("_of")).agg(F.count("*").alias("_n"))
    most = 0 if whole else sizes.agg(F.max("_n")).first()[0] or 0
    if most <= chunk:
        return df.groupBy(key).applyInArrow(lambda group: stepped(group, None), schema)
    parts = -(-most // chunk)
    every = [i / parts for i in range(1, parts)]
    cuts = df.groupBy(F.col(key).alias("_of")).agg(F.percentile_approx(order, every).alias("_cuts"))  # a line a symbol, of at most `parts` times
    laid = df.join(cuts, F.col(key).eqNullSafe(F.col("_of"))).withColumn("_chunk", F.size(F.filter("_cuts", lambda c: c < F.col(order))).cast("int"))
    laid = laid.withColumn("_chunk", F.greatest("_chunk", F.lit(0))).select(*df.columns, "_chunk")
    name = T.StructField(key, df.schema[key].dataType)
    place = T.StructField("_chunk", T.IntegerType())
    many = T.ArrayType(T.DoubleType())
    sums = laid.groupBy(key, "_chunk").applyInArrow(_sums(kernels, inputs, key, order), T.StructType([name, place, T.StructField("kernel", T.LongType()), T.StructField("n", T.LongType()), T.StructField("added", many), T.StructField("fresh", many)]))
    carried = sums.groupBy(key).applyInArrow(_carried(kernels, key), T.StructType([name, place, T.StructField("_states", T.ArrayType(many))]))
    both = laid.groupBy(key, "_chunk").cogroup(carried.groupBy(key, "_chunk"))
    return both.applyInArrow(lambda rows, states: stepped(rows, states.column("_states")[0].as_py()), schema)  # a chunk has one line of states


def ema(df: DataFrame, span: float, column: str = "close", name: str = "ema", **kw) -> DataFrame:
    return along(df, {name: (column, lambda: Ema(span))}, **kw)


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, column: str = "close", name: str = "macd", **kw) -> DataFrame:
    return along(df, {name: (column, lambda: Macd(fast, slow, signal))}, **kw)
