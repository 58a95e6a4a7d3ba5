"""Covariances, factor risk models and their decomposition, as long tables; small dense matrices only where a solver needs them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ship
from .recursive import Ema, along

YEAR = 252


#: Symbols of a block and times of a chunk, about.
BLOCK, TIMES = 128, 1 << 16


class Gram:
    """Products of two blocks of symbols over the times that come, as matrices; symbols get a line or column as they appear."""

    SUMS = ("n", "sx", "sy", "sxy")

    def __init__(self, alpha: float | None):
        self.alpha, self.rows, self.columns = alpha, {}, {}
        self.held = {k: np.zeros((0, 0)) for k in (self.SUMS if alpha is None else ("n", "e", "first"))}

    def _at(self, known: dict, symbols: list) -> np.ndarray:
        return np.array([known.setdefault(s, len(known)) for s in symbols], np.int64)

    def add(self, left: np.ndarray, symbols: list, ts: np.ndarray, values: np.ndarray) -> None:
        """Rows of whole times, in their order; left: whether a row is of the first block (of the only one, if it is paired with itself), right the rest."""
        times, t = np.unique(ts, return_inverse=True)
        (i, j) = (self._at(k, [s for s, own in zip(symbols, side.tolist()) if own]) for k, side in ((self.rows, left[0]), (self.columns, left[1])))
        shape = len(self.rows), len(self.columns)
        self.held = {k: np.pad(v, [(0, n - m) for n, m in zip(shape, v.shape)]) for k, v in self.held.items()}
        x, y = np.full((len(times), shape[0]), np.nan), np.full((len(times), shape[1]), np.nan)
        x[t[left[0]], i], y[t[left[1]], j] = values[left[0]], values[left[1]]
        a, b = ~np.isnan(x), ~np.isnan(y)
        x, y = np.where(a, x, 0.0), np.where(b, y, 0.0)
        a, b = a.astype(float), b.astype(float)
        h = self.held
        if self.alpha is None:
            for k, p, q in zip(self.SUMS, (a, x, a, x), (b, b, y, y)):
                h[k] += p.T @ q
            return
        for p, q, u, v in zip(x, y, a, b):
            both = np.outer(u, v) > 0
            product = np.outer(p, q)
            new = both & (h["n"] == 0)
            h["first"][new] = product[new]
            h["e"] = np.where(both, np.where(new, product, h["e"] + self.alpha * (product - h["e"])), h["e"])
            h["n"] += both

    def lines(self, diagonal: bool) -> list[pa.Array]:
        """a, b and what is held, of every pair that has met (of a block with itself: in order of name)."""
        a, b = (np.array(list(k), object) for k in (self.rows, self.columns))
        i, j = np.nonzero(self.held["n"])
        if diagonal:
            keep = a[i] <= b[j]
            i, j = i[keep], j[keep]
        swap = a[i] > b[j]
        names = np.where(swap, b[j], a[i]), np.where(swap, a[i], b[j])
        parts = {k: v[i, j] for k, v in self.held.items()}
        if "sx" in parts:
            parts["sx"], parts["sy"] = np.where(swap, parts["sy"], parts["sx"]), np.where(swap, parts["sx"], parts["sy"])
        return [pa.array(names[0], pa.string()), pa.array(names[1], pa.string()), *(pa.array(v) for v in parts.values())]


def _products(alpha: float | None, names: list[str]):
    """Batches (_p, _q, _chunk, block, symbol, ts, v), sorted by the first three and ts, to lines of pairs: a batch and two blocks' products are held, whatever the times."""

    def run(batches):
        now, gram, rest = None, None, None

        def feed(table):
            block, p, q = (table.column(c).to_numpy() for c in ("block", "_p", "_q"))
            gram.add((block == p, block == q), table.column("symbol").to_pylist(), table.column("ts").cast(pa.int64()).to_numpy(), table.column("v").to_numpy())

        def done():
            feed(rest)
            made = gram.lines(now[0] == now[1])
            return pa.RecordBatch.from_arrays([*made[:2], pa.array([now[2]] * len(made[0]), pa.int32()), *made[2:]], names=names)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            key = np.stack([table.column(c).to_numpy() for c in ("_p", "_q", "_chunk")], 1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for i, j in zip(cuts[:-1], cuts[1:]):
                if i == j:
                    continue
                if now != tuple(key[i]):
                    if now is not None:
                        yield done()
                    now, gram, rest = tuple(key[i].tolist()), Gram(alpha), None
                part = table.slice(i, j - i)
                part = part if rest is None else pa.concat_tables([rest, part])
                ts = part.column("ts").cast(pa.int64()).to_numpy()
                whole = int(np.searchsorted(ts, ts[-1]))  # the last time may go on in the next batch
                if whole:
                    feed(part.slice(0, whole))
                rest = part.slice(whole)
        if now is not None:
            yield done()

    return run


def block_products(values: DataFrame, alpha: float | None = None, block: int = BLOCK, times: int = TIMES, chunk: Column | None = None) -> DataFrame:
    """a, b (a <= b), _chunk and sums over the times that both have, from values (symbol, ts, v): n, sx, sy, sxy; with alpha n, e and first (see ewma_covariance).

    Symbols fall into blocks and times into chunks; a task multiplies two blocks over a chunk as matrices with masks of what
    is there. A row goes to as many tasks as there are blocks, and a pair is a line a chunk, never a line a time. chunk: a whole
    number by which the times are cut instead.
    """
    ship(values.sparkSession)
    values = values.where(F.col("v").isNotNull() & F.col("symbol").isNotNull() & F.col("ts").isNotNull())
    counts = values.agg(F.approx_count_distinct("symbol").alias("s"), F.approx_count_distinct("ts").alias("t")).first()
    blocks, chunks = max(1, -(-counts["s"] // block)), max(1, -(-counts["t"] // times))
    rows = values.withColumn("block", F.pmod(F.xxhash64("symbol"), F.lit(blocks)).cast("int"))
    if chunk is not None:
        rows = rows.withColumn("_chunk", chunk.cast("int"))
    elif chunks == 1:
        rows = rows.withColumn("_chunk", F.lit(0))
    else:  # chunks follow one another in time
        cuts = values.agg(F.percentile_approx("ts", [i / chunks for i in range(1, chunks)]).alias("cuts"))
        rows = rows.crossJoin(F.broadcast(cuts)).withColumn("_chunk", F.size(F.filter("cuts", lambda c: c < F.col("ts"))).cast("int")).drop("cuts")  # one line
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_o")
    rows = rows.select("*", other).select(F.least("block", "_o").alias("_p"), F.greatest("block", "_o").alias("_q"), "_chunk", "block", "symbol", "ts", "v")
    sums = Gram.SUMS if alpha is None else ("n", "e", "first")
    schema = "a string, b string, _chunk int, " + ", ".join(f"{s} double" for s in sums)
    names = ["a", "b", "_chunk", *sums]
    tasks = blocks * (blocks + 1) // 2 * chunks
    return rows.repartition(tasks, "_p", "_q", "_chunk").sortWithinPartitions("_p", "_q", "_chunk", "ts").mapInArrow(_products(alpha, names), schema)


def covariance(returns: DataFrame, value: str = "r", scale: float = 1.0, by: Column | None = None) -> DataFrame:
    """a, b (a <= b), cov and n over the times that both have; by: a whole number from ts, apart for each value of it (a column, `by`).

    Values are taken less their symbol's mean first, so sums of products keep their digits.
    """
    values = returns.select("symbol", "ts", F.col(value).alias("v")).where("v is not null")
    means = values.groupBy("symbol").agg(F.avg("v").alias("_m"))
    sums = block_products(values.join(means, "symbol").select("symbol", "ts", (F.col("v") - F.col("_m")).alias("v")), chunk=by)
    n, sx, sy, sxy = (F.sum(c) for c in Gram.SUMS)
    key = ["a", "b"] if by is None else ["a", "b", F.col("_chunk").alias("by")]
    return sums.groupBy(*key).agg(F.when(n > 1, (sxy - sx * sy / n) / (n - 1) * scale).alias("cov"), n.cast("long").alias("n"))


def full(cov: DataFrame) -> DataFrame:
    """Both halves."""
    return cov.select("a", "b", "cov").unionByName(cov.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "cov"))


def _decay(span: float) -> float:
    """Of an average whose half-life is span / ln 2."""
    return 1 - math.exp(-math.log(2) / (span / math.log(2)))


def ewma_covariance(returns: DataFrame, span: float, value: str = "r") -> DataFrame:
    """a, b, cov: the exponential average (half-life span / ln 2) of products of values less their own exponential averages, at the last time.

    Of each chunk of times come the number of products n, the average e as if it began there, and the first product: put after
    an average y, the chunk leads to (1 - alpha)^n * (y - first) + e.
    """
    alpha = _decay(span)
    values = returns.where(F.col(value).isNotNull()).select("symbol", "ts", F.col(value).alias("v"))
    centred = along(values, {"m": ("v", lambda: Ema(2 / alpha - 1))})
    parts = block_products(centred.select("symbol", "ts", (F.col("v") - F.col("m")).alias("v")), alpha)
    chunks = parts.groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("_chunk", "n", "e", "first"))).alias("l"))  # a line a chunk
    step = lambda y, c: F.when(y.isNull(), c["e"]).otherwise(F.pow(F.lit(1 - alpha), c["n"]) * (y - c["first"]) + c["e"])
    return chunks.select("a", "b", F.aggregate("l", F.lit(None).cast("double"), step).alias("cov"))


def volatility(returns: DataFrame, value: str = "r", span: float | None = None) -> DataFrame:
    """symbol, vol: the yearly sample standard deviation, of all values alike or, with span, exponentially weighted (half-life span / ln 2, without bias) at the last time; missing values do not count."""
    if span is None:
        return returns.groupBy("symbol").agg((F.stddev_samp(value) * math.sqrt(YEAR)).alias("vol"))
    alpha = _decay(span)
    q = 1 - alpha
    values = returns.where(F.col(value).isNotNull()).select("symbol", "ts", F.col(value).alias("v"))
    centred = values.join(values.groupBy("symbol").agg(F.avg("v").alias("_m")), "symbol").select("symbol", "ts", (F.col("v") - F.col("_m")).alias("x"))
    kernel = lambda: Ema(2 / alpha - 1)
    last = along(centred.withColumn("xx", F.col("x") * F.col("x")), {"e1": ("x", kernel), "e2": ("xx", kernel)}).groupBy("symbol").agg(F.max_by(F.struct("e1", "e2"), "ts").alias("e"), F.count("*").alias("n"))
    tail = F.pow(F.lit(q * q), F.col("n") - 1)
    weights = tail + alpha * alpha * (1 - tail) / (1 - q * q)  # the sum of squared weights
    return last.select("symbol", F.when(F.col("n") > 1, F.sqrt(F.greatest(F.lit(0.0), F.col("e.e2") - F.col("e.e1") * F.col("e.e1")) / (1 - weights) * YEAR)).alias("vol"))


def shrink(cov: DataFrame, method: str = "oas") -> DataFrame:
    """Towards the mean variance on the diagonal. lw: delta = v / (v + 1e-10) with the population variance v of the variances; oas: 1 / (k + 1) of k symbols."""
    s = full(cov)
    on = F.col("a") == F.col("b")
    d = F.when(on, F.col("cov"))
    stats = s.agg(F.avg(d).alias("mu"), F.count(d).alias("k"), F.var_pop(d).alias("v"), F.max(F.abs(F.when(~on, F.col("cov")))).alias("off"))
    same = (F.col("v") == 0) & (F.coalesce("off", F.lit(0.0)) == 0)
    delta = F.col("v") / (F.col("v") + 1e-10) if method == "lw" else F.when(same, F.lit(0.0)).otherwise(F.lit(1.0) / (F.col("k") + 1))
    out = s.crossJoin(F.broadcast(stats.select("mu", delta.alias("delta"))))  # one line
    return out.select("a", "b", ((1 - F.col("delta")) * F.col("cov") + F.col("delta") * F.when(on, F.col("mu")).otherwise(F.lit(0.0))).alias("cov"))


def matrix(cov: DataFrame) -> tuple[list[str], np.ndarray]:
    """Names and the dense matrix of the few factors of a model, at the driver: for tests and small models only."""
    rows = cov.select("a", "b", "cov").collect()
    names = sorted({r["a"] for r in rows} | {r["b"] for r in rows})
    at = {s: i for i, s in enumerate(names)}
    out = np.zeros((len(names), len(names)))
    for r in rows:
        out[at[r["a"]], at[r["b"]]] = out[at[r["b"]], at[r["a"]]] = r["cov"]
    return names, out


def condition_number(m: np.ndarray) -> float:
    e = np.abs(np.linalg.eigvalsh((m + m.T) / 2))
    return float(e.max() / e.min()) if e.min() > 0 else float("inf")


def is_psd(m: np.ndarray, tolerance: float = 1e-10) -> bool:
    return bool(np.linalg.eigvalsh((m + m.T) / 2).min() >= -tolerance)


def exposures_at(panel: DataFrame, factors: list[str], ts) -> DataFrame:
    """symbol, factor, exposure at a time, for symbols that have every factor."""
    rows = panel.where(F.col("ts") == F.lit(ts).cast("timestamp_ntz")).na.drop(subset=factors)
    return rows.select("symbol", F.explode(F.create_map(*[x for f in factors for x in (F.lit(f), F.col(f))])).alias("factor", "exposure"))


def exposures_rolling(panel: DataFrame, factors: list[str], ts, window: int) -> DataFrame:
    """The same from means over each symbol's last `window` rows up to the time."""
    past = panel.where(F.col("ts") <= F.lit(ts).cast("timestamp_ntz"))
    last = past.withColumn("_n", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("ts")))).where(F.col("_n") <= window)
    means = last.groupBy("symbol").agg(*[F.avg(f).alias(f) for f in factors]).na.drop(subset=factors)
    return means.select("symbol", F.explode(F.create_map(*[x for f in factors for x in (F.lit(f), F.col(f))])).alias("factor", "exposure"))


def specific_risk(panel: DataFrame, y: str, factors: list[str], factor_returns: DataFrame, window: int) -> DataFrame:
    """symbol, specific_var: yearly variance of y less exposures times factor returns (ts, factor, value) over the last `window` times; symbols with fewer are left out."""
    fr = factor_returns.groupBy("ts").agg(*[F.max(F.when(F.col("factor") == f, F.col("value"))).alias(f"_f_{f}") for f in factors])
    rows = panel.na.drop(subset=[y, *factors]).join(fr, "ts")
    explained = sum((F.col(f) * F.col(f"_f_{f}") for f in factors), F.lit(0.0))
    rows = rows.withColumn("_e", F.col(y) - explained).where(F.col("_e").isNotNull())
    last = rows.withColumn("_n", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("ts")))).where(F.col("_n") <= window)
    return last.groupBy("symbol").agg(F.count("*").alias("_k"), (F.var_samp("_e") * YEAR).alias("specific_var")).where(F.col("_k") >= window).select("symbol", "specific_var")


def total_covariance(exposures: DataFrame, factor_cov: DataFrame, specific: DataFrame) -> DataFrame:
    """a, b, cov = B F B' + D, by joins over factors."""
    f = full(factor_cov).select(F.col("a").alias("f"), F.col("b").alias("g"), F.col("cov").alias("fc"))
    left = exposures.select(F.col("symbol").alias("a"), F.col("factor").alias("f"), F.col("exposure").alias("ea")).join(f, "f")
    half = left.groupBy("a", "g").agg(F.sum(F.col("ea") * F.col("fc")).alias("h"))
    right = exposures.select(F.col("symbol").alias("b"), F.col("factor").alias("g"), F.col("exposure").alias("eb"))
    systematic = half.join(right, "g").groupBy("a", "b").agg(F.sum(F.col("h") * F.col("eb")).alias("cov"))
    own = specific.select(F.col("symbol").alias("a"), F.col("symbol").alias("b"), "specific_var")
    return systematic.join(own, ["a", "b"], "left").select("a", "b", (F.col("cov") + F.coalesce("specific_var", F.lit(0.0))).alias("cov"))


def decompose(weights: DataFrame, exposures: DataFrame, factor_cov: DataFrame, specific: DataFrame) -> DataFrame:
    """factor, exposure (of the portfolio), own_variance (its diagonal part), contribution (with the others; they sum to the factor variance); the line `specific` holds the rest."""
    x = exposures.join(weights, "symbol").groupBy("factor").agg(F.sum(F.col("weight") * F.col("exposure")).alias("exposure"))
    f = full(factor_cov)
    y = x.select(F.col("factor").alias("b"), F.col("exposure").alias("_y"))
    joined = f.join(y, "b").groupBy(F.col("a").alias("factor")).agg(F.sum(F.col("cov") * F.col("_y")).alias("_m"), F.max(F.when(F.col("a") == F.col("b"), F.col("cov"))).alias("_v"))
    factors = x.join(joined, "factor").select("factor", "exposure", (F.col("exposure") ** 2 * F.col("_v")).alias("own_variance"), (F.col("exposure") * F.col("_m")).alias("contribution"))
    rest = weights.join(specific, "symbol").agg(F.coalesce(F.sum(F.col("weight") ** 2 * F.col("specific_var")), F.lit(0.0)).alias("contribution"))
    return factors.unionByName(rest.select(F.lit("specific").alias("factor"), F.lit(None).cast("double").alias("exposure"), F.col("contribution").alias("own_variance"), "contribution"))


def by_symbol(weights: DataFrame, cov: DataFrame) -> DataFrame:
    """symbol, marginal (of volatility by weight), component (weight times that; they sum to the volatility) from weights and a covariance of both halves."""
    right = weights.select(F.col("symbol").alias("b"), F.col("weight").alias("_w"))
    slope = cov.join(right, "b").groupBy(F.col("a").alias("symbol")).agg(F.sum(F.col("cov") * F.col("_w")).alias("_s"))
    df = weights.join(slope, "symbol").select("symbol", "weight", "_s")
    whole = df.agg(F.sqrt(F.sum(F.col("weight") * F.col("_s"))).alias("_vol"))
    df = df.crossJoin(F.broadcast(whole))  # one line
    marginal = F.try_divide(F.col("_s"), F.col("_vol"))
    return df.select("symbol", marginal.alias("marginal"), (F.col("weight") * marginal).alias("component"))


def validate(exposures: DataFrame, factor_cov: DataFrame, specific: DataFrame) -> bool:
    """True; fails, with how many, where an exposure is to a factor without a covariance, a factor of the covariance has no exposure, two factors have none between them, or symbols of exposures and specific variances differ."""
    both = full(factor_cov)
    known, used = both.select(F.col("a").alias("factor")).distinct(), exposures.select("factor").distinct()
    symbols, own = exposures.select("symbol").distinct(), specific.select("symbol").distinct()
    k = known.count()
    faults = {
        "factors without covariance": used.join(known, "factor", "left_anti").count(),
        "factors without exposure": known.join(used, "factor", "left_anti").count(),
        "pairs of factors without covariance": k * k - both.select("a", "b").distinct().count(),
        "symbols without specific variance": symbols.join(own, "symbol", "left_anti").count(),
        "specific variances without exposures": own.join(symbols, "symbol", "left_anti").count(),
    }
    found = [f"{n} {what}" for what, n in faults.items() if n]
    if found:
        raise ValueError("; ".join(found))
    return True


def hedge(weights: DataFrame, exposures: DataFrame, factors: list[str]) -> DataFrame:
    """Weights with the portfolio's exposure to each factor taken out along that factor's exposures (all from the weights given), scaled to sum to 1."""
    wide = exposures.where(F.col("factor").isin(factors)).groupBy("symbol").pivot("factor", factors).agg(F.first("exposure"))
    df = weights.join(wide, "symbol", "left").na.fill(0.0, subset=factors)
    sums = df.agg(*[F.coalesce(F.try_divide(F.sum(F.col("weight") * F.col(f)), F.sum(F.col(f) * F.col(f))), F.lit(0.0)).alias(f"_b_{f}") for f in factors])
    out = F.col("weight")
    for f in factors:
        out = out - F.col(f"_b_{f}") * F.col(f)
    df = df.crossJoin(F.broadcast(sums)).withColumn("_h", out)  # one line
    df = df.crossJoin(F.broadcast(df.agg(F.sum("_h").alias("_total"))))
    return df.select("symbol", F.when(F.abs("_total") > 1e-10, F.col("_h") / F.col("_total")).otherwise(F.col("_h")).alias("weight"))
