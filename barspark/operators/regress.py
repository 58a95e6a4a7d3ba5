"""Rolling, cross-sectional and whole-sample least squares, from sums that Spark makes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import col, compile, rolling

#: Factors of a rolling regression at most.
MOST_FACTORS = 6


def rolling_ols(df: DataFrame, y: str, xs: list[str], n: int, by: str = "symbol", order: str = "ts") -> DataFrame:
    """With intercept over each full window of n complete rows: alpha, beta_<x>, prediction, residual (of the last row) and r2.

    The normal equations come from windowed moments (wide windows from two halves); they are solved as Columns (Cramer's rule
    on the covariances, by expansion), so they stay in the JVM. The expansion grows with the factorial of the factors:
    MOST_FACTORS at most. Near-singular windows give null.
    """
    if not 1 <= len(xs) <= MOST_FACTORS:
        raise ValueError(f"from 1 to {MOST_FACTORS} factors")
    have = df.na.drop(subset=[y, *xs]).withColumnsRenamed({by: "symbol", order: "ts"})
    target, factors = col(y), [col(x) for x in xs]
    cols = {f"_m_{c}": rolling("avg", n, col(c)) for c in [y, *xs]}
    cols |= {f"_c_{i}_{j}": rolling("covar_samp", n, a, b) for i, a in enumerate(factors) for j, b in enumerate(factors) if i <= j}
    cols |= {f"_y_{i}": rolling("covar_samp", n, target, a) for i, a in enumerate(factors)}
    cols |= {"_yy": rolling("var_samp", n, target), "_k": rolling("count", n, target)}
    have = compile(have, cols, keep=have.columns).withColumnsRenamed({"symbol": by, "ts": order})
    m = [[F.col(f"_c_{min(i, j)}_{max(i, j)}") for j in range(len(xs))] for i in range(len(xs))]
    v = [F.col(f"_y_{i}") for i in range(len(xs))]
    det = determinant(m)
    scale = F.lit(1.0)
    for i in range(len(xs)):
        scale = scale * m[i][i]
    have = have.withColumn("_det", F.when(F.abs(det) > scale * 1e-12, det))
    betas = {f"beta_{x}": F.try_divide(determinant([[v[r] if c == k else m[r][c] for c in range(len(xs))] for r in range(len(xs))]), F.col("_det")) for k, x in enumerate(xs)}
    have = have.withColumns(betas)
    explained, predicted, alpha = F.lit(0.0), F.lit(0.0), F.col(f"_m_{y}")
    for i, x in enumerate(xs):
        explained = explained + F.col(f"beta_{x}") * v[i]
        alpha = alpha - F.col(f"beta_{x}") * F.col(f"_m_{x}")
    have = have.withColumn("alpha", alpha)
    for x in xs:
        predicted = predicted + F.col(f"beta_{x}") * F.col(x)
    have = have.withColumn("prediction", F.col("alpha") + predicted)
    have = have.withColumns({"residual": F.col(y) - F.col("prediction"), "r2": F.try_divide(explained, F.col("_yy"))})
    return have.where(F.col("_k") == n).drop(*[c for c in have.columns if c.startswith("_")])


def determinant(m: list[list[Column]]) -> Column:
    if len(m) == 1:
        return m[0][0]
    total = None
    for k, head in enumerate(m[0]):
        part = head * determinant([[c for j, c in enumerate(line) if j != k] for line in m[1:]])
        part = part if k % 2 == 0 else -part
        total = part if total is None else total + part
    return total


def cross_section(df: DataFrame, y: str, xs: list[str], least: int | None = None, by: str = "ts") -> DataFrame:
    """Fama-MacBeth: a regression with intercept at each time that has `least` (by default one more than factors) complete rows: by, factor, value, n.

    A time's rows are reduced to its Gram matrix (map-side partial sums); only that reaches the solver, one small matrix a time.
    """
    k = len(xs) + 1
    rows = df.na.drop(subset=[y, *xs])
    cols = [F.lit(1.0), *[F.col(x) for x in xs], F.col(y)]
    sums = [F.sum(cols[i] * cols[j]).alias(f"g{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)]
    gram = rows.groupBy(by).agg(F.count("*").alias("n"), *sums).where(F.col("n") >= (least or k))
    m = [[F.col(f"g{min(i, j)}_{max(i, j)}") for j in range(k)] for i in range(k)]
    v = [F.col(f"g{i}_{k}") for i in range(k)]
    # Centred sums, so that the intercept leaves the system.
    cm = [[m[i][j] - m[0][i] * m[0][j] / F.col("n") for j in range(1, k)] for i in range(1, k)]
    cv = [v[i] - m[0][i] * v[0] / F.col("n") for i in range(1, k)]
    size = F.lit(1.0)
    for i in range(k - 1):
        size = size * cm[i][i]
    det = determinant(cm)
    det = F.when(F.abs(det) > size * 1e-12, det)
    out = [F.struct(F.lit(x).alias("factor"), F.try_divide(determinant([[cv[r] if c == i else cm[r][c] for c in range(k - 1)] for r in range(k - 1)]), det).alias("value")) for i, x in enumerate(xs)]
    return gram.select(by, "n", F.explode(F.array(*out)).alias("o")).select(by, "o.factor", "o.value", "n")


def attribution(df: DataFrame, y: str, xs: list[str], per_year: int = 252) -> dict:
    """Whole-sample regression of y on xs: alpha (per period and year), betas, t statistics, r2, residual deviation. One line of sums comes to the driver."""
    k = len(xs) + 1
    cols = [F.lit(1.0), *[F.col(x) for x in xs], F.col(y)]
    line = df.na.drop(subset=[y, *xs]).agg(F.count("*").alias("n"), *[F.sum(cols[i] * cols[j]).alias(f"g{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)]).first()
    n = line["n"]
    if n < k + 1:
        raise ValueError("too few complete rows")
    g = np.array([[line[f"g{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)], float)
    inverse = np.linalg.inv(g[:k, :k])
    b = inverse @ g[:k, k]
    ssr = max(0.0, g[k, k] - b @ g[:k, k])
    sst = g[k, k] - g[0, k] ** 2 / n
    s2 = ssr / (n - k)
    t = b / np.sqrt(np.maximum(np.diag(inverse) * s2, 1e-300))
    return {"n": n, "alpha": b[0], "alpha_year": b[0] * per_year, "betas": dict(zip(xs, b[1:])), "t_alpha": t[0], "t_stats": dict(zip(xs, t[1:])), "r2": 1 - ssr / sst if sst > 0 else 0.0, "residual_std": float(np.sqrt(s2))}
