"""Covariance, factor regressions and risk models, portfolio construction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import factors as fx
from ..functions.expr import compile, lag
from ..operators import alloc, regress, risk
from ..sources.bars import bars_d, bars_h, bars_o, bars_s
from . import R, query, r6

_RO = "(SELECT symbol, ts, r FROM rets_o WHERE r IS NOT NULL)"
_PAIRS = f"(SELECT x.symbol AS a, y.symbol AS b, covar_samp(x.r, y.r) AS cov FROM {_RO} x JOIN {_RO} y ON x.ts = y.ts AND x.symbol <= y.symbol GROUP BY 1, 2)"
_FULL = f"(SELECT a, b, cov FROM {_PAIRS} UNION ALL SELECT b, a, cov FROM {_PAIRS} WHERE a <> b)"


def _returns(spark, sf_dir, panel=bars_o):
    return compile(panel(spark, sf_dir), {"r": fx.returns()})


@query("covariance_sample", f"SELECT a, b, {R('cov')} AS cov FROM {_PAIRS}")
def covariance_sample(spark, sf_dir):
    return risk.covariance(_returns(spark, sf_dir)).select("a", "b", r6("cov", "cov"))


@query("covariance_ewma", f"""WITH RECURSIVE p AS (SELECT symbol, ts, r, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM rets_d WHERE r IS NOT NULL),
k AS (SELECT 1 - exp(-ln(2) / (20 / ln(2))) AS a),
m(symbol, ts, i, r, m) AS (SELECT symbol, ts, i, r, r FROM p WHERE i = 1 UNION ALL SELECT p.symbol, p.ts, p.i, p.r, m.m + (p.r - m.m) * (SELECT a FROM k) FROM m JOIN p ON p.symbol = m.symbol AND p.i = m.i + 1),
q AS (SELECT x.symbol AS a, y.symbol AS b, x.ts, (x.r - x.m) * (y.r - y.m) AS v, row_number() OVER (PARTITION BY x.symbol, y.symbol ORDER BY x.ts) AS i FROM m x JOIN m y ON x.ts = y.ts AND x.symbol <= y.symbol),
e(a, b, i, ts, e) AS (SELECT a, b, i, ts, v FROM q WHERE i = 1 UNION ALL SELECT q.a, q.b, q.i, q.ts, e.e + (q.v - e.e) * (SELECT a FROM k) FROM e JOIN q ON q.a = e.a AND q.b = e.b AND q.i = e.i + 1)
SELECT a, b, {R('arg_max(e, ts)')} AS cov FROM e GROUP BY a, b""")
def covariance_ewma(spark, sf_dir):
    return risk.ewma_covariance(_returns(spark, sf_dir, bars_d), 20).select("a", "b", r6("cov", "cov"))


@query("volatility_estimate", f"SELECT symbol, {R('stddev_samp(r) * sqrt(252)')} AS vol FROM rets_o GROUP BY symbol")
def volatility_estimate(spark, sf_dir):
    return risk.volatility(_returns(spark, sf_dir)).select("symbol", r6("vol", "vol"))


@query("volatility_ewm", f"""WITH k AS (SELECT 1 - exp(-ln(2) / (20 / ln(2))) AS a), p AS (SELECT symbol, r, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM rets_d WHERE r IS NOT NULL),
w AS (SELECT symbol, r, CASE WHEN i = 1 THEN (1 - a) ^ (n - 1) ELSE a * (1 - a) ^ (n - i) END AS w FROM p, k), m AS (SELECT symbol, sum(w * r) AS m FROM w GROUP BY symbol)
SELECT symbol, {R('sqrt(sum(w * (r - m) ^ 2) / (1 - sum(w * w)) * 252)')} AS vol FROM w JOIN m USING (symbol) GROUP BY symbol""")
def volatility_ewm(spark, sf_dir):
    return risk.volatility(_returns(spark, sf_dir, bars_d), span=20).select("symbol", r6("vol", "vol"))


_STATS = f"(SELECT avg(cov) AS mu, count(*) AS k, var_pop(cov) AS v FROM {_FULL} WHERE a = b)"
for _m, _d in (("lw", "v / (v + 1e-10)"), ("oas", "1.0 / (k + 1)")):

    @query(f"shrink_cov_{_m}", f"SELECT a, b, {R(f'(1 - {_d}) * cov + {_d} * CASE WHEN a = b THEN mu ELSE 0 END')} AS cov FROM {_FULL}, {_STATS}")
    def shrink_cov(spark, sf_dir, method=_m):
        return risk.shrink(risk.covariance(_returns(spark, sf_dir)), method).select("a", "b", r6("cov", "cov"))


# Regressions.
_XY = "(SELECT symbol, ts, r AS y, lag(r) OVER (PARTITION BY symbol ORDER BY ts) AS x1, lag(r, 2) OVER (PARTITION BY symbol ORDER BY ts) AS x2 FROM rets_o)"


def _xy(spark, sf_dir, panel=bars_o):
    y = fx.returns()
    return compile(panel(spark, sf_dir), {"y": y, "x1": lag(y, 1), "x2": lag(y, 2)})


_W20 = "(PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


@query("rolling_ols_1", f"""WITH w AS (SELECT symbol, ts, y, x1, count(*) OVER q AS n, regr_slope(y, x1) OVER q AS b, regr_intercept(y, x1) OVER q AS a, regr_r2(y, x1) OVER q AS r2 FROM {_XY} WHERE y IS NOT NULL AND x1 IS NOT NULL WINDOW q AS {_W20})
SELECT symbol, ts, {R('a')} AS alpha, {R('b')} AS beta, {R('a + b * x1')} AS prediction, {R('y - a - b * x1')} AS residual, {R('r2')} AS r2 FROM w WHERE n = 20""")
def rolling_ols_1(spark, sf_dir):
    df = regress.rolling_ols(_xy(spark, sf_dir).drop("x2"), "y", ["x1"], 20)
    return df.select("symbol", "ts", r6("alpha", "alpha"), r6("beta_x1", "beta"), r6("prediction", "prediction"), r6("residual", "residual"), r6("r2", "r2"))


_C2 = ", ".join(f"covar_samp({a}, {b}) OVER q AS {n}" for n, a, b in (("c11", "x1", "x1"), ("c12", "x1", "x2"), ("c22", "x2", "x2"), ("d1", "y", "x1"), ("d2", "y", "x2")))


@query("rolling_ols_2", f"""WITH w AS (SELECT symbol, ts, y, x1, x2, count(*) OVER q AS n, avg(y) OVER q AS my, avg(x1) OVER q AS m1, avg(x2) OVER q AS m2, {_C2} FROM {_XY} WHERE y IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL WINDOW q AS {_W20}),
b AS (SELECT *, (d1 * c22 - d2 * c12) / (c11 * c22 - c12 * c12) AS b1, (d2 * c11 - d1 * c12) / (c11 * c22 - c12 * c12) AS b2 FROM w WHERE n = 20)
SELECT symbol, ts, {R('b1')} AS beta_x1, {R('b2')} AS beta_x2, {R('y - my - b1 * (x1 - m1) - b2 * (x2 - m2)')} AS residual FROM b""")
def rolling_ols_2(spark, sf_dir):
    df = regress.rolling_ols(_xy(spark, sf_dir), "y", ["x1", "x2"], 20)
    return df.select("symbol", "ts", *[r6(c, c) for c in ("beta_x1", "beta_x2", "residual")])


_S = "(SELECT symbol, ts, y, lag(y) OVER w AS x1, lag(y, 2) OVER w AS x2 FROM (SELECT symbol, ts, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS y FROM bars_s) WINDOW w AS (PARTITION BY symbol ORDER BY ts))"
_D2 = "(var_pop(x1) * var_pop(x2) - covar_pop(x1, x2) ^ 2)"


@query("fama_macbeth_1", f"SELECT ts, 'x1' AS factor, {R('regr_slope(y, x1)')} AS value, count(*) AS n FROM {_S} WHERE y IS NOT NULL AND x1 IS NOT NULL GROUP BY ts HAVING count(*) >= 5")
def fama_macbeth_1(spark, sf_dir):
    return regress.cross_section(_xy(spark, sf_dir, bars_s), "y", ["x1"], 5).select("ts", "factor", r6("value", "value"), "n")


@query("factor_returns_min_assets", f"""WITH g AS (SELECT ts, count(*) AS n, (covar_pop(y, x1) * var_pop(x2) - covar_pop(y, x2) * covar_pop(x1, x2)) / {_D2} AS f1, (covar_pop(y, x2) * var_pop(x1) - covar_pop(y, x1) * covar_pop(x1, x2)) / {_D2} AS f2
FROM {_S} WHERE y IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL GROUP BY ts HAVING count(*) >= 20)
SELECT ts, 'x1' AS factor, {R('f1')} AS value, n FROM g UNION ALL SELECT ts, 'x2', {R('f2')}, n FROM g""")
def factor_returns_min_assets(spark, sf_dir):
    return regress.cross_section(_xy(spark, sf_dir, bars_s), "y", ["x1", "x2"], 20).select("ts", "factor", r6("value", "value"), "n")


_FR = f"(SELECT ts, regr_slope(y, x1) AS f FROM {_S} WHERE y IS NOT NULL AND x1 IS NOT NULL GROUP BY ts HAVING count(*) >= 5)"


@query("specific_risk", f"""WITH e AS (SELECT symbol, ts, y - x1 * f AS e FROM {_S} JOIN {_FR} USING (ts) WHERE y IS NOT NULL AND x1 IS NOT NULL),
l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS n FROM e)
SELECT symbol, {R('var_samp(e) * 252')} AS specific_var FROM l WHERE n <= 60 GROUP BY symbol HAVING count(*) >= 60""")
def specific_risk(spark, sf_dir):
    df = _xy(spark, sf_dir, bars_s).drop("x2")
    return risk.specific_risk(df, "y", ["x1"], regress.cross_section(df, "y", ["x1"], 5), 60).select("symbol", r6("specific_var", "specific_var"))


@query("factor_regression", f"""WITH d AS (SELECT s.r AS y, m.r AS x FROM rets_o s JOIN rets_o m ON s.ts = m.ts AND s.symbol = '2-HIGH' AND m.symbol = '1-URGENT' WHERE s.r IS NOT NULL AND m.r IS NOT NULL),
a AS (SELECT count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_r2(y, x) AS r2, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy FROM d)
SELECT n, {R('a')} AS alpha, {R('b')} AS beta, {R('b / sqrt(syy * (1 - r2) / (n - 2) / sxx)')} AS t_beta, {R('r2')} AS r2, {R('sqrt(syy * (1 - r2) / (n - 2))')} AS residual_std FROM a""")
def factor_regression(spark, sf_dir):
    df = compile(bars_o(spark, sf_dir), {"y": fx.returns(), "x": fx.benchmark("1-URGENT", fx.returns())}).where("symbol = '2-HIGH'")
    a = regress.attribution(df, "y", ["x"])
    row = (int(a["n"]), float(a["alpha"]), float(a["betas"]["x"]), float(a["t_stats"]["x"]), float(a["r2"]), float(a["residual_std"]))
    out = spark.createDataFrame([row], "n long, alpha double, beta double, t_beta double, r2 double, residual_std double")
    return out.select("n", *[r6(c, c) for c in out.columns[1:]])


# A risk model over the five daily panels: exposures are momentum and volatility, both as they stand.
_AT = "2024-01-25"
_EXP = f"(SELECT symbol, m, v FROM (SELECT symbol, ts, close / lag(close, 5) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS m, stddev_samp(r) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) * sqrt(252) AS v FROM rets_d) WHERE ts = TIMESTAMP '{_AT}' AND m IS NOT NULL AND v IS NOT NULL)"
_B = f"(SELECT symbol, 'm' AS factor, m AS exposure FROM {_EXP} UNION ALL SELECT symbol, 'v', v FROM {_EXP})"
_FC = "(VALUES ('m', 'm', 0.04::DOUBLE), ('m', 'v', 0.01::DOUBLE), ('v', 'm', 0.01::DOUBLE), ('v', 'v', 0.09::DOUBLE)) fc(a, b, cov)"
_SP = "(SELECT symbol, var_samp(r) * 252 AS specific_var FROM rets_d GROUP BY symbol)"
_WT = f"(SELECT symbol, 1.0 / count(*) OVER () AS weight FROM {_EXP})"


def _exposures(spark, sf_dir):
    df = compile(bars_d(spark, sf_dir), {"m": fx.momentum(5), "v": fx.volatility(10)})
    return risk.exposures_at(df, ["m", "v"], _AT)


def _model(spark, sf_dir):
    b = _exposures(spark, sf_dir)
    fc = spark.createDataFrame([("m", "m", 0.04), ("m", "v", 0.01), ("v", "v", 0.09)], "a string, b string, cov double")
    sp = _returns(spark, sf_dir, bars_d).groupBy("symbol").agg((F.var_samp("r") * 252).alias("specific_var"))
    return b, fc, sp, alloc.equal_weight(b.select("symbol").distinct())


@query("exposures_at_date", f"SELECT symbol, factor, {R('exposure')} AS exposure FROM {_B}")
def exposures_at_date(spark, sf_dir):
    return _exposures(spark, sf_dir).select("symbol", "factor", r6("exposure", "exposure"))


@query("exposures_rolling", f"SELECT symbol, 'm' AS factor, {R('avg(m)')} AS exposure FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS n FROM (SELECT symbol, ts, close / lag(close, 5) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS m FROM rets_d) WHERE ts <= TIMESTAMP '{_AT}') WHERE n <= 7 GROUP BY symbol")
def exposures_rolling(spark, sf_dir):
    df = compile(bars_d(spark, sf_dir), {"m": fx.momentum(5)})
    return risk.exposures_rolling(df, ["m"], _AT, 7).select("symbol", "factor", r6("exposure", "exposure"))


_TOTAL = f"(SELECT x.symbol AS a, y.symbol AS b, sum(x.exposure * fc.cov * y.exposure) + CASE WHEN x.symbol = y.symbol THEN any_value(specific_var) ELSE 0 END AS cov FROM {_B} x JOIN {_FC} ON x.factor = fc.a JOIN {_B} y ON y.factor = fc.b LEFT JOIN {_SP} s ON s.symbol = x.symbol GROUP BY 1, 2)"


@query("total_covariance", f"SELECT a, b, {R('cov')} AS cov FROM {_TOTAL}")
def total_covariance(spark, sf_dir):
    b, fc, sp, _ = _model(spark, sf_dir)
    return risk.total_covariance(b, fc, sp).select("a", "b", r6("cov", "cov"))


@query("decompose_risk", f"""WITH x AS (SELECT factor, sum(weight * exposure) AS e FROM {_B} JOIN {_WT} USING (symbol) GROUP BY factor),
f AS (SELECT x.factor, x.e AS exposure, sum(CASE WHEN fc.a = fc.b THEN x.e ^ 2 * fc.cov END) AS own, sum(x.e * fc.cov * y.e) AS c FROM x JOIN {_FC} ON fc.a = x.factor JOIN x y ON y.factor = fc.b GROUP BY 1, 2),
s AS (SELECT sum(weight ^ 2 * specific_var) AS v FROM {_WT} JOIN {_SP} USING (symbol))
SELECT factor, {R('exposure')} AS exposure, {R('own')} AS own_variance, {R('c')} AS contribution FROM f UNION ALL SELECT 'specific', NULL, {R('v')}, {R('v')} FROM s""")
def decompose_risk(spark, sf_dir):
    b, fc, sp, w = _model(spark, sf_dir)
    return risk.decompose(w, b, fc, sp).select("factor", r6("exposure", "exposure"), r6("own_variance", "own_variance"), r6("contribution", "contribution"))


@query("risk_by_symbol", f"""WITH s AS (SELECT a AS symbol, sum(cov * w.weight) AS s FROM {_TOTAL} t JOIN {_WT} w ON w.symbol = t.b GROUP BY a), v AS (SELECT sqrt(sum(weight * s)) AS v FROM s JOIN {_WT} w USING (symbol))
SELECT symbol, {R('s / v')} AS marginal, {R('weight * s / v')} AS component FROM s JOIN {_WT} w USING (symbol), v""")
def risk_by_symbol(spark, sf_dir):
    b, fc, sp, w = _model(spark, sf_dir)
    return risk.by_symbol(w, risk.total_covariance(b, fc, sp)).select("symbol", r6("marginal", "marginal"), r6("component", "component"))


@query("hedge_exposures", f"""WITH e AS (SELECT symbol, weight, m, v FROM {_EXP} JOIN {_WT} USING (symbol)),
h AS (SELECT symbol, weight - sum(weight * m) OVER () / sum(m * m) OVER () * m AS w FROM e)
SELECT symbol, {R('w / sum(w) OVER ()')} AS weight FROM h""")
def hedge_exposures(spark, sf_dir):
    b, _, _, w = _model(spark, sf_dir)
    return risk.hedge(w, b, ["m"]).select("symbol", r6("weight", "weight"))


# Weights.
@query("equal_weight", f"SELECT symbol, ts, {R('1.0 / count(*) OVER (PARTITION BY ts)')} AS weight FROM bars_h")
def equal_weight(spark, sf_dir):
    return alloc.equal_weight(bars_h(spark, sf_dir).select("symbol", "ts")).select("symbol", "ts", r6("weight", "weight"))


@query("scores_to_weights", f"SELECT symbol, ts, {R('CASE WHEN sum(greatest(coalesce(r, 0), 0)) OVER w > 0 THEN greatest(coalesce(r, 0), 0) / sum(greatest(coalesce(r, 0), 0)) OVER w ELSE 1.0 / count(*) OVER w END')} AS weight FROM rets_h WINDOW w AS (PARTITION BY ts)")
def scores_to_weights(spark, sf_dir):
    return alloc.scores_to_weights(_returns(spark, sf_dir, bars_h), "r").select("symbol", "ts", r6("weight", "weight"))


_PREV = "(SELECT symbol, ts, close / sum(close) OVER (PARTITION BY ts) AS weight FROM bars_h WHERE hour(ts) % 2 = 0 OR symbol <> 'click')"
_TGT = "(SELECT symbol, ts, volume / sum(volume) OVER (PARTITION BY ts) AS weight FROM bars_h WHERE hour(ts) % 3 = 0 OR symbol <> 'view')"
_CHG = f"(SELECT symbol, ts, coalesce(p.weight, 0) AS p, coalesce(t.weight, 0) AS t, abs(coalesce(t.weight, 0) - coalesce(p.weight, 0)) AS d FROM {_PREV} p FULL JOIN {_TGT} t USING (symbol, ts))"


def _changes(spark, sf_dir):
    from pyspark.sql import Window as W

    b, w = bars_h(spark, sf_dir), W.partitionBy("ts")
    share = lambda df, c: df.select("symbol", "ts", (F.col(c) / F.sum(c).over(w)).alias("weight"))
    return alloc.changes(share(b.where("hour(ts) % 2 = 0 or symbol <> 'click'"), "close"), share(b.where("hour(ts) % 3 = 0 or symbol <> 'view'"), "volume"))


@query("weights_align", f"SELECT symbol, ts, {R('p')} AS w_prev, {R('t')} AS w_target FROM {_CHG}")
def weights_align(spark, sf_dir):
    return _changes(spark, sf_dir).select("symbol", "ts", r6("w_prev", "w_prev"), r6("w_target", "w_target"))


@query("cost_models", f"SELECT ts, {R('sum(d * 0.001)')} AS proportional, {R('sum(d * 0.5 * 10 / 10000 * 0.8)')} AS spread, {R('sum(0.1 * sqrt(d / (p + t + 1)) * d)')} AS impact, {R('sum(d * 0.001 + d * 0.5 * 10 / 10000 * 0.8)')} AS composite FROM {_CHG} GROUP BY ts")
def cost_models(spark, sf_dir):
    d = F.col("d")
    a, b = alloc.proportional_cost(d, 0.001), alloc.spread_cost(d, 10.0, 0.8)
    c = alloc.impact_cost(d, F.col("w_prev") + F.col("w_target") + 1)
    return _changes(spark, sf_dir).groupBy("ts").agg(r6(F.sum(a), "proportional"), r6(F.sum(b), "spread"), r6(F.sum(c), "impact"), r6(F.sum(a + b), "composite"))


@query("compute_turnover", f"SELECT ts, {R('sum(d)')} AS turnover FROM {_CHG} GROUP BY ts")
def compute_turnover(spark, sf_dir):
    return alloc.turnover(_changes(spark, sf_dir)).select("ts", r6("turnover", "turnover"))


_CL = "greatest(least(t - p, 0.1), -0.1)"


@query("turnover_constraint", f"SELECT symbol, ts, {R(f'p + {_CL} * CASE WHEN sum(abs({_CL})) OVER w > 0.2 THEN 0.2 / sum(abs({_CL})) OVER w ELSE 1 END')} AS weight FROM {_CHG} WINDOW w AS (PARTITION BY ts)")
def turnover_constraint(spark, sf_dir):
    return alloc.limit_turnover(_changes(spark, sf_dir), 0.2, 0.1).select("symbol", "ts", r6("weight", "weight"))


@query("rebalance_penalty", f"SELECT symbol, ts, {R('p / 3 + t * 2 / 3')} AS weight FROM {_CHG}")
def rebalance_penalty(spark, sf_dir):
    return alloc.rebalance_penalty(_changes(spark, sf_dir), 0.5).select("symbol", "ts", r6("weight", "weight"))


@query("finalize_weights", f"SELECT symbol, ts, {R('coalesce(t / nullif(sum(t) OVER (PARTITION BY ts), 0), t)')} AS weight FROM {_CHG}")
def finalize_weights(spark, sf_dir):
    return alloc.finalize(_changes(spark, sf_dir)).select("symbol", "ts", r6("weight", "weight"))


@query("fill_missing", f"SELECT symbol, {R('coalesce(last_value(x IGNORE NULLS) OVER (ORDER BY symbol), first_value(x IGNORE NULLS) OVER (ORDER BY symbol ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))')} AS x FROM (SELECT symbol, CASE WHEN symbol IN ('click', 'view') THEN NULL ELSE avg(close) END AS x FROM bars_d GROUP BY symbol)")
def fill_missing(spark, sf_dir):
    df = bars_d(spark, sf_dir).groupBy("symbol").agg(F.avg("close").alias("x")).withColumn("x", F.when(~F.col("symbol").isin("click", "view"), F.col("x")))
    return alloc.filled(df, "x").select("symbol", r6("x", "x"))


@query("target_volatility", f"WITH c AS (SELECT a, b, cov * 252 AS cov FROM {_FULL}), w AS (SELECT DISTINCT symbol, 0.2 AS weight FROM bars_o), s AS (SELECT sqrt(sum(0.04 * cov)) AS vol FROM c) SELECT symbol, {R('weight * least(0.1 / vol, 1.5 / (SELECT sum(weight) FROM w))')} AS weight FROM w, s")
def target_volatility(spark, sf_dir):
    cov = risk.full(risk.covariance(_returns(spark, sf_dir), scale=252.0))
    w = bars_o(spark, sf_dir).select("symbol").distinct().withColumn("weight", F.lit(0.2))
    return alloc.target_volatility(w, cov, 0.1, 1.5).select("symbol", r6("weight", "weight"))


def _yearly_cov(spark, sf_dir):
    """Covariances of each year's returns, a rebalance at its begin."""
    r = _returns(spark, sf_dir)
    p = risk.covariance(r, scale=252.0, by=F.year("ts")).withColumn("ts", F.make_date("by", F.lit(1), F.lit(1)).cast("timestamp_ntz"))
    return p.select("ts", "a", "b", "cov").unionByName(p.where("a <> b").select("ts", F.col("b").alias("a"), F.col("a").alias("b"), "cov"))


_YC = "(SELECT date_trunc('year', x.ts)::TIMESTAMP AS ts, x.symbol AS a, y.symbol AS b, covar_samp(x.r, y.r) * 252 AS cov FROM rets_o x JOIN rets_o y ON x.ts = y.ts AND x.symbol IN ('1-URGENT', '2-HIGH') AND y.symbol IN ('1-URGENT', '2-HIGH') WHERE x.r IS NOT NULL AND y.r IS NOT NULL GROUP BY 1, 2, 3)"


@query("min_variance_two", f"""WITH p AS (SELECT ts, max(cov) FILTER (a = '1-URGENT' AND b = a) AS v1, max(cov) FILTER (a = '2-HIGH' AND b = a) AS v2, max(cov) FILTER (a <> b) AS c FROM {_YC} GROUP BY ts),
w AS (SELECT ts, greatest(0, least(1, (v2 - c) / (v1 + v2 - 2 * c))) AS w FROM p WHERE v1 IS NOT NULL AND v2 IS NOT NULL AND c IS NOT NULL) SELECT ts, '1-URGENT' AS symbol, (round(w, 4) + 0.0)::DOUBLE AS weight FROM w UNION ALL SELECT ts, '2-HIGH', (round(1 - w, 4) + 0.0)::DOUBLE FROM w""")
def min_variance_two(spark, sf_dir):
    cov = _yearly_cov(spark, sf_dir).where("a in ('1-URGENT', '2-HIGH') and b in ('1-URGENT', '2-HIGH')")
    cov = cov.join(cov.where("a <> b and cov is not null").select("ts").distinct(), "ts", "left_semi")
    return alloc.optimise(cov, "min_variance").select("ts", "symbol", (F.round("weight", 4) + F.lit(0.0)).alias("weight"))


@query("risk_parity")
def risk_parity(spark, sf_dir):
    return alloc.optimise(_yearly_cov(spark, sf_dir), "risk_parity").select("ts", "symbol", r6("weight", "weight"))


@query("mean_variance")
def mean_variance(spark, sf_dir):
    mu = _returns(spark, sf_dir).groupBy(F.date_trunc("year", "ts").cast("timestamp_ntz").alias("ts"), "symbol").agg((F.avg("r") * 252).alias("mu"))
    return alloc.optimise(_yearly_cov(spark, sf_dir), "max_sharpe", alloc.Bounds(high=0.5), mu).select("ts", "symbol", r6("weight", "weight"))


@query("target_vol_min_variance")
def target_vol_min_variance(spark, sf_dir):
    cov = _yearly_cov(spark, sf_dir)
    w = alloc.optimise(cov, "min_variance").select("ts", "symbol", "weight")
    return alloc.target_volatility(w, cov, 0.1, 1.0).select("ts", "symbol", r6("weight", "weight"))


@query("factor_neutral")
def factor_neutral(spark, sf_dir):
    """Risk parity on the risk model's total covariance, hedged against momentum."""
    b, fc, sp, _ = _model(spark, sf_dir)
    cov = risk.total_covariance(b, fc, sp).withColumn("ts", F.lit(_AT).cast("timestamp_ntz"))
    w = alloc.optimise(cov, "risk_parity").select("symbol", "weight")
    return risk.hedge(w, b, ["m"]).select("symbol", r6("weight", "weight"))


@query("ml_linear", f"""WITH d AS (SELECT symbol, ts, r AS x, lead(close) OVER (PARTITION BY symbol ORDER BY ts) / close - 1 AS y FROM rets_o),
m AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM d WHERE x IS NOT NULL AND y IS NOT NULL)
SELECT symbol, ts, {R('a + b * x')} AS score FROM d, m WHERE x IS NOT NULL""")
def ml_linear(spark, sf_dir):
    from ..functions.expr import col
    from ..operators import ml

    panel = compile(bars_o(spark, sf_dir), {"x": fx.returns(), "close": col("close")})
    predict, _ = ml.fit(ml.training_rows(panel, ["x"]), ["x"])
    return ml.scores(predict, panel, ["x"]).select("symbol", "ts", r6("score", "score"))
