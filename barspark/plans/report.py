"""A Markdown report from small aggregates of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import results as rs


def _table(head: str, rows: dict) -> list[str]:
    return ["", f"## {head}", "", "| metric | value |", "|-|-|", *[f"| {k} | {v:.6g} |" for k, v in rows.items() if v is not None]]


def markdown(equity: DataFrame, trades: DataFrame | None = None, title: str = "Backtest", unit: str = "month", regression: dict | None = None) -> str:
    """Metrics of an equity curve (ts, equity), of its trades, of their turnover and costs, and of a factor regression (as attribution() gives it): lines that Spark aggregates."""
    s = rs.summary(equity).first()
    span = equity.selectExpr("min(ts) AS a", "max(ts) AS b").first()
    lines = [f"# {title}", "", f"{span['a']} to {span['b']}, {s['bars']} bars.", "", "| metric | value |", "|-|-|"]
    lines += [f"| {k} | {s[k]:.6g} |" for k in ("final_equity", "total_return", "max_drawdown", "sharpe", "cagr", "sortino") if s[k] is not None]
    if trades is not None:
        lines += _table("Trades", rs.trade_summary(trades).first().asDict())
        turned = rs.size_turnover(trades, unit).agg(F.avg("turnover").alias(f"mean turnover a {unit}"), F.max("turnover").alias(f"highest turnover a {unit}")).first().asDict()
        costs = rs.costs(trades).first().asDict() if {"fees", "slippage"} <= set(trades.columns) else {}
        lines += _table("Turnover and costs", turned | costs)
    if regression is not None:
        lines += _table("Factor regression", {k: regression[k] for k in ("n", "alpha", "alpha_year", "t_alpha", "r2", "residual_std")} | {f"beta {f}": b for f, b in regression["betas"].items()} | {f"t of beta {f}": t for f, t in regression["t_stats"].items()})
    return "\n".join(lines) + "\n"


def html(equity: DataFrame, trades: DataFrame | None = None, title: str = "Backtest", first: int = 20, **kwargs) -> str:
    """The same as a page, with the first trades."""
    from html import escape

    body = "".join(f"<p>{escape(x)}</p>" if not x.startswith("#") else f"<h2>{escape(x.lstrip('# '))}</h2>" for x in markdown(equity, trades, title, **kwargs).splitlines() if x and not x.startswith("|-"))
    rows = trades.orderBy("entry_time", "symbol").limit(first).toPandas().to_html(index=False) if trades is not None else ""
    return f"<!doctype html><title>{escape(title)}</title>{body}{rows}"
