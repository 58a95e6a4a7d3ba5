"""Registered queries of the engine, each with SQL that DuckDB runs on the same tables.

A module of this package registers with @query(name, sql). The SQL may use the panels of PANELS; sql() puts their definitions before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FLAGSHIP = "three_day_breakout"

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}

_EVENT_BARS = "SELECT event_type AS symbol, date_trunc('{0}', ts)::TIMESTAMP AS ts, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2"
PANELS = {
    "bars_h": _EVENT_BARS.format("hour"),
    "bars_d": _EVENT_BARS.format("day"),
    "bars_o": "SELECT o_orderpriority AS symbol, o_orderdate AS ts, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*)::DOUBLE AS volume FROM orders GROUP BY 1, 2",
    "bars_s": "SELECT symbol, ts, arg_min(p, k) AS open, max(p) AS high, min(p) AS low, arg_max(p, k) AS close, sum(v) AS volume FROM (SELECT l_suppkey::VARCHAR AS symbol, l_shipdate AS ts, l_extendedprice / l_quantity AS p, row(l_orderkey, l_linenumber, l_partkey, l_extendedprice / l_quantity) AS k, l_quantity AS v FROM lineitem) GROUP BY 1, 2",
    "equity": "SELECT ts, avg(close) AS equity FROM bars_d GROUP BY ts",
    "rets_h": "SELECT symbol, ts, close, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS r FROM bars_h",
    "rets_o": "SELECT symbol, ts, close, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS r FROM bars_o",
    "rets_d": "SELECT symbol, ts, close, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS r FROM bars_d",
}
_NEEDS = {"equity": "bars_d", "rets_h": "bars_h", "rets_o": "bars_o", "rets_d": "bars_d"}


def with_panels(sql: str) -> str:
    """The SQL with the panels that it names defined before it."""
    import re

    used = [p for p in PANELS if re.search(rf"\b{p}\b", sql)]
    used += [_NEEDS[p] for p in used if p in _NEEDS and _NEEDS[p] not in used]
    head = ", ".join(f"{p} AS ({PANELS[p]})" for p in PANELS if p in used)
    if not head:
        return sql
    body = sql.strip()
    recursive = body.upper().startswith("WITH RECURSIVE ")
    if recursive or body.upper().startswith("WITH "):
        return f"WITH {'RECURSIVE ' if recursive else ''}{head}, {body[15 if recursive else 5:]}"
    return f"WITH {head} {body}"


def query(name: str, sql: str | None = None):
    """Registers a query under name."""

    def register(f):
        if name in _queries:
            raise ValueError(f"{name} is registered already")
        _queries[name] = f
        if sql:
            _sql[name] = with_panels(sql)
        return f

    return register


def r6(c: Column | str, name: str | None = None) -> Column:
    """Rounded to 6 places, without negative zero: the millionfold rounded to a whole number, as SQL's round has it (decimal digits of the value itself differ at ties)."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.round(c.cast("double") * 1e6) / F.lit(1e6) + F.lit(0.0)
    return out.alias(name) if name else out


def R(sql: str) -> str:
    """The same in SQL."""
    return f"(round(({sql})::DOUBLE, 6) + 0.0::DOUBLE)"


def queries():
    from . import engine, joins, portfolio, research, results, sources, strategies, windows  # noqa: F401

    return dict(_queries)


def oracle_sql():
    queries()
    return dict(_sql)
