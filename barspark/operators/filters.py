"""Screens: nodes that turn factor columns into a boolean column of the panel."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import factors
from ..functions.expr import Expr


class Filter:
    """needs: expressions it reads, by name; mask: a boolean Column over their columns."""

    def needs(self) -> dict[str, Expr]:
        return {}

    def mask(self, name: dict) -> Column:
        raise NotImplementedError

    def __and__(self, other):
        return Both(self, other)

    def __or__(self, other):
        return Either(self, other)

    def __invert__(self):
        return Not(self)


def _of(source: Expr | str, name: dict) -> Column:
    """The column of an expression, or of a factor of that name."""
    key = source if isinstance(source, str) else source.key
    if key not in name:
        raise ValueError(f"no factor named {source!r}")
    return F.col(name[key])


@dataclass
class TopN(Filter):
    """The n largest (ascending: least) at each time; missing values never; ties to the first symbol."""

    source: Expr | str
    n: int
    ascending: bool = False

    def needs(self):
        return {} if isinstance(self.source, str) else {self.source.key: self.source}

    def mask(self, name):
        v = _of(self.source, name)
        place = F.row_number().over(W.partitionBy("ts").orderBy(v.asc_nulls_last() if self.ascending else v.desc_nulls_last(), "symbol"))
        return v.isNotNull() & (place <= self.n)


def bottom_n(source: Expr | str, n: int) -> TopN:
    return TopN(source, n, ascending=True)


@dataclass
class Percentile(Filter):
    """Values at or above (ascending: at or below) the quantile 1 - top/100, or bottom/100, of the time's values, interpolated linearly."""

    source: Expr | str
    top: float | None = None
    bottom: float | None = None
    ascending: bool = False

    def __post_init__(self):
        if (self.top is None) == (self.bottom is None):
            raise ValueError("give top or bottom")

    needs = TopN.needs

    def mask(self, name):
        v = _of(self.source, name)
        q = 1 - self.top / 100 if self.top is not None else self.bottom / 100
        bound = F.percentile(v, F.lit(q)).over(W.partitionBy("ts"))
        return F.coalesce(v <= bound if self.ascending else v >= bound, F.lit(False))


@dataclass
class Compare(Filter):
    """v >= least and v <= most, where given."""

    source: Expr | str
    least: float | None = None
    most: float | None = None

    needs = TopN.needs

    def mask(self, name):
        v = _of(self.source, name)
        ok = F.lit(True)
        ok = ok & (v >= self.least) if self.least is not None else ok
        ok = ok & (v <= self.most) if self.most is not None else ok
        return F.coalesce(ok, F.lit(False))


def liquidity(top_n: int | None = None, least: float | None = None, window: int = 20) -> Filter:
    return TopN(factors.dollar_volume(window), top_n) if top_n is not None else Compare(factors.dollar_volume(window), least=least)


def low_volatility(percentile: float | None = None, most: float | None = None, window: int = 63, ascending: bool = True) -> Filter:
    """The quietest per cent (ascending=False: the others), or volatility at most `most`."""
    return Percentile(factors.volatility(window), bottom=percentile, ascending=ascending) if percentile is not None else Compare(factors.volatility(window), most=most)


@dataclass
class Named(Filter):
    """A filter of the pipeline, by name."""

    filter_name: str

    def mask(self, name):
        if ("filter", self.filter_name) not in name:
            raise ValueError(f"no filter named {self.filter_name!r}")
        return name["filter", self.filter_name].mask(name)


def _filter(x: Filter | str) -> Filter:
    return Named(x) if isinstance(x, str) else x


@dataclass
class Both(Filter):
    a: Filter | str
    b: Filter | str

    def needs(self):
        return _filter(self.a).needs() | _filter(self.b).needs()

    def mask(self, name):
        return _filter(self.a).mask(name) & _filter(self.b).mask(name)


class Either(Both):
    def mask(self, name):
        return _filter(self.a).mask(name) | _filter(self.b).mask(name)


@dataclass
class Not(Filter):
    a: Filter | str

    def needs(self):
        return _filter(self.a).needs()

    def mask(self, name):
        return ~_filter(self.a).mask(name)
