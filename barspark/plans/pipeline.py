"""A declarative pipeline of factors, filters and a screen, compiled to one DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import Expr, compile
from ..operators.filters import Filter, Named
from ..operators.panel import time_slice


@dataclass
class Pipeline:
    """factors by name, filters by name, and a screen (a filter or the name of one)."""

    factors: dict[str, Expr]
    filters: dict[str, Filter] = field(default_factory=dict)
    screen: Filter | str | None = None

    def run(self, panel: DataFrame, start=None, end=None, warm_up: bool = False, cache: bool = False) -> DataFrame:
        """symbol, ts, a column per factor, a boolean per filter, and `screen`.

        The panel is cut to [start, end] before factors are computed; with warm_up after, so that windows see earlier rows.
        """
        screen = Named(self.screen) if isinstance(self.screen, str) else self.screen
        if isinstance(self.screen, str) and self.screen not in self.filters:
            raise ValueError(f"no filter named {self.screen!r}")
        every = [*self.filters.values(), *([screen] if screen else [])]
        extra = {k: e for f in every for k, e in f.needs().items()}
        columns = dict(self.factors)
        name: dict = dict(zip(self.factors, self.factors))
        known = {e.key: n for n, e in self.factors.items()}
        for i, (k, e) in enumerate(extra.items()):
            if k not in known:
                known[k] = f"_f{i}"
                columns[known[k]] = e
        name |= known | {("filter", n): f for n, f in self.filters.items()}
        df = compile(panel if warm_up else time_slice(panel, start, end), columns)
        masks = {n: f.mask(name) for n, f in self.filters.items()} | ({"screen": screen.mask(name)} if screen else {})
        df = df.withColumns(masks) if masks else df
        df = time_slice(df, start, end) if warm_up else df
        out = df.select("symbol", "ts", *self.factors, *masks)
        return out.cache() if cache else out
