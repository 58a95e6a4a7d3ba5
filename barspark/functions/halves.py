"""Aggregates over the last n rows in constant work a row, put together from two halves.

A symbol's rows fall into blocks of n. The last n rows up to a row are then the end of one
block and the beginning of the next: an aggregate that runs backwards over the first block
and one that runs forwards over the second meet, and nothing is ever subtracted, so sums
keep their digits however long the history. Each half is a growing frame, which Spark
extends by one row at a time, where a sliding frame of n rows is added up anew for each
row. Sums, counts, extremes and means merge as such; second to fourth moments merge by the
halves' means.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .expr import OWN, Expr, row, window


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


@dataclass(frozen=True)
class Halves:
    n: int
    over: str = OWN

    @property
    def place(self) -> Expr:
        return window(("row",), lambda: F.row_number().over(W.partitionBy("symbol").orderBy("ts")).cast("double"), over=self.over)

    @property
    def block(self) -> Expr:
        return row(f"block{self.n}", lambda p: F.floor((p - 1) / self.n), self.place)

    def of(self, fn: str, *xs: Expr) -> tuple[Expr, Expr]:
        """The built-in aggregate over the part of the frame in the block before (null if there is none), and over the part in the row's own block."""
        n = self.n
        ahead = lambda b: W.partitionBy("symbol", b).orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
        back = lambda b: W.partitionBy("symbol", b).orderBy(F.desc("ts")).rowsBetween(W.unboundedPreceding, 0)
        head = window((fn, "ahead", n), lambda *c: getattr(F, fn)(*c[:-1]).over(ahead(c[-1])), *xs, self.block, over=self.over)
        tail = window((fn, "back", n), lambda *c: getattr(F, fn)(*c[:-1]).over(back(c[-1])), *xs, self.block, over=self.over)
        first = window(("lag", n - 1), lambda c: F.lag(c, n - 1).over(W.partitionBy("symbol").orderBy("ts")), tail, over=self.over)
        return row(f"before{n}", lambda c, p: F.when((p > n) & (p % n != 0), c), first, self.place), head

    def _merged(self, name: str, make, *parts: tuple[Expr, Expr]) -> Expr:
        """make(first half, second half, ...) of each pair in turn."""
        return row(f"{name}{self.n}", make, *[x for p in parts for x in p])

    def count(self, x: Expr) -> Expr:
        return self._merged("count", lambda a, b: F.coalesce(a, F.lit(0)) + b, self.of("count", x))

    def sum(self, x: Expr) -> Expr:
        return self._merged("sum", lambda a, b: F.when(a.isNotNull() | b.isNotNull(), _zero(a) + _zero(b)), self.of("sum", x))

    def avg(self, x: Expr) -> Expr:
        return row("mean", lambda s, k: F.try_divide(s, k), self.sum(x), self.count(x))

    def min(self, x: Expr) -> Expr:
        return self._merged("min", F.least, self.of("min", x))

    def max(self, x: Expr) -> Expr:
        return self._merged("max", F.greatest, self.of("max", x))

    def _gap(self, x: Expr) -> Expr:
        """The second half's mean less the first's; 0 without one of them, or if it is no more than the rounding of the two."""
        eps = 4e-16 * self.n

        def gap(a, b):
            return F.when(F.abs(b - a) > eps * F.greatest(F.abs(a), F.abs(b)), b - a).otherwise(0.0)

        return self._merged("gap", gap, self.of("avg", x))

    def _weight(self, x: Expr) -> Expr:
        return self._merged("weight", lambda a, b: _zero(F.try_divide(a * b, a + b)), self.of("count", x))

    def _spread(self, x: Expr) -> tuple[Expr, Expr]:
        """Of each half, the sum of squares around its mean."""
        times = lambda v, k: row("times", lambda a, b: _zero(a * b), v, k)
        (v0, v1), (k0, k1) = self.of("var_pop", x), self.of("count", x)
        return times(v0, k0), times(v1, k1)

    def squares(self, x: Expr) -> Expr:
        """The sum of squares around the mean."""
        a, b = self._spread(x)
        return a + b + self._gap(x) * self._gap(x) * self._weight(x)

    def products(self, y: Expr, x: Expr) -> Expr:
        """The sum of products around the means, over rows that have both (each is null where the other is)."""
        (c0, c1), (k0, k1) = self.of("covar_pop", y, x), self.of("count", x)
        times = lambda v, k: row("times", lambda a, b: _zero(a * b), v, k)
        return times(c0, k0) + times(c1, k1) + self._gap(y) * self._gap(x) * self._weight(x)

    def _over(self, total: Expr, x: Expr, less: int) -> Expr:
        return row(f"less{less}", lambda s, k: F.when(k > less, s / (k - less)), total, self.count(x))

    def var_samp(self, x: Expr) -> Expr:
        return self._over(self.squares(x), x, 1)

    def var_pop(self, x: Expr) -> Expr:
        return self._over(self.squares(x), x, 0)

    def stddev_samp(self, x: Expr) -> Expr:
        return row("sqrt", F.sqrt, self.var_samp(x))

    def stddev_pop(self, x: Expr) -> Expr:
        return row("sqrt", F.sqrt, self.var_pop(x))

    def covar_samp(self, y: Expr, x: Expr) -> Expr:
        return self._over(self.products(*_paired(y, x)), _paired(y, x)[0], 1)

    def covar_pop(self, y: Expr, x: Expr) -> Expr:
        return self._over(self.products(*_paired(y, x)), _paired(y, x)[0], 0)

    def regr_slope(self, y: Expr, x: Expr) -> Expr:
        y, x = _paired(y, x)
        return self.products(y, x) / self.squares(x)

    def regr_r2(self, y: Expr, x: Expr) -> Expr:
        """Null if x does not vary, 1 if only y does not."""
        y, x = _paired(y, x)
        return row("r2", lambda c, a, b: F.when(a > 0, F.coalesce(F.try_divide(c * c, a * b), F.lit(1.0))), self.products(y, x), self.squares(x), self.squares(y))

    def _cubes(self, x: Expr) -> tuple[Expr, Expr]:
        made = lambda g, s, k: row("cubes", lambda a, b, c: F.when(b > 0, a * b * F.sqrt(b / c)).otherwise(0.0), g, s, k)
        (g0, g1), (s0, s1), (k0, k1) = self.of("skewness", x), self._spread(x), self.of("count", x)
        return made(g0, s0, k0), made(g1, s1, k1)

    def third(self, x: Expr) -> Expr:
        """The sum of cubes around the mean."""
        (c0, c1), (s0, s1), (k0, k1) = self._cubes(x), self._spread(x), self.of("count", x)

        def make(c0, c1, s0, s1, k0, k1, d):
            n = k0 + k1
            return c0 + c1 + _zero(d * d * d * k0 * k1 * (k0 - k1) / (n * n) + 3.0 * d * (k0 * s1 - k1 * s0) / n)

        return row(f"third{self.n}", make, c0, c1, s0, s1, k0, k1, self._gap(x))

    def fourth(self, x: Expr) -> Expr:
        """The sum of fourth powers around the mean."""
        made = lambda g, s, k: row("powers", lambda a, b, c: F.when(b > 0, (a + 3.0) * b * b / c).otherwise(0.0), g, s, k)
        (g0, g1), (c0, c1), (s0, s1), (k0, k1) = self.of("kurtosis", x), self._cubes(x), self._spread(x), self.of("count", x)

        def make(q0, q1, c0, c1, s0, s1, k0, k1, d):
            n = k0 + k1
            apart = d * d * d * d * k0 * k1 * (k0 * k0 - k0 * k1 + k1 * k1) / (n * n * n)
            return q0 + q1 + _zero(apart + 6.0 * d * d * (k0 * k0 * s1 + k1 * k1 * s0) / (n * n) + 4.0 * d * (k0 * c1 - k1 * c0) / n)

        return row(f"fourth{self.n}", make, made(g0, s0, k0), made(g1, s1, k1), c0, c1, s0, s1, k0, k1, self._gap(x))

    def skewness(self, x: Expr) -> Expr:
        return row("skewness", lambda m, s, k: F.when(s > 0, m / s * F.sqrt(k / s)), self.third(x), self.squares(x), self.count(x))

    def kurtosis(self, x: Expr) -> Expr:
        return row("kurtosis", lambda m, s, k: F.when(s > 0, k * m / (s * s) - 3.0), self.fourth(x), self.squares(x), self.count(x))


def _paired(y: Expr, x: Expr) -> tuple[Expr, Expr]:
    return row("both_y", lambda a, b: F.when(b.isNotNull(), a), y, x), row("both_x", lambda a, b: F.when(a.isNotNull(), b), y, x)


MERGED = frozenset("count sum avg min max var_samp var_pop stddev_samp stddev_pop covar_samp covar_pop regr_slope regr_r2 skewness kurtosis".split())
