"""Row-frame statistics with a minimum count of present values.

A rolling statistic over n rows is NULL until ``least`` values are present in
the frame, as pandas ``rolling(n, min_periods=least)`` has it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from .numeric import pct_change, zscore


class Rolling:
    """Collects the window aggregates a set of features needs, each once.

    Features that share a mean, deviation or count then share its evaluation:
    Spark computes every window expression it is given, equal or not.
    """

    def __init__(self, w: WindowSpec):
        self.w = w
        self._needed: dict[str, Column] = {}

    def _window(self, kind: str, column: str, stat: Column, n: int, skip: int) -> Column:
        name = f"__{kind}_{column}_{n}_{skip}"
        self._needed.setdefault(name, stat.over(self.w.rowsBetween(-(n - 1) - skip, -skip)))
        return F.col(name)

    def _gated(self, kind: str, column: str, stat: Column, n: int, least: int | None, skip: int) -> Column:
        present = self._window("n", column, F.count(column), n, skip)
        return F.when(present >= (n if least is None else least), self._window(kind, column, stat, n, skip))

    def mean(self, column: str, n: int, least: int | None = None, skip: int = 0) -> Column:
        return self._gated("avg", column, F.avg(column), n, least, skip)

    def sd(self, column: str, n: int, least: int | None = None, skip: int = 0) -> Column:
        return self._gated("sd", column, F.stddev_samp(column), n, least, skip)

    def low(self, column: str, n: int, least: int | None = None, skip: int = 0) -> Column:
        return self._gated("min", column, F.min(column), n, least, skip)

    def high(self, column: str, n: int, least: int | None = None, skip: int = 0) -> Column:
        return self._gated("max", column, F.max(column), n, least, skip)

    def z(self, column: str, n: int, least: int | None = None) -> Column:
        return zscore(F.col(column), self.mean(column, n, least), self.sd(column, n, least))

    def lag(self, column: str, k: int) -> Column:
        name = f"__lag_{column}_{k}"
        self._needed.setdefault(name, F.lag(column, k).over(self.w))
        return F.col(name)

    def diff(self, column: str, k: int = 1) -> Column:
        return F.col(column) - self.lag(column, k)

    def pct(self, column: str, k: int = 1) -> Column:
        return pct_change(F.col(column), self.lag(column, k))

    def add(self, d: DataFrame, new: dict[str, Column]) -> DataFrame:
        """``d`` with the new features; the shared aggregates do not stay."""
        shared = d.select("*", *[c.alias(name) for name, c in self._needed.items()])
        return shared.select(*d.columns, *[c.alias(name) for name, c in new.items()])
