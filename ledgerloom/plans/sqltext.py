"""Small builders for the SQL that queries are checked against."""

from __future__ import annotations


def frame(part: str, order: str, n: int, skip: int = 0) -> str:
    last = f"{skip} PRECEDING" if skip else "CURRENT ROW"
    return f"(PARTITION BY {part} ORDER BY {order} ROWS BETWEEN {n - 1 + skip} PRECEDING AND {last})"


class Windowed:
    """SQL text of rolling statistics over one partitioning and order."""

    def __init__(self, part: str, order: str):
        self.part, self.order = part, order
        self.w = f"(PARTITION BY {part} ORDER BY {order})"

    def roll(self, agg: str, x: str, n: int, least: int | None = None, skip: int = 0) -> str:
        f = frame(self.part, self.order, n, skip)
        return f"(CASE WHEN count({x}) OVER {f} >= {n if least is None else least} THEN {agg}({x}) OVER {f} END)"

    def lag(self, x: str, k: int = 1) -> str:
        return f"lag({x}, {k}) OVER {self.w}"

    def lead(self, x: str, k: int = 1) -> str:
        return f"lead({x}, {k}) OVER {self.w}"

    def diff(self, x: str, k: int = 1) -> str:
        return f"({x} - {self.lag(x, k)})"

    def pct(self, x: str, k: int = 1) -> str:
        return f"({x} / nullif({self.lag(x, k)}, 0) - 1)"

    def z(self, x: str, n: int, least: int | None = None) -> str:
        sd = self.roll("stddev_samp", x, n, least)
        return f"(CASE WHEN {sd} > 1e-9 THEN ({x} - {self.roll('avg', x, n, least)}) / {sd} END)"

    def z0(self, x: str, n: int, least: int | None = None) -> str:
        return f"coalesce({self.z(x, n, least)}, 0)"
