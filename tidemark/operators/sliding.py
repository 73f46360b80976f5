"""Long sliding sums in O(log n) steps per row.

Spark evaluates a sliding aggregate by walking its whole frame for every row. Here sums over 1, 4,
16, ... rows are built from each other with ``lag``; a frame of any length is then put together from
a few of them. Only additions are involved, so nothing cancels, and every step uses the same window
(one shuffle, one sort).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

STEP = 4


def pieces(n: int, longest: int) -> list[tuple[int, int]]:
    """(length, rows back) of the ladder pieces that make up ``n`` rows, newest first."""
    out, back, size = [], 0, longest
    while size:
        while n - back >= size:
            out.append((size, back))
            back += size
        size //= STEP
    return out


class Ladder:
    """Sums of some columns over 1, 4, 16, ... rows; null until enough rows came before.

    ``aged`` names columns that also get a sum weighted by the age of each row. The sums are long,
    so they are written as SQL text, which costs one call each to build.
    """

    def __init__(self, sums: dict[str, Column], key: str, order: str, longest: int,
                 aged: tuple[str, ...] = ()):
        self.sums, self.with_age = sums, aged
        self.over = f"OVER (PARTITION BY {key} ORDER BY {order})"
        self.longest = 1
        while self.longest * STEP <= longest:
            self.longest *= STEP

    def build(self, df: DataFrame) -> DataFrame:
        """Add the levels as columns."""
        df = df.withColumns({
            **{_at(n, 1): c for n, c in self.sums.items()},
            **{_at(_age(n), 1): F.lit(0.0) for n in self.with_age}})
        size = 1
        while size < self.longest:
            parts = [(size, i * size) for i in range(STEP)]
            df = df.withColumns({
                **{_at(n, size * STEP): self._sum(n, parts, 0) for n in self.sums},
                **{_at(_age(n), size * STEP): self._aged_sum(n, parts, 0) for n in self.with_age}})
            size *= STEP
        return df

    def total(self, name: str, n: int, skip: int = 0) -> Column:
        """Sum of the ``n`` rows that end ``skip`` rows before the current one."""
        return self._sum(name, pieces(n, self.longest), skip)

    def aged(self, name: str, n: int, skip: int = 0) -> Column:
        """Same sum with each row weighted by its age, 0 for the newest."""
        return self._aged_sum(name, pieces(n, self.longest), skip)

    def fit_sums(self, value: str, square: str, n: int, skip: int = 0) -> dict[str, Column]:
        """The three sums a line fit needs, to be added as columns before ``line_fit``."""
        return {"_fit_y": self.total(value, n, skip), "_fit_yy": self.total(square, n, skip),
                "_fit_xy": self.aged(value, n, skip)}

    def _sum(self, name: str, parts: list[tuple[int, int]], skip: int) -> Column:
        return F.expr(" + ".join(self._back(name, size, back + skip) for size, back in parts))

    def _aged_sum(self, name: str, parts: list[tuple[int, int]], skip: int) -> Column:
        return F.expr(" + ".join(
            f"{self._back(_age(name), size, back + skip)} + {self._back(name, size, back + skip)} * {back}D"
            for size, back in parts))

    def _back(self, name: str, size: int, rows: int) -> str:
        column = _at(name, size)
        return f"lag({column}, {rows}) {self.over}" if rows else column


def line_fit(n: int) -> Column:
    """Share of variance a straight line explains, from the columns of ``fit_sums``; 1 without any
    variance, null without ``n`` rows."""
    y, yy, xy = F.col("_fit_y"), F.col("_fit_yy"), F.col("_fit_xy")
    x = n * (n - 1) / 2.0
    xx = (n - 1) * n * (2 * n - 1) / 6.0 - x * x / n
    shared = xy - y * (x / n)
    spread = yy - y * y / float(n)
    fit = F.when(spread > 0, F.least(shared * shared / (spread * xx), F.lit(1.0))).otherwise(1.0)
    return F.when(y.isNotNull(), fit)


def _at(name: str, size: int) -> str:
    return f"_{name}_{size}"


def _age(name: str) -> str:
    return f"{name}_age"
