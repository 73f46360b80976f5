"""Upper envelope of lines over suffixes of a series: one pass answers every factor.

Runs inside Spark tasks, so it depends on numpy and pandas alone.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd

LEVELS_SCHEMA = "ticker string, k double, first_bar date, high_since double, least_range double, stop_since double"


class Envelope:
    """Maximum of lines p - k * a over k, for lines that come with falling ``a``."""

    def __init__(self) -> None:
        self.price: list[float] = []
        self.range: list[float] = []
        self.since: list[float] = []  # factor from which a line is above the one before it

    def add(self, price: float, least: float) -> None:
        if self.price and self.range[-1] == least:
            if self.price[-1] >= price:
                return
            self.price.pop(), self.range.pop(), self.since.pop()
        since = -np.inf
        while self.price:
            since = (self.price[-1] - price) / (self.range[-1] - least)
            if since > self.since[-1]:
                break
            self.price.pop(), self.range.pop(), self.since.pop()
            since = -np.inf
        self.price.append(price)
        self.range.append(least)
        self.since.append(since)

    def at(self, k: float) -> float:
        """Greatest value at ``k``; neighbours are tried as well, as a crossing is only known up to rounding."""
        i = bisect_right(self.since, k) - 1
        near = range(max(0, i - 1), min(len(self.price), i + 2))
        return max((self.price[j] - k * self.range[j] for j in near), default=np.nan)


def suffix_levels(bars: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
    """Highest price, least range and greatest price - k * least range from a first bar to the end of one ticker.

    ``bars``: date, price, atr_14; a missing range counts as the newest one. ``wanted``: ticker, k, first_bar.
    """
    if not len(bars) or not len(wanted):
        return pd.DataFrame({c.split()[0]: [] for c in LEVELS_SCHEMA.split(", ")})
    bars = bars.sort_values("date")
    price, ranges = bars["price"].to_numpy(float), bars["atr_14"].to_numpy(float)
    ranges = np.where(np.isnan(ranges), ranges[-1], ranges)
    least = np.fmin.accumulate(ranges[::-1])[::-1]
    high = np.maximum.accumulate(price[::-1])[::-1]
    wanted = wanted.sort_values("first_bar", ascending=False)
    place = np.searchsorted(bars["date"].to_numpy(), wanted["first_bar"].to_numpy())
    hull, stop, at = Envelope(), [], len(price)
    for first, k in zip(place.tolist(), wanted["k"].tolist()):
        while at > first:
            at -= 1
            if not np.isnan(least[at]):
                hull.add(price[at], least[at])
        stop.append(hull.at(k))
    return wanted[["ticker", "k", "first_bar"]].assign(
        high_since=high[place], least_range=least[place], stop_since=stop)
