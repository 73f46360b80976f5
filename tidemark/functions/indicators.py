"""Indicators over ordered daily bars.

Every function returns a Column over the same window (ticker, date), so any set of them costs
one shuffle by ticker. Bars are unique by (ticker, date): a ticker holds at most one row per
trading day, which bounds each window partition by the length of the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec, functions as F

from tidemark import constants as C
from tidemark.operators.sliding import Ladder, line_fit


def by_ticker() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("date")


def whole_ticker() -> WindowSpec:
    """All rows of a ticker, ordered like ``by_ticker`` so that both share one sort."""
    return by_ticker().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def trailing(n: int, spec: WindowSpec | None = None) -> WindowSpec:
    return (spec or by_ticker()).rowsBetween(1 - n, 0)


def running(spec: WindowSpec | None = None) -> WindowSpec:
    return (spec or by_ticker()).rowsBetween(Window.unboundedPreceding, 0)


def row_number(spec: WindowSpec | None = None) -> Column:
    return F.row_number().over(spec or by_ticker())


def previous(column: Column, n: int = 1, spec: WindowSpec | None = None) -> Column:
    return F.lag(column, n).over(spec or by_ticker())


def change(column: Column, n: int = 1, spec: WindowSpec | None = None) -> Column:
    return column - previous(column, n, spec)


def rolling_mean(column: Column, n: int, min_periods: int | None = None,
                 row: Column | None = None, spec: WindowSpec | None = None) -> Column:
    """Mean of the last ``n`` rows, null below ``min_periods`` known values.

    ``row`` is the row number: pass it for a column without nulls, then no count is needed.
    """
    min_periods = n if min_periods is None else min_periods
    mean = F.avg(column).over(trailing(n, spec))
    if min_periods <= 1:
        return mean
    known = row if row is not None else F.count(column).over(trailing(n, spec))
    return F.when(known >= min_periods, mean)


def gain_loss(price: Column) -> tuple[Column, Column]:
    """Rise and fall against the bar before; the first bar counts as no change."""
    delta = change(price)
    return (F.coalesce(F.when(delta > 0, delta), F.lit(0.0)),
            F.coalesce(F.when(delta < 0, -delta), F.lit(0.0)))


def rsi_of(gain: Column, loss: Column, row: Column, n: int = 14) -> Column:
    """Relative strength on simple means of the gains and losses of ``gain_loss``."""
    up, down = rolling_mean(gain, n, n, row), rolling_mean(loss, n, n, row)
    return F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + up / (down + C.EPSILON))


def bollinger(price: Column, row: Column, n: int = 20) -> tuple[Column, Column]:
    """Lower band and position between the bands (two sample deviations)."""
    mid = rolling_mean(price, n, n, row)
    dev = F.when(row >= n, F.stddev_samp(price).over(trailing(n)))
    lower, upper = mid - dev * 2, mid + dev * 2
    return lower, (price - lower) / F.nullif(upper - lower, F.lit(0.0))


def true_range(high: Column, low: Column, price: Column, has_range: Column) -> Column:
    """Daily range including gaps; absolute change for tickers that never carry high and low."""
    before = previous(price)
    full = F.greatest(high - low, F.abs(high - before), F.abs(low - before))
    return F.when(has_range, full).otherwise(F.abs(price - before))


def has_high_low(high: Column, low: Column) -> Column:
    return (F.count(high).over(whole_ticker()) > 0) & (F.count(low).over(whole_ticker()) > 0)


def signed_volume(price: Column, volume: Column) -> Column:
    """Volume signed by the day's move; its running sum is on-balance volume."""
    return F.coalesce(F.signum(change(price)) * volume, F.lit(0.0))


def log_price(price: Column) -> dict[str, Column]:
    """Log price relative to the ticker's first bar (the shift keeps squares small), and how often
    the price has changed so far."""
    changed = F.coalesce((change(price) != 0).cast("int"), F.lit(0))
    return {"_log": F.log(price / F.first(price).over(running())), "_changed": changed}


def price_ladder() -> Ladder:
    """Sums of price ``p``, log price ``y`` and its square, ready for means and line fits."""
    y = F.col("_log")
    return Ladder({"p": F.col("price"), "y": y, "yy": y * y}, "ticker", "date", C.MOMENTUM_WINDOW,
                  aged=("y",))


def changes_so_far() -> Column:
    return F.sum("_changed").over(running())


def trend_sums(ladder: Ladder, n: int = C.MOMENTUM_WINDOW) -> dict[str, Column]:
    """Columns ``trend_fit`` reads, over the ``n`` bars before the current one."""
    flat = previous(F.col("_changes"), 1) == previous(F.col("_changes"), n)
    return {**ladder.fit_sums("y", "yy", n, skip=1), "_flat": flat}


def trend_fit(n: int = C.MOMENTUM_WINDOW) -> Column:
    """Share of variance of log prices explained by a straight line.

    A flat series has a fit of 1; equal counts of price changes tell it exactly.
    """
    fit = line_fit(n)
    return F.when(fit.isNotNull(), F.when(F.col("_flat"), 1.0).otherwise(fit))


def rate_of_change(price: Column, skip_last: bool, n: int = C.MOMENTUM_WINDOW) -> Column:
    """Yearly change, to the current bar or (``skip_last``) to the bar before it."""
    start = previous(price, n)
    end = previous(price, 1) if skip_last else price
    return (end - start) / start


def regime(price: Column, sma50: Column) -> Column:
    return (
        F.when(price > sma50 * 1.02, "BULL").when(price < sma50 * 0.98, "BEAR").otherwise("NEUTRE")
    )
