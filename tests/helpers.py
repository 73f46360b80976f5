"""Small data makers for the tests."""

import datetime as dt
import random

from tidemark import schemas as S

START = dt.date(2020, 1, 1)


def weekdays(n: int, start: dt.date = START) -> list[dt.date]:
    out, day = [], start
    while len(out) < n:
        if day.weekday() < 5:
            out.append(day)
        day += dt.timedelta(days=1)
    return out


def walk(seed: int, n: int, start: float = 100.0, drift: float = 0.0, vol: float = 0.02) -> list[float]:
    rng = random.Random(seed)
    out, price = [], start
    for _ in range(n):
        price = max(1.0, price * (1 + drift + rng.gauss(0, vol)))
        out.append(round(price, 2))
    return out


def bar_rows(ticker: str, prices, dates=None, seed: int = 0, high_low: bool = True):
    rng = random.Random(seed)
    dates = dates or weekdays(len(prices))
    out = []
    for day, p in zip(dates, prices):
        spread = round((p or 1.0) * rng.uniform(0.0, 0.03), 2)
        hi, lo = ((p + spread, p - spread) if high_low and p is not None else (None, None))
        out.append((ticker, day, p, hi, lo, p, p, float(rng.randint(100, 1000))))
    return out


def bars(spark, rows):
    return spark.createDataFrame(rows, S.BARS)


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
