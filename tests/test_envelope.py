import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest

from tidemark.functions.envelope import LEVELS_SCHEMA, suffix_levels


@pytest.mark.parametrize("seed", range(6))
def test_levels_equal_a_walk_back(seed):
    r = random.Random(seed)
    n = [1, 2, 30, 200, 400, 400][seed]
    price, atr, p = [], [], 100.0
    for _ in range(n):
        p = max(1.0, p + r.choice([-2, -1, 0, 0, 1, 2.5]))
        price.append(p)
        atr.append(np.nan if seed == 3 and r.random() < 0.2 else r.choice([1.0, 1.5, 2.0, r.uniform(0.5, 4)]))
    if seed == 4:
        atr = [np.nan] * n
    days = [dt.date(2020, 1, 1) + dt.timedelta(i) for i in range(n)]
    bars = pd.DataFrame({"date": days, "price": price, "atr_14": atr}).sample(frac=1, random_state=seed)
    wanted = pd.DataFrame([("a", round(r.uniform(2, 4), 2), days[r.randrange(n)]) for _ in range(300)], columns=["ticker", "k", "first_bar"])
    got = suffix_levels(bars, wanted.drop_duplicates())
    assert list(got.columns) == [c.split()[0] for c in LEVELS_SCHEMA.split(", ")] and len(got) == len(wanted.drop_duplicates())
    filled = [atr[-1] if np.isnan(a) else a for a in atr]
    for row in got.itertuples():
        e = days.index(row.first_bar)
        least = [np.fmin.reduce(filled[u:]) for u in range(e, n)]
        levels = [price[u] - row.k * least[u - e] for u in range(e, n) if not np.isnan(least[u - e])]
        assert row.high_since == max(price[e:])
        assert np.array_equal([row.least_range, row.stop_since], [least[0], max(levels, default=np.nan)], equal_nan=True)


def test_nothing_asked():
    bars = pd.DataFrame({"date": [dt.date(2020, 1, 1)], "price": [1.0], "atr_14": [0.5]})
    none = pd.DataFrame({"ticker": [], "k": [], "first_bar": []})
    assert len(suffix_levels(bars, none)) == 0 and len(suffix_levels(bars.head(0), none)) == 0
