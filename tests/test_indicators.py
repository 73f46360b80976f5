"""Indicators against plain pandas and at every warm-up boundary."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import bar_rows, bars, walk, weekdays
from tidemark.operators.sliding import Ladder, pieces
from tidemark.plans.analysis import indicators as analysis_indicators
from tidemark.plans.ranking import ranking_indicators
from tidemark.plans.signals import raw_signals


def frame(df):
    return df.orderBy("ticker", "date").toPandas().set_index("date")


def close(a, b, tol=1e-9):
    a, b = np.asarray(a, float), np.asarray(b, float)
    assert np.array_equal(np.isnan(a), np.isnan(b))
    assert np.allclose(a, b, rtol=tol, atol=tol, equal_nan=True)


@pytest.mark.parametrize("n", [1, 3, 4, 5, 63, 64, 150, 200, 252])
def test_pieces_cover_the_window(n):
    parts = pieces(n, 64)
    rows = [back + i for size, back in parts for i in range(size)]
    assert rows == list(range(n))


def test_ladder_sums_match_brute_force(spark):
    prices = walk(3, 300)
    df = bars(spark, bar_rows("A", prices)).withColumn("price", F.col("adj_close"))
    ladder = Ladder({"p": F.col("price")}, "ticker", "date", 100, aged=("p",))
    out = frame(ladder.build(df).select("ticker", "date", ladder.total("p", 100, 1).alias("s"),
                                        ladder.aged("p", 37).alias("a")))
    for i in range(300):
        if i >= 100:
            assert math.isclose(out["s"].iloc[i], sum(prices[i - 100:i]), rel_tol=1e-12)
        if i >= 36:
            want = sum(j * prices[i - j] for j in range(37))
            assert math.isclose(out["a"].iloc[i], want, rel_tol=1e-12)
    assert out["s"].iloc[:100].isna().all() and out["a"].iloc[:36].isna().all()


def r2(y):
    x = np.arange(len(y))
    if np.ptp(y) == 0:
        return 1.0
    return np.corrcoef(x, y)[0, 1] ** 2


def test_ranking_indicators_match_pandas(spark):
    n = 420
    prices = walk(7, n, drift=0.001)
    prices[300:] = [prices[299]] * 20 + prices[320:]
    data = bar_rows("A", prices, seed=5)
    out = frame(ranking_indicators(bars(spark, data)))
    p = pd.DataFrame(data, columns=["t", "d", "o", "h", "l", "c", "a", "v"])
    close(out["sma_200"], p.a.rolling(200, min_periods=200).mean())
    close(out["sma_150"], p.a.rolling(150, min_periods=150).mean())
    close(out["rvol"], p.v / (p.v.rolling(20, min_periods=1).mean() + 1e-9))
    signed = np.sign(p.a.diff()).fillna(0) * p.v
    close(out["obv_slope"], signed.cumsum().diff(10))
    before = p.a.shift(1)
    tr = pd.concat([p.h - p.l, (p.h - before).abs(), (p.l - before).abs()], axis=1).max(axis=1)
    close(out["atr_14"], tr.rolling(14, min_periods=1).mean())
    want = [np.nan] * 252 + [
        (prices[i] - prices[i - 252]) / prices[i - 252] * r2(np.log(prices[i - 252:i]))
        for i in range(252, n)]
    close(out["mom_r2"], want, 1e-7)


def test_flat_series(spark):
    prices = [50.0] * 280 + [60.0]
    out = frame(ranking_indicators(bars(spark, bar_rows("A", prices, high_low=False))))
    assert out["mom_r2"].iloc[279] == 0.0
    assert math.isclose(out["mom_r2"].iloc[280], 0.2)
    a = frame(analysis_indicators(bars(spark, bar_rows("A", prices, high_low=False))))
    assert a["bb_position"].iloc[:280].isna().all()
    assert a["atr_14"].isna().iloc[0] and a["atr_14"].iloc[5] == 0.0


@pytest.mark.parametrize("n,rows", [(259, 0), (260, 260)])
def test_history_floor(spark, n, rows):
    assert ranking_indicators(bars(spark, bar_rows("A", walk(1, n)))).count() == rows


def test_analysis_matches_pandas_and_needs_fifty_rows(spark):
    long, short = walk(11, 120), walk(12, 49)
    data = bar_rows("A", long, seed=1) + bar_rows("B", short, seed=2)
    out = analysis_indicators(bars(spark, data)).orderBy("ticker", "date").toPandas()
    b = out[out.ticker == "B"]
    assert b[["rsi_14", "sma_200", "atr_14", "regime"]].isna().all().all()
    a = out[out.ticker == "A"].reset_index(drop=True)
    p = pd.Series(long)
    delta = p.diff()
    up, down = delta.clip(lower=0).fillna(0), (-delta).clip(lower=0).fillna(0)
    close(a["rsi_14"], 100 - 100 / (1 + up.rolling(14).mean() / (down.rolling(14).mean() + 1e-9)))
    assert a["rsi_14"].first_valid_index() == 13
    mid, sd = p.rolling(20).mean(), p.rolling(20).std()
    close(a["bb_lower"], mid - 2 * sd)
    close(a["rsi_slope"], a["rsi_14"].diff(3))
    close(a["sma_200"], p.rolling(200, min_periods=1).mean())
    m = p.rolling(50, min_periods=1).mean()
    want = np.where(p > m * 1.02, "BULL", np.where(p < m * 0.98, "BEAR", "NEUTRE"))
    assert list(a["regime"]) == list(want)


def test_missing_prices_and_volumes(spark):
    day = weekdays(60)
    data = bar_rows("A", walk(2, 60), day, seed=3)
    data[10] = ("A", day[10], None, None, None, None, None, None)
    data[11] = ("A", day[11], 5.0, 6.0, 4.0, 5.0, None, None)
    out = frame(analysis_indicators(bars(spark, data)))
    assert day[10] not in out.index
    assert out.loc[day[11], "adj_close"] == 5.0
    assert out["vol_avg_20"].loc[day[11]:day[30]].isna().all()
    assert not np.isnan(out["vol_avg_20"].loc[day[31]])


def test_scaling_prices_leaves_ratios(spark):
    prices = walk(5, 300)
    one = frame(ranking_indicators(bars(spark, bar_rows("A", prices, high_low=False))))
    ten = frame(ranking_indicators(bars(spark, bar_rows("A", [p * 10 for p in prices], high_low=False))))
    close(one["mom_r2"], ten["mom_r2"], 1e-8)
    close(one["rvol"], ten["rvol"])


def test_signal_variant_uses_open_mean_and_lagged_change(spark):
    prices = walk(9, 320, drift=0.002)
    out = frame(raw_signals(bars(spark, bar_rows("A", prices))))
    p = pd.Series(prices)
    close(out["sma_200"], p.rolling(200, min_periods=1).mean())
    i = 300
    want = (prices[i - 1] - prices[i - 252]) / prices[i - 252] * r2(np.log(prices[i - 252:i]))
    assert math.isclose(out["mom_r2"].iloc[i], want, rel_tol=1e-7)
    assert list(out["breakout"]) == list(p >= p.rolling(50, min_periods=1).max())
