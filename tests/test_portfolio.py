"""Portfolio and signal backtests against a plain day-by-day simulation."""

import datetime as dt
import math
import random
from collections import defaultdict

import pytest

from helpers import bar_rows, bars, walk, weekdays
from tidemark import constants as C
from tidemark.plans import measures as M, portfolio as P, signals as SG
from tidemark.plans.ranking import ranking_indicators
from tidemark.session import stage

N_DAYS, N_TICKERS = 520, 14


def known_at(series, day):
    """Last value on or before a day; ``series`` is a sorted list of (date, value)."""
    value = None
    for d, v in series:
        if d > day:
            break
        value = v
    return value


@pytest.fixture(scope="module")
def market(spark):
    rng = random.Random(99)
    days = weekdays(N_DAYS)
    data = []
    for t in range(N_TICKERS):
        # Mondays are missing now and then, sometimes a whole week.
        own = [d for d in days if rng.random() > 0.06]
        if t % 4 == 0:
            own = [d for d in own if not (days[330] <= d <= days[338])]
        data += bar_rows(f"T{t:02d}", walk(t, len(own), drift=0.0012, vol=0.012), own, seed=t)
    ind = stage(ranking_indicators(bars(spark, data)), "ind")
    sectors = {f"T{t:02d}": "s1" if t % 3 else "s2" for t in range(N_TICKERS) if t % 5 != 4}
    zones = {t: (["US", "EU"] if i % 2 else ["EU", "US"]) for i, t in enumerate(sorted(sectors))}
    force = {(s, z): [(d, rng.random() > 0.15) for d in days[300::3]] for s in ("s1", "s2") for z in ("US", "EU")
             if (s, z) != ("s2", "EU")}
    macro = {z: [(d, rng.random() > 0.1) for d in days[200::7]] for z in ("US", "EU")}
    instruments = spark.createDataFrame(
        [(t, s, zones[t]) for t, s in sectors.items()], "ticker string, sector string, zone_priority array<string>")
    force_df = spark.createDataFrame([(s, z, d, v) for (s, z), x in force.items() for d, v in x],
                                     "sector string, zone string, date date, in_force boolean")
    macro_df = spark.createDataFrame([(z, d, v) for z, x in macro.items() for d, v in x],
                                     "zone string, date date, bull boolean")
    return ind, instruments, force_df, macro_df, sectors, zones, force, macro


def simulate(frame, config, sectors, zones, force, macro):
    """Sequential reference: holds state and walks every day."""
    by_ticker = defaultdict(dict)
    for r in frame.itertuples():
        by_ticker[r.ticker][r.date] = r
    days = sorted({d for x in by_ticker.values() for d in x})
    if config.start:
        days = [d for d in days if d >= config.start]
    if config.end:
        days = [d for d in days if d <= config.end]
    if len(days) > 302:
        days = days[302:]
    mondays = [d for d in days if d.weekday() == 0]

    def sector_ok(t, day):
        for z in zones.get(t, []):
            v = known_at(force.get((sectors[t], z), []), day)
            if v is not None:
                return v
        return True

    def macro_ok(t, day):
        v = known_at(macro[zones[t][0] if t in zones else "US"], day)
        return True if v is None else v

    def sma(r):
        return r.sma_150 if config.sma_period == 150 else r.sma_200

    def eligible(day):
        out = []
        for t, x in by_ticker.items():
            past = [d for d in x if d <= day]
            if not past or (day - max(past)).days > 5:
                continue
            r = x[max(past)]
            if not r.price > sma(r) or not r.mom_r2 > config.min_mom_r2 or not sector_ok(t, day):
                continue
            out.append((t, r))
        score = defaultdict(float)
        for m, w in (("mom_r2", 0.5), ("rvol", 0.25), ("obv_slope", 0.25)):
            values = [getattr(r, m) for _, r in out]
            for t, r in out:
                spread = max(values) - min(values)
                score[t] += w * ((getattr(r, m) - min(values)) / spread if spread > 0 else 0.5)
        return sorted([t for t, _ in out], key=lambda t: (-score[t], t))

    cash, held, trades, equity, weeks = C.CAPITAL, {}, [], [], []
    previous = None
    for monday in mondays:
        if previous:
            for day in [d for d in days if previous < d <= monday]:
                for t in list(held):
                    r = by_ticker[t].get(day)
                    if r is None:
                        continue
                    p = held[t]
                    p["high"] = max(p["high"], r.price)
                    atr = p["atr"] if math.isnan(r.atr_14) else r.atr_14
                    p["stop"] = max(p["stop"], p["high"] - p["k"] * atr)
                    reason = None
                    if r.price <= p["stop"]:
                        reason = "TRAILING_STOP"
                    elif r.price < sma(r):
                        reason = "TREND_BROKEN"
                    elif r.mom_r2 < 0:
                        reason = "MOMENTUM_LOST"
                    elif not sector_ok(t, day):
                        reason = "SECTOR_WEAK"
                    elif not macro_ok(t, day):
                        reason = "MACRO_BEARISH"
                    if reason:
                        cash += p["shares"] * r.price
                        trades.append((t, p["date"], day, reason, round(p["shares"], 3)))
                        del held[t]
        previous = monday
        free = config.max_positions - len(held)
        names, bought = [], []
        if free > 0:
            names = [t for t in eligible(monday) if t not in held and macro_ok(t, monday)]
            bought = names[:free]
            for t in bought:
                r = by_ticker[t].get(monday)
                money = min(C.CAPITAL / config.max_positions, cash)
                if r is None or money < 100:
                    continue
                cash -= money
                k = max(2.0, min(4.0, round(2.0 + r.atr_14 / r.price * 100 * 0.5, 2)))
                held[t] = {"date": monday, "shares": money / r.price, "high": r.price, "k": k,
                           "atr": r.atr_14, "stop": r.price - k * r.atr_14}
        worth = cash
        for t, p in held.items():
            worth += p["shares"] * by_ticker[t][max(d for d in by_ticker[t] if d <= monday)].price
        equity.append((monday, round(worth, 1), len(held)))
        weeks.append((monday, len(names), free, len(bought)))
    for t, p in held.items():
        trades.append((t, p["date"], days[-1], "END_OF_BACKTEST", round(p["shares"], 3)))
    return sorted(trades), equity, weeks


CONFIGS = [
    P.Config("base", 3), P.Config("short", 5, 150, 0.01), P.Config("one", 1),
    P.Config("dated", 4, 200, 0.0, weekdays(N_DAYS)[100], weekdays(N_DAYS)[470]),
]


def test_backtest_equals_simulation(market):
    ind, instruments, force_df, macro_df, sectors, zones, force, macro = market
    result = P.hybrid_backtest(ind, CONFIGS, instruments, force_df, macro_df)
    frame = ind.toPandas()
    trades, equity, weeks = (result.trades.collect(), result.equity.collect(), result.weeks.collect())
    for c in CONFIGS:
        want_trades, want_equity, want_weeks = simulate(frame, c, sectors, zones, force, macro)
        got = sorted((r.ticker, r.entry_date, r.exit_date, r.exit_reason, round(r.shares, 3))
                     for r in trades if r.config_id == c.config_id)
        assert [t[:4] for t in got] == [t[:4] for t in want_trades]
        assert all(abs(a[4] - b[4]) < 0.002 for a, b in zip(got, want_trades))
        got = sorted((r.date, r.value, r.n_positions) for r in equity if r.config_id == c.config_id)
        assert [(d, n) for d, _, n in got] == [(d, n) for d, _, n in want_equity]
        assert all(abs(a[1] - b[1]) < 0.2 for a, b in zip(got, want_equity))
        got = sorted((r.date, r.n_eligible, r.n_free, r.n_bought) for r in weeks if r.config_id == c.config_id)
        assert got == want_weeks
    reasons = {r.exit_reason for r in trades}
    assert {"TRAILING_STOP", "SECTOR_WEAK", "MACRO_BEARISH"} <= reasons
    measured = P.compare(P.backtest_measures(result), CONFIGS).collect()
    assert len(measured) == len(CONFIGS) and sum(r.is_best for r in measured) == 1
    assert max(measured, key=lambda r: r.sharpe).is_best


def test_no_context_lets_everything_pass(market):
    ind = market[0]
    result = P.hybrid_backtest(ind, [P.Config("free", 2)])
    assert {r.exit_reason for r in result.trades.collect()} <= {
        "TRAILING_STOP", "TREND_BROKEN", "MOMENTUM_LOST", "END_OF_BACKTEST"}


def test_measures_on_known_values(spark):
    day = [dt.date(2020, 1, 6) + dt.timedelta(7 * i) for i in range(4)]
    values = [100.0, 120.0, 90.0, 108.0]
    e = spark.createDataFrame([("c", d, v) for d, v in zip(day, values)], "config_id string, date date, value double")
    assert math.isclose(M.drawdown(e, ["config_id"]).first().max_drawdown_pct, 25.0)
    r = [0.2, -0.25, 0.2]
    mean = sum(r) / 3
    sd = math.sqrt(sum((x - mean) ** 2 for x in r) / 3)
    assert math.isclose(M.sharpe(e, ["config_id"]).first().sharpe, mean / (sd + 1e-9) * math.sqrt(52), rel_tol=1e-9)
    assert M.sharpe(e.limit(2), ["config_id"]).first().sharpe == 0.0
    t = spark.createDataFrame([("c", 10.0, 5, "A"), ("c", 4.0, 0, "A"), ("c", -2.0, 7, "B")],
                              "config_id string, return_pct double, duration_days int, exit_reason string")
    m = M.trade_measures(t, ["config_id"]).first()
    assert (m.n_trades, m.avg_win_pct, m.avg_loss_pct, m.profit_factor, m.avg_duration_days) == (3, 7.0, -2.0, 3.5, 6.0)
    x = {r.exit_reason: (r.n_trades, r.win_rate_pct) for r in M.exit_reasons(t, ["config_id"]).collect()}
    assert x == {"A": (2, 100.0), "B": (1, 0.0)}


def test_signal_backtest_equals_loop(spark):
    data = []
    for t in range(4):
        data += bar_rows(f"S{t}", walk(50 + t, 420, drift=0.002, vol=0.015), seed=t)
    rows = stage(SG.signals(bars(spark, data)), "rows")
    exits = stage(SG.exits_by_k(rows, (2.0, 3.0)), "exits")
    trades = SG.signal_trades(exits)
    taken = {(r.ticker, r.k, r.seq): r.exit_seq for r in trades.collect()}
    detail = {(r.ticker, r.k, str(r.entry_date)): r.outcome for r in SG.trade_detail(rows, exits).collect()}
    pdf = rows.orderBy("ticker", "seq").toPandas()
    want, equity = {}, {}
    for ticker, g in pdf.groupby("ticker"):
        price, atr, sig = list(g.price), list(g.atr_14), list(g.signal)
        raw, last = list(g.signal_raw), -99
        for i, s in enumerate(raw):
            keep = s and i - last > 5
            assert keep == sig[i]
            last = i if keep else last
        for k in (2.0, 3.0):
            entry, value = None, 1.0
            for i in range(len(price)):
                if entry is None:
                    if sig[i]:
                        entry, high, stop = i, price[i], price[i] - k * atr[i]
                        want[(ticker, k, i)] = None
                    continue
                value *= price[i] / price[i - 1]
                high = max(high, price[i])
                stop = max(stop, high - k * atr[i])
                if price[i] <= stop:
                    want[(ticker, k, entry)] = i
                    entry = None
            equity[(ticker, k)] = (value - 1) * 100
    assert want and taken == want
    measured = SG.sweep_measures(rows, trades, (2.0, 3.0))
    for r in measured.collect():
        assert math.isclose(r.total_return_pct, equity[(r.ticker, r.k)], rel_tol=1e-9, abs_tol=1e-9)
    assert {"IGNORED", "WIN", "LOSS", "OPEN"} >= set(detail.values())
    n_taken = sum(1 for v in detail.values() if v != "IGNORED")
    assert n_taken == len(want)
    best = {r.ticker: r.best_k for r in SG.best_k(measured).collect()}
    by = defaultdict(list)
    for r in measured.collect():
        by[r.ticker].append((-r.sharpe, r.k))
    assert best == {t: min(v)[1] for t, v in by.items()}
    summary = SG.sweep_summary(measured).collect()
    assert sum(r.is_best for r in summary) == 1
