"""Ledger events, valuation and its exit conditions."""

import datetime as dt
import math
import random
from decimal import Decimal

import pytest

from helpers import bar_rows, bars, walk, weekdays
from tidemark import constants as C, schemas as S
from tidemark.plans import positions as POS
from tidemark.plans.ranking import ranking_indicators
from tidemark.session import stage

DAY = dt.date(2020, 3, 2)
AT = dt.datetime(2020, 3, 2, 9)


def position(id, ticker="AAA", status=C.OPEN, quote="USD", price="100", quantity="2", buy=DAY, **more):
    row = dict(id=id, ticker=ticker, buy_date=buy, buy_price=Decimal(price), quantity=Decimal(quantity), status=status,
               sell_date=None, sell_price=None, sell_reason=None, source="ranking", comment=None, portfolio_id=1,
               quote_currency=quote, txn_price=None, txn_currency=None, invested_eur=None)
    row.update(more)
    return tuple(row[f.name] for f in S.POSITIONS.fields)


def event(id, kind, hours=0, **more):
    row = dict(event_id=id, event_time=AT + dt.timedelta(hours=hours), kind=kind, position_id=None, ticker=None, price=None,
               quantity=None, event_date=None, currency=None, reason=None, source=None, comment=None, portfolio_id=None,
               invested_eur=None)
    row.update({k: Decimal(v) if k in ("price", "quantity", "invested_eur") else v for k, v in more.items()})
    return tuple(row[f.name] for f in S.POSITION_EVENTS.fields)


@pytest.fixture(scope="module")
def world(spark):
    instruments = spark.createDataFrame([("AAA", "USD"), ("BBB.DE", None)], "ticker string, currency string")
    portfolios = spark.createDataFrame([(1, "p", True), (2, "q", False)], S.PORTFOLIOS)
    b = bars(spark, [("CCC", DAY, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)])
    fx = spark.createDataFrame([("USD", DAY, 1.2), ("CHF", DAY - dt.timedelta(3), 1.1), ("CHF", DAY, 1.0)], S.FX_RATES)
    return instruments, portfolios, b, fx


def apply(spark, world, positions, events):
    instruments, portfolios, b, fx = world
    out = POS.apply_position_events(
        spark.createDataFrame(positions, S.POSITIONS), spark.createDataFrame(events, S.POSITION_EVENTS), portfolios,
        instruments, b, fx)
    return {r.id: r for r in out.collect()}


def test_rejections(spark, world):
    instruments, portfolios, b, _ = world
    good = dict(ticker="aaa", price="1", quantity="1", event_date=DAY, source="manuel", portfolio_id=1)
    events = [
        event(1, "open", **good), event(2, "open", **{**good, "source": "tip"}), event(3, "open", **{**good, "ticker": "a b"}),
        event(4, "open", **{**good, "ticker": "ZZZ"}), event(5, "open", **{**good, "portfolio_id": 9}),
        event(6, "open", **{**good, "portfolio_id": 2}), event(7, "open", **{**good, "ticker": " "}),
        event(8, "open", **{**good, "ticker": "CCC"}), event(9, "close", position_id=1, price="1", reason="WHIM"),
        event(10, "close", position_id=77, price="1", reason="MANUEL"), event(11, "edit", position_id=2, price="1"),
        event(12, "edit", position_id=1)]
    p = spark.createDataFrame([position(1), position(2, status=C.CLOSED)], S.POSITIONS)
    out = POS.check_events(spark.createDataFrame(events, S.POSITION_EVENTS), p, portfolios, instruments, b)
    assert {r.event_id: list(r.reject_reasons) for r in out.collect()} == {
        1: [], 2: ["BAD_SOURCE"], 3: ["BAD_TICKER", "UNKNOWN_TICKER"], 4: ["UNKNOWN_TICKER"], 5: ["NO_PORTFOLIO"], 6: ["INACTIVE_PORTFOLIO"],
        7: ["NO_TICKER", "UNKNOWN_TICKER"], 8: [], 9: ["BAD_REASON"], 10: ["NO_POSITION"], 11: ["NOT_OPEN"], 12: ["NOTHING_TO_EDIT"]}


def test_open_converts_and_keeps_the_entered_price(spark, world):
    base = dict(ticker="AAA", quantity="3", event_date=DAY + dt.timedelta(1), source="manuel", portfolio_id=1)
    out = apply(spark, world, [position(1)], [
        event(5, "open", price="50", currency="CHF", **base), event(6, "open", price="50", currency="USD", **base),
        event(7, "open", price="50", currency="CHF", **{**base, "event_date": DAY - dt.timedelta(9)}),
        event(8, "open", price="50", **{**base, "ticker": "BBB.DE"})])
    assert out[-5].buy_price == Decimal("60.0000") and out[-5].txn_price == 50 and out[-5].txn_currency == "CHF"
    assert out[-6].buy_price == 50 and out[-6].txn_price is None
    assert -7 not in out  # no rate on that day
    assert out[-8].quote_currency == "EUR" and out[1].buy_price == 100


def test_edits_and_closes(spark, world):
    out = apply(spark, world, [position(1), position(2), position(3)], [
        event(1, "edit", 1, position_id=1, quantity="5"), event(2, "edit", 2, position_id=1, quantity="6", comment="x"),
        event(3, "close", 3, position_id=1, price="120", event_date=DAY, reason="MANUEL"),
        event(4, "edit", 4, position_id=1, quantity="9"), event(5, "close", 5, position_id=1, price="1", event_date=DAY, reason="MANUEL"),
        # The date edit moves the purchase before the first dollar rate: later foreign prices have none.
        event(6, "edit", 1, position_id=2, event_date=DAY - dt.timedelta(2)),
        event(7, "edit", 2, position_id=2, price="10", currency="CHF", quantity="7"),
        event(8, "edit", 1, position_id=3, price="10", currency="CHF"), event(9, "edit", 2, position_id=3, price="11"),
    ])
    one, two, three = out[1], out[2], out[3]
    assert (one.status, one.quantity, one.comment, one.sell_price, one.sell_reason) == (C.CLOSED, 6, "x", 120, "MANUEL")
    assert (two.buy_date, two.buy_price, two.quantity) == (DAY - dt.timedelta(2), 100, 2)
    assert (three.buy_price, three.txn_price, three.txn_currency) == (11, 10, "CHF")


def test_zero_result_stays_zero_and_null_counts_as_loss(spark):
    p = spark.createDataFrame([
        position(1, status=C.CLOSED, sell_price=Decimal("100")), position(2, status=C.CLOSED, sell_price=Decimal("110")),
        position(3, status=C.CLOSED), position(4, price="0", sell_price=Decimal("1"))], S.POSITIONS)
    got = {r.id: (r.result, r.result_pct) for r in POS.with_amounts(p).collect()}
    assert got[1] == (0, 0) and got[2] == (20, 10) and got[3] == (None, None) and got[4][1] is None
    s = POS.closed_summary(p).first()
    assert (s.n_closed, s.n_wins, s.n_losses, s.total_result) == (3, 1, 2, 20)


def test_rates(spark, world):
    fx = world[3]
    df = spark.createDataFrame([(1, "EUR", DAY), (2, None, DAY), (3, "CHF", DAY - dt.timedelta(1)), (4, "CHF", DAY - dt.timedelta(8))],
                               "id int, currency string, on date")
    assert {r.id: r.rate for r in POS.rate_on(df, fx, "currency", "on", "rate").collect()} == {1: 1.0, 2: 1.0, 3: 1.1, 4: None}


def test_search_order(spark):
    df = spark.createDataFrame([("MU", "Micron", "T"), ("AMU", None, None), ("MUX", "Mux", "T"), ("ZZ", "Mu corp", "T"), ("Q", "x", "T")],
                               "ticker string, name string, sector string")
    got = [(r.ticker, r.name, r.sector) for r in POS.search_instruments(df, " mu ").collect()]
    assert [g[0] for g in got] == ["MU", "MUX", "ZZ", "AMU"] and got[3][1:] == ("", "—")
    assert [r.ticker for r in POS.search_instruments(df, "", 2).collect()] == ["AMU", "MU"]


def test_valuation_equals_walk(spark):
    rng = random.Random(3)
    data = []
    for t in range(3):
        data += bar_rows(f"T{t}", walk(t, 320, drift=0.001), seed=t, high_low=t != 2)
    ind = stage(ranking_indicators(bars(spark, data)), "ind")
    pdf = ind.orderBy("ticker", "seq").toPandas()
    pos = []
    for i in range(60):
        t = rng.randrange(4)
        buy = weekdays(320)[rng.randrange(320)] + dt.timedelta(days=rng.randrange(4))
        pos.append(position(i, f"T{t}", buy=buy, price=str(rng.randint(60, 200)), quote=rng.choice(["EUR", "USD", "XXX"]),
                            invested_eur=Decimal(500) if i % 2 else None))
    p = spark.createDataFrame(pos, S.POSITIONS)
    instruments = spark.createDataFrame([("T0", "s", ["US"]), ("T1", "s", ["EU"])], "ticker string, sector string, zone_priority array<string>")
    d0, d1 = weekdays(320)[0], weekdays(320)[-1]
    force = spark.createDataFrame([("s", "US", d0, False), ("s", "EU", d0, True)], "sector string, zone string, date date, in_force boolean")
    macro = spark.createDataFrame([("US", d0, True), ("US", d1, False), ("EU", d0, False)], "zone string, date date, bull boolean")
    fx = spark.createDataFrame([("USD", d0, 1.25), ("USD", d1, 1.5)], S.FX_RATES)
    out = {r.id: r for r in POS.evaluate_positions(p, ind, instruments, force, macro, fx).collect()}
    assert len(out) == 60
    for row in pos:
        pid, ticker, buy, price, quantity = row[0], row[1], row[2], float(row[3]), float(row[4])
        r = out[pid]
        g = pdf[pdf.ticker == ticker]
        if not len(g):
            assert r.alert == "INCONNU" and r.price is None and list(r.violated) == []
            continue
        last = g.iloc[-1]
        since = g[g.date >= buy]
        if len(since):
            atr = since.iloc[0].atr_14
            atr = last.atr_14 if math.isnan(atr) else atr
            k = max(2.0, min(4.0, round(2.0 + atr / price * 50, 2)))
        else:
            atr, k = last.atr_14, 3.0
        high, stop = price, price - k * atr
        for x in since.itertuples():
            high = max(high, x.price)
            stop = max(stop, high - k * (atr if math.isnan(x.atr_14) else x.atr_14))
        assert abs(r.k - k) < 0.011
        if abs(r.k - k) < 1e-9:
            assert abs(r.stop - stop) < 0.011
            want = "VIOLATED" if last.price <= stop else (
                "WARNING" if round((last.price - stop) / last.price * 100, 2) < 2 else "OK")
            assert r.c_trailing_stop == want
        assert r.c_sector == ("VIOLATED" if ticker == "T0" else "OK")
        # Regimes are read at the earliest of the zones' newest dates.
        assert r.c_macro == ("VIOLATED" if ticker == "T1" else "OK")
        now = {"EUR": 1.0, "USD": 1.5, "XXX": None}[r.quote_currency]
        assert (r.value_eur is None) == (now is None)
        if now:
            assert abs(r.value_eur - last.price * quantity / now) < 0.006
    roll = POS.evaluation_summary(POS.evaluate_positions(p, ind, instruments, force, macro, fx)).first()
    assert roll.n_positions == 60 and roll.n_exit == sum(r.alert == "SORTIE_RECOMMANDÉE" for r in out.values())


def test_portfolio_counts(spark):
    p = spark.createDataFrame([position(1), position(2, status=C.CLOSED), position(3)], S.POSITIONS)
    f = spark.createDataFrame([(1, "p", True), (2, "q", True), (3, "r", False)], S.PORTFOLIOS)
    assert [(r.id, r.n_open, r.n_closed) for r in POS.portfolio_counts(f, p).collect()] == [(1, 2, 1), (2, 0, 0)]
    assert POS.portfolio_counts(f, p, active_only=False).count() == 3
