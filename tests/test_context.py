"""Macro regime, sector strength and ranking edges."""

import datetime as dt

from pyspark.sql import functions as F

from helpers import bar_rows, bars, rows, walk, weekdays
from tidemark import schemas as S
from tidemark.plans import context as K, quality as Q, ranking as RK
from tidemark.sources import landed as L


def test_macro_warm_up_is_false_in_series_and_null_in_status(spark):
    day = weekdays(199)
    b = spark.createDataFrame([("^GSPC", d, 100.0 + i, 100.0 + i) for i, d in enumerate(day)], S.INDEX_BARS)
    zb = K.zone_prices(b)
    assert not K.macro_series(zb).agg(F.max("bull")).first()[0]
    status = K.macro_status(zb).first()
    assert (status.zone, status.bull, status.sma_200) == ("US", None, None)
    points = spark.createDataFrame([("US", day[5]), ("KR", day[5]), ("US", day[0] - dt.timedelta(1))],
                                   "zone string, date date")
    got = {(r.zone, r.date): r.macro_ok for r in K.macro_at(points, K.macro_series(zb)).collect()}
    assert got == {("US", day[5]): False, ("KR", day[5]): True, ("US", day[0] - dt.timedelta(1)): True}


def funds(spark, names, sector="Tech", zone="EU", index="^STOXX"):
    return spark.createDataFrame([(n, n, sector, zone, index, True) for n in names], S.SECTOR_ETF)


def series(name, prices, day):
    return [(name, d, p, p, 1) for d, p in zip(day, prices)]


def test_increment_uses_the_whole_history(spark):
    day, price = weekdays(80), walk(1, 80)
    idx = spark.createDataFrame([("^STOXX", d, 50.0, 50.0) for d in day], S.INDEX_BARS)
    full = spark.createDataFrame(series("E", price, day), S.ETF_BARS)
    want = rows(K.sector_strength(full, funds(spark, ["E"]), idx).where(F.col("date") >= day[70])
                .select("date", F.round("ratio_vs_ma50", 9)), "date")
    stored = spark.createDataFrame(series("E", price[:75], day[:75]), S.ETF_BARS)
    fresh = spark.createDataFrame(series("E", price[70:], day[70:]), S.ETF_BARS)
    got = K.sector_strength(stored, funds(spark, ["E"]), idx, fresh)
    assert rows(got.select("date", F.round("ratio_vs_ma50", 9)), "date") == want and len(want) == 10
    # The increment alone is too short for a mean and yields nothing.
    assert K.sector_strength(fresh, funds(spark, ["E"]), idx).count() == 0


def test_two_funds_of_one_sector_first_speaks(spark):
    day = weekdays(60)
    idx = spark.createDataFrame([("^STOXX", d, 50.0, 50.0) for d in day], S.INDEX_BARS)
    up, down = [100.0 + i for i in range(60)], [200.0 - i for i in range(60)]
    b = spark.createDataFrame(series("A", up, day) + series("B", down, day), S.ETF_BARS)
    etf = funds(spark, ["A", "B"])
    s = K.sector_strength(b, etf, idx)
    assert {r.in_force for r in K.force_series(s, etf).collect()} == {True}
    assert [r.ticker_etf for r in K.sectors_in_force(s, etf).collect()] == ["A"]
    assert K.sectors_dashboard(s, etf).count() == 2


def test_closed_day_rows_are_dropped(spark):
    day = weekdays(3)
    raw = spark.createDataFrame([("E", day[0], 1.0, 1.0, 5), ("E", day[1], None, float("nan"), 5),
                                 ("E", day[2], 0.0, 0.0, 5)], S.ETF_BARS)
    assert [r.date for r in L.landed_etf(raw).collect()] == [day[0]]


def test_carried_force_defaults(spark):
    day = weekdays(4)
    b = bars(spark, bar_rows("A", [1.0] * 4, day) + bar_rows("B", [1.0] * 4, day))
    inst = spark.createDataFrame([("A", "s", ["EU", "US"]), ("B", None, ["US"])],
                                 "ticker string, sector string, zone_priority array<string>")
    force = spark.createDataFrame([("s", "US", day[2], True)], "sector string, zone string, date date, in_force boolean")
    got = K.carried_force(b, inst, force)
    assert [r.force_rel for r in got.where("ticker = 'A'").orderBy("date").collect()] == [False, False, True, True]
    assert got.where("ticker = 'B' AND force_rel").count() == 4


def test_landed_bars_flatten_headers_and_clean(spark):
    raw = spark.createDataFrame(
        [("A", "2020-01-02", 1.0, float("inf"), 0.5, 1.0, 7), ("A", "2020-01-03", 1.0, 2.0, 0.5, float("nan"), 7)],
        "ticker string, Date string, `('Open', 'A')` double, High double, Low double, Close double, Volume long")
    got = L.landed_bars(raw).collect()
    assert len(got) == 1 and got[0].high is None and got[0].adj_close == 1.0 and got[0].open == 1.0


def test_eligible_rows_respect_gap_and_thresholds(spark):
    mon = dt.date(2020, 6, 8)
    data = [("fresh", mon, 2.0), ("five", mon - dt.timedelta(5), 2.0), ("six", mon - dt.timedelta(6), 2.0),
            ("below", mon, 0.5), ("superseded", mon - dt.timedelta(4), 2.0), ("superseded", mon - dt.timedelta(3), 0.5)]
    ind = spark.createDataFrame([(t, d, 0, p, 1.0, 1.0, 0.1, None, None, None) for t, d, p in data],
                                "ticker string, date date, seq int, price double, sma_200 double, sma_150 double, "
                                "mom_r2 double, rvol double, obv_slope double, atr_14 double")
    dates = spark.createDataFrame([(mon,)], "date date")
    assert sorted(r.ticker for r in RK.eligible_rows(ind, dates, 200, 0.0).collect()) == ["five", "fresh"]
    assert RK.eligible_rows(ind, dates, 200, 0.1).count() == 0
    one = RK.score_candidates(ind.where("ticker = 'fresh'"), dates).first()
    assert one.score == 0.5 and one["rank"] == 1


def test_quality_reports(spark):
    day = weekdays(30)
    b = bars(spark, bar_rows("A", walk(1, 30), day) + bar_rows("B", walk(2, 20), day[:20]))
    assert [r.ticker for r in Q.stale_tickers(b, day[-1]).collect()] == ["B"]
    log = spark.createDataFrame([(1, "A", day[0], True, "SUGGESTION", 100.0), (2, "A", day[2], False, "IGNORÉ", 0.0),
                                 (3, "A", day[1], True, "SUGGESTION", None)],
                                "id bigint, ticker string, date date, signal boolean, decision string, price_j0 double")
    filled = {r.id: r for r in Q.update_results(S.conform(log, S.SIGNAL_LOG), b, day[-1]).collect()}
    later = {r.date: r.adj_close for r in b.where("ticker = 'A'").collect()}
    target = later.get(day[0] + dt.timedelta(10))
    assert filled[1].price_j10 == target
    assert filled[2].result_pct is None and filled[3].price_j10 is None
    p = {r.column: r for r in Q.profile(log, "log").collect()}
    assert p["price_j0"].n_null == 1 and p["id"].n_rows == 3
