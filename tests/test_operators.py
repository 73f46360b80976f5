"""Operators against brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from helpers import START, rows, walk, weekdays
from tidemark.functions import scalars as X
from tidemark.operators import asof, exits, ranking as R, upsert as U


def dated(spark, data, schema):
    return spark.createDataFrame(data, schema)


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("unique", [False, True])
@pytest.mark.parametrize("tolerance", [None, 3])
def test_asof_join_equals_brute_force(spark, strict, forward, unique, tolerance):
    rng = random.Random(42)
    day = [START + dt.timedelta(days=i) for i in range(40)]
    right = [(k, d, rng.random()) for k in "ab" for d in day if rng.random() < 0.3]
    left = [(i, rng.choice("abc"), rng.choice(day)) for i in range(60)]
    left.append((99, None, day[3]))
    if unique:
        left = list({(k, d): (i, k, d) for i, k, d in left}.values())
    out = asof.asof_join(
        dated(spark, left, "id int, k string, on date"), dated(spark, right, "k string, date date, v double"),
        ["k"], "on", "date", {"v": "v"}, strict=strict, forward=forward, left_unique=unique,
        tolerance_days=tolerance)
    got = {r.id: r.v for r in out.collect()}
    assert len(got) == len(left)
    for i, k, d in left:
        if forward:
            hits = [(x, v) for kk, x, v in right if kk == k and (x > d if strict else x >= d)]
            best = min(hits, default=None)
        else:
            hits = [(x, v) for kk, x, v in right if kk == k and (x < d if strict else x <= d)]
            best = max(hits, default=None)
        if best and tolerance is not None and abs((d - best[0]).days) > tolerance:
            best = None
        assert got[i] == (best[1] if best else None), (i, k, d)


def test_stale_bar_tolerance_boundary(spark):
    right = dated(spark, [("a", START, 1.0)], "k string, date date, v double")
    left = dated(spark, [(n, "a", START + dt.timedelta(days=n)) for n in (5, 6)], "id int, k string, on date")
    out = asof.asof_join(left, right, ["k"], "on", "date", {"v": "v"}, tolerance_days=5)
    assert {r.id: r.v for r in out.collect()} == {5: 1.0, 6: None}


def test_asof_priority_gap(spark):
    d = START
    series = dated(spark, [("s", "EU", d + dt.timedelta(10), False), ("s", "US", d, True)],
                   "sector string, zone string, date date, in_force boolean")
    left = dated(spark, [(1, "s", ["EU", "US"], d + dt.timedelta(5)), (2, "s", ["EU", "US"], d + dt.timedelta(12)),
                         (3, "s", ["KR"], d + dt.timedelta(12)), (4, None, None, d)],
                 "id int, sector string, zones array<string>, on date")
    out = asof.asof_priority(left, series, "sector", "zones", "on", "in_force")
    assert {r.id: r.in_force for r in out.collect()} == {1: True, 2: False, 3: True, 4: True}


def test_last_known_crosses_hours(spark):
    t = dt.datetime(2020, 1, 1)
    data = [(1, t + dt.timedelta(minutes=20 * i), i, i if i % 5 == 0 and i else None) for i in range(30)]
    df = spark.createDataFrame(data, "k int, at timestamp, n int, v int")
    out = asof.last_known(df, ["k"], "at", ["at", "n"], "v", "seen")
    for r in out.collect():
        assert r.seen == (r.n // 5 * 5 or None)


def test_latest_and_one_per_key(spark):
    df = dated(spark, [("a", START, 1), ("a", START + dt.timedelta(1), 2), ("b", START, 3)],
               "k string, date date, v int")
    assert rows(asof.latest_per_key(df, ["k"]).select("k", "v"), "k") == [("a", 2), ("b", 3)]
    assert rows(asof.one_per_key(df, ["k"], ["date"], newest=False).select("k", "v"), "k") == [("a", 1), ("b", 3)]


def test_merge_is_idempotent_and_incoming_wins(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    delta = spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    once = U.merge(base, delta, ["k"])
    want = [(1, "a"), (2, None), (3, "c")]
    assert rows(once, "k") == want and rows(U.merge(once, delta, ["k"]), "k") == want


def test_policies(spark):
    base = spark.createDataFrame([(1, "EUR", 1.0, "n"), (2, None, 2.0, "m")], "k int, cur string, pe double, name string")
    delta = spark.createDataFrame([(1, "USD", None, "x"), (2, "CHF", 5.0, "y"), (3, "SEK", 6.0, "z")],
                                  "k int, cur string, pe double, name string")
    out = U.merge_with_policy(base, delta, ["k"], {"cur": "old_else_new", "pe": "new", "name": "insert_only"})
    assert rows(out, "k") == [(1, "EUR", None, "n"), (2, "CHF", 5.0, "m"), (3, "SEK", 6.0, "z")]


def test_update_from_writes_nulls_and_ignores_strangers(spark):
    base = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    staged = spark.createDataFrame([(1, None), (9, 9.0)], "k int, v double")
    assert rows(U.update_from(base, staged, ["k"]), "k") == [(1, None), (2, 2.0)]


def test_upsert_table_touches_only_its_months(spark, tmp_path):
    from tidemark.streaming.ingest import create_table

    path = str(tmp_path / "t")
    base = dated(spark, [("a", dt.date(2020, 1, 5), 1.0), ("a", dt.date(2020, 2, 5), 2.0)],
                 "ticker string, date date, close double")
    create_table(base, path)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "t" / "month=202001").iterdir()}
    delta = dated(spark, [("a", dt.date(2020, 2, 5), 3.0), ("a", dt.date(2020, 3, 1), 4.0)],
                  "ticker string, date date, close double")
    for _ in range(2):
        U.upsert_table(spark, path, delta, ["ticker", "date"])
        got = rows(spark.read.parquet(path).select("date", "close"), "date")
        assert got == [(dt.date(2020, 1, 5), 1.0), (dt.date(2020, 2, 5), 3.0), (dt.date(2020, 3, 1), 4.0)]
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "t" / "month=202001").iterdir()} == before


def test_rank_is_exact_under_a_hot_group(spark):
    rng = random.Random(1)
    data = [(1, f"t{i}", rng.choice([0.0, 0.25, 0.5, 1.0, rng.random()])) for i in range(500)]
    data += [(2, "x", 0.5)]
    df = spark.createDataFrame(data, "g int, t string, score double")
    got = {(r.g, r.t): r["rank"] for r in R.ranked_by_score(df, ["g"], "score", "t", buckets=16).collect()}
    want = sorted([d for d in data if d[0] == 1], key=lambda d: (-d[2], d[1]))
    assert [got[(1, d[1])] for d in want] == list(range(1, 501)) and got[(2, "x")] == 1


def test_min_max_flat_group_is_half(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 5.0), (2, 1.0), (2, 3.0)], "g int, m double")
    got = sorted(r.m_norm for r in R.min_max_scale(df, ["g"], ["m"]).collect())
    assert got == [0.0, 0.5, 0.5, 1.0]


def test_cool_down_example(spark):
    df = spark.createDataFrame([("a", s) for s in (13, 0, 1, 5, 6, 7, 11, 12)], "ticker string, seq int")
    assert sorted(r.seq for r in exits.cool_down(df).collect()) == [0, 6, 12]


def loop_exit(prices, atrs, start, k, rule=None):
    """Plain walk: first exit after ``start``."""
    high, stop = prices[start], prices[start] - k * atrs[start]
    for i in range(start + 1, len(prices)):
        high = max(high, prices[i])
        a = atrs[i] if atrs[i] is not None else atrs[start]
        stop = max(stop, high - k * a)
        if prices[i] <= stop:
            return i, "TRAILING_STOP"
        if rule and rule(i):
            return i, "RULE"
    return None, None


@pytest.mark.parametrize("block", [4, 64])
def test_first_exit_equals_loop(spark, block):
    rng = random.Random(7)
    path, entries, want = [], [], {}
    for t in range(12):
        n = rng.choice([1, 5, 90, 200])
        prices = walk(t, n, drift=0.004, vol=0.01)
        atrs = [None if i and rng.random() < 0.1 else rng.uniform(0.5, 3) for i in range(n)]
        bad = [rng.random() < 0.01 for _ in range(n)]
        name = f"t{t}"
        path += [(name, i, d, prices[i], atrs[i], bad[i]) for i, d in enumerate(weekdays(n))]
        for s in range(0, n, 3):
            if atrs[s] is None:
                continue
            for k in (2.0, 4.0):
                entries.append((name, s, k, prices[s], atrs[s]))
                want[(name, s, k)] = loop_exit(prices, atrs, s, k, lambda i: bad[i])
    p = spark.createDataFrame(path, "ticker string, seq int, date date, price double, atr double, bad boolean")
    e = spark.createDataFrame(entries, "ticker string, seq int, k double, price double, atr double")
    out = exits.first_exit(e, p, ["ticker", "seq", "k"], F.when(F.col("bar_bad"), "RULE"), first_block=block)
    got = {(r.ticker, r.seq, r.k): (r.exit_seq, r.exit_reason) for r in out.collect()}
    assert got == want


def test_stop_touch_exits(spark):
    p = spark.createDataFrame([("a", 0, START, 100.0, 5.0), ("a", 1, START, 90.0, 50.0)],
                              "ticker string, seq int, date date, price double, atr double")
    e = spark.createDataFrame([("a", 0, 2.0, 100.0, 5.0)], "ticker string, seq int, k double, price double, atr double")
    assert exits.first_exit(e, p, ["ticker", "seq", "k"]).first().exit_seq == 1


def test_trade_chain(spark):
    data = [("a", 1, 5), ("a", 3, 9), ("a", 5, 8), ("a", 6, None), ("a", 7, 9)]
    df = spark.createDataFrame(data, "ticker string, seq int, exit_seq int")
    assert sorted(r.seq for r in exits.chain_trades(df, ["ticker"]).collect()) == [1, 6]


def test_adaptive_k_examples(spark):
    data = [(4.0, 250.0, 2.8), (8.0, 130.0, 4.0), (2.0, 170.0, 2.59), (25.0, 900.0, 3.39), (1.0, 0.0, 3.0)]
    df = spark.createDataFrame(data, "a double, p double, want double")
    for r in df.select("want", X.adaptive_k(F.col("a"), F.col("p")).alias("k")).collect():
        assert r.k == r.want


def test_zones_and_currencies(spark):
    data = [("005930.KS", "South Korea"), ("NXPI", "Netherlands"), ("ASML.AS", "Netherlands"), ("RY.TO", "Canada"),
            ("X.DE", None)]
    df = spark.createDataFrame(data, "t string, c string")
    t, c = F.col("t"), F.col("c")
    got = rows(df.select("t", X.home_zone(X.zone_priority(t, c)),
                         X.home_zone(X.zone_priority(t, c, by_country_only=True)), X.quote_currency(t, F.lit(None))))
    assert got == [("005930.KS", "KR", "US", "KRW"), ("NXPI", "US", "EU", "USD"), ("ASML.AS", "EU", "EU", "EUR"),
                   ("RY.TO", "US", "US", "EUR"), ("X.DE", "US", "US", "EUR")]
