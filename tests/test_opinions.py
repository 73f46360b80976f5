"""Text extraction and opinion tracking."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from helpers import bars, rows
from tidemark import schemas as S
from tidemark.functions import text as T
from tidemark.plans import opinions as O


@pytest.mark.parametrize("text,want", [
    ("CONVICTION : **FORT**", "FORT"), ("## conviction — 🟢⚠️ modéré", "MODÉRÉ"), ("CONVICTION_MODERE", "MODÉRÉ"),
    ("conviction\n\n**faible**", "FAIBLE"), ("CONVICTION : élevée FORT", None), ("la CONVICTION est FORT", None),
    ("CONVICTION FORT puis CONVICTION : VENDRE", "VENDRE"), ("CONVICTION FAIBLE ; CONVICTION FORT", "FORT"),
    ("CONVICTION " + "-" * 31 + "FORT", None), ("CONVICTION" + "-" * 30 + "FORT", "FORT"), ("", None),
    ("CONVICTION: INSUFFISANT", "INSUFFISANT"), ("CONVICTION : [RENFORCER]", "RENFORCER"),
])
def test_conviction(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(T.conviction(F.col("t")), T.conviction_or_default(F.col("t"))).first()
    assert tuple(got) == (want, want or "MODÉRÉ")


@pytest.mark.parametrize("text,want", [
    ("RISQUE ÉVÉNEMENTIEL : OUI — earnings", True), ("risque événementiel : **non**", False),
    ("RISQUE  ÉVÉNEMENTIEL NON", False), ("RISQUE ÉVÉNEMENTIEL : EARNINGS NON TROUVÉ", None),
    ("RISQUE EVENEMENTIEL : OUI", None), ("RISQUE ÉVÉNEMENTIEL : peut-être NON", None),
])
def test_event_risk(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(T.event_risk(F.col("t"))).first()[0] is want


@pytest.mark.parametrize("text,want", [
    ("x\nRÉSUMÉ : un\n  deux \n\nPOUR : y", "un deux"), ("RESUME: a \nCONCLUSION b", "a"), ("RÉSUMÉ : **gras**", ""),
    ("RÉSUMÉ :\nPOUR x\nRESUME : repli\nCONTRE", "repli"), ("rien", ""), ("RÉSUMÉ: " + "é" * 600, "é" * 500),
    ("RESUME : b\nRÉSUMÉ : a", "a"),
])
def test_summary(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(T.summary(F.col("t"), T.SUMMARY_LENGTH)).first()[0] == want


def batch(spark, text, expected):
    return spark.createDataFrame([(1, dt.date(2020, 1, 6), expected, text, None)], S.OPINION_BATCHES)


def parse(spark, text, expected):
    out = O.extract_batch_opinions(batch(spark, text, expected)).collect()
    return {r.ticker: r for r in out}


def test_sections_by_order_line(spark):
    text = ("LECTURE DU LOT : le classement reflète NVDA et MU.\n\n**CLASSEMENT** : MU > NVDA > XX > MU\n"
            "=== TICKER : NVDA ===\nCONVICTION : FORT\n=== TICKER : mu (Micron) ===\nCONVICTION : FAIBLE\n")
    got = parse(spark, text, ["NVDA", "MU", "AAPL"])
    assert {t: (r.ai_rank, r.conviction) for t, r in got.items()} == {"NVDA": (2, "FORT"), "MU": (1, "FAIBLE")}
    assert got["MU"].order_line == "MU > NVDA > XX > MU"
    assert got["MU"].lot_reading == "le classement reflète NVDA et MU."
    out = O.parse_outcome(batch(spark, text, ["NVDA", "MU", "AAPL"])).first()
    assert (out.n_parsed, list(out.missing), out.status) == (2, ["AAPL"], "TERMINÉ")
    assert out.note == "partiel : 2/3 — manquants : AAPL"


def test_sections_fall_back_to_their_order(spark):
    text = "=== TICKER : B ===\nx\n=== TICKER : Société A (AA) ===\ny\n=== TICKER : B ===\nlast"
    got = parse(spark, text, ["AA", "B"])
    assert {t: (r.ai_rank, r.text) for t, r in got.items()} == {"B": (1, "last"), "AA": (2, "y")}


def test_korean_codes_and_unknown_headers(spark):
    text = "===TICKER: 5930\nCONVICTION: GARDER\n=== TICKER : ??? ===\nz\n=== TICKER : 105560.KS ===\nw"
    got = parse(spark, text, ["005930.KS", "105560.KS"])
    assert set(got) == {"005930.KS", "105560.KS"} and got["005930.KS"].conviction == "GARDER"


def test_nothing_parsed(spark):
    out = O.parse_outcome(batch(spark, "texte libre", ["A", "B"])).first()
    assert (out.n_parsed, out.status, out.note) == (0, "ERREUR", "parse: 0/2 section exploitable")
    assert O.extract_batch_opinions(batch(spark, "texte libre", ["A", "B"])).count() == 0


def opinion(week, ticker="A", type="ranking", at=None, **more):
    row = {f.name: None for f in S.OPINIONS.fields}
    row.update(week=week, ticker=ticker, type=type, generated_at=at, conviction="FORT", **more)
    return tuple(row.values())


MON = dt.date(2020, 1, 6)


def price_bars(spark, prices):
    return bars(spark, [("A", d, p, p, p, p, p, 1.0) for d, p in prices])


def test_forward_returns_horizons(spark):
    b = price_bars(spark, [(dt.date(2020, 1, 10), 100.0), (dt.date(2020, 1, 17), 110.0), (dt.date(2020, 1, 23), 90.0),
                           (dt.date(2020, 2, 7), 120.0)])
    o = spark.createDataFrame([
        opinion(MON, at=dt.datetime(2020, 1, 11, 6)),                      # anchor 10 January
        opinion(MON, type="position", at=dt.datetime(2020, 1, 11, 6)),     # untouched
        opinion(dt.date(2020, 1, 20)),                                     # written week + 6 days
        opinion(dt.date(2019, 12, 30), at=dt.datetime(2020, 1, 2)),        # before any bar
    ], S.OPINIONS)
    got = {(r.week, r.type): (r.return_1w, r.return_2w, r.return_4w)
           for r in O.forward_returns(o, b, dt.date(2020, 2, 6)).collect()}
    first = got[(MON, "ranking")]
    assert first[0] == pytest.approx(0.1) and first[1] == pytest.approx(-0.1) and first[2] is None
    assert got[(MON, "position")] == (None, None, None)
    # The bar one week after the anchor of 23 January is still the anchor itself.
    late = got[(dt.date(2020, 1, 20), "ranking")]
    assert late[0] is None and late[1] is None
    assert got[(dt.date(2019, 12, 30), "ranking")] == (None, None, None)
    full = {(r.week, r.type): r for r in O.forward_returns(o, b, dt.date(2020, 3, 1), ("ranking", "position")).collect()}
    assert full[(MON, "ranking")].return_4w == pytest.approx(0.2)
    assert full[(MON, "position")].price_4w == 120.0


def test_complete_opinions_keep_their_values(spark):
    b = price_bars(spark, [(dt.date(2020, 1, 6), 1.0), (dt.date(2020, 1, 8), 2.0)])
    o = spark.createDataFrame([opinion(MON, at=dt.datetime(2020, 1, 6), return_1w=9.0, return_2w=9.0, return_4w=9.0)], S.OPINIONS)
    assert O.forward_returns(o, b, dt.date(2021, 1, 1)).first().return_1w == 9.0


def test_selection_modes(spark):
    w2 = MON + dt.timedelta(7)
    o = spark.createDataFrame([
        opinion(MON, "A", rank=2), opinion(MON, "B", rank=None), opinion(MON, "C", rank=1),
        opinion(w2, "A", type="position", at=dt.datetime(2020, 1, 13)), opinion(w2, "A", at=dt.datetime(2020, 1, 14))], S.OPINIONS)
    assert [r.ticker for r in O.select_opinions(o, week=MON).collect()] == ["C", "A", "B"]
    assert O.select_opinions(o, ticker="a").first().type == "ranking"
    assert O.select_opinions(o, ticker="a", kind="position").first().type == "position"
    assert O.select_opinions(o).count() == 2 and O.select_opinions(o, everything=True).count() == 5
    assert O.select_opinions(o, week=MON, ticker="b").count() == 1
    recent = O.recent_opinions(o, dt.date(2020, 1, 14))
    assert rows(recent.select("ticker", "week"), "ticker") == [("A", w2)]


def test_previous_opinion(spark):
    o = spark.createDataFrame([opinion(MON, return_1w=0.1), opinion(MON + dt.timedelta(14))], S.OPINIONS)
    got = rows(O.last_opinion(o).select("prev_week", "prev_return"), "prev_week")
    assert got == [(None, None), (MON, 0.1)]


def test_reports(spark):
    o = spark.createDataFrame([
        opinion(MON, "A", return_1w=0.1), opinion(MON, "B", return_1w=-0.1, prompt_version="v"),
        opinion(MON, "C"), opinion(MON, "D", type="position", return_2w=-0.2)], S.OPINIONS)
    p = O.performance_by_conviction(o).first()
    assert (p.n, p.mean_1w, p.hit_1w, p.mean_4w) == (2, 0.0, 0.5, None)
    assert {r.prompt_version for r in O.performance_by_version(o).collect()} == {"—", "v"}
    sell = o.withColumn("conviction", F.lit("VENDRE"))
    assert O.position_performance(sell).first().hit_2w == 1.0
    c = {r.type: (r.n, r.n_with_return, r.n_tickers) for r in O.coverage(o).collect()}
    assert c == {"ranking": (3, 2, 3), "position": (1, 1, 1)}


def test_upsert_strips_nul_and_keeps_types_apart(spark):
    stored = spark.createDataFrame([opinion(MON, text="old"), opinion(MON, type="position", text="pos")], S.OPINIONS)
    fresh = spark.createDataFrame([opinion(MON, text="n\u0000ew")], S.OPINIONS)
    got = {r.type: r for r in O.upsert_opinions(stored, fresh, dt.datetime(2020, 2, 1)).collect()}
    assert got["ranking"].text == "new" and got["ranking"].generated_at == dt.datetime(2020, 2, 1)
    assert got["position"].text == "pos"


def test_backfill_needs_more_than_the_prefix(spark):
    df = spark.createDataFrame([("position_auto", None), ("position", None), (None, None), ("position_x", "ranking")],
                               "source string, type string")
    assert [r.type for r in O.backfill_type(df).collect()] == ["position", "ranking", "ranking", "ranking"]


def test_summary_is_whole_unless_cut(spark):
    df = spark.createDataFrame([("RÉSUMÉ : " + "é" * 900,)], "t string")
    whole, shown = df.select(T.summary(F.col("t")), T.summary(F.col("t"), 500)).first()
    assert whole == "é" * 900 and shown == "é" * 500
